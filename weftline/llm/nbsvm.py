"""Text quality by Naive Bayes support vectors.

A text's features are indicators of n-grams: words (folded), pairs of words,
and n-grams up to three of word shapes (case, digits, length, signs at either
end, whether a word repeats the one before), hashed to 2**18 columns. A class's
log-count ratio scales each indicator, and a linear hinge-loss model of the
scaled indicators is fitted by dual coordinate descent. A logistic curve, fitted
on rows that another fit of the model left out, turns margins into scores.

Defined cases: null and empty texts have the constant feature alone and get the
score that it gives; a very long text is worked on by itself, in memory of some
50 times its bytes; rows that repeat score alike; without labels of both classes
(or in an empty table) all scores are 0.5; no other column than the text is read
for a score; a column of the score's name that is there already is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textops as X
from .labelled import TRAIN_ROWS, fit_logistic, held_out, sigmoid, training

BITS = 18
_U = np.uint64
_ROWS = 8_000  # rows of a block, so that row and column fit 31 bits

_byte = np.arange(256)
_UPPER = (_byte >= 0x41) & (_byte <= 0x5A)
_DIGIT = (_byte >= 0x30) & (_byte <= 0x39)
_LETTER = X.FOLDED > 0
#: Signs by themselves, all others as one: capitals, small letters, digits, bytes of non-ASCII characters.
_EDGE = np.where(_LETTER, np.where(_UPPER, 1, np.where(_DIGIT, 2, np.where(_byte >= 0x80, 3, 4))), _byte + 8)


def _shapes(data, starts, ends) -> np.ndarray:
    """A hash of each word's shape."""
    upper, digit = (np.add.reduceat(t[data].astype(np.int32), starts) for t in (_UPPER, _DIGIT))
    n = ends - starts
    size = np.digitize(n, [2, 4, 8, 14, 24])
    last, before = _EDGE[data[ends - 1]], _EDGE[data[np.maximum(ends - 2, starts)]]
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, 2))
    code = _EDGE[data[starts]] + (last << 9) + (np.where(last >= 8, before, 0) << 18) + (case << 27) + (np.minimum(digit, 2) << 29) + (size << 31)
    return X.mix(code.astype(_U) + _U(1))


def columns(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each different indicator of each row, sorted; column 0 is the constant."""
    many = len(offsets) - 1
    starts, ends, bounds = X.split(data, offsets, X.PLAIN)
    keys = [np.arange(many, dtype=np.int64) << BITS]
    if len(starts):
        rows = X.row_of(bounds)
        words = X.word_hashes(data, starts, ends, X.PLAIN, np.where(_LETTER, X.FOLDED, _byte))
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        shapes = _shapes(data, starts, ends) ^ np.where(again, _U(0xA5A5A5A5), _U(0))
        for kind, base, n in ((1, words, 1), (2, words, 2), (3, shapes, 1), (4, shapes, 2), (5, shapes, 3)):
            grams = X.gram_hashes(base ^ _U(kind), n)
            ok = np.arange(len(grams)) + n <= bounds[1:][rows[: len(grams)]]
            keys.append((rows[: len(grams)][ok] << BITS) | np.maximum((grams[ok] >> _U(64 - BITS)).astype(np.int64), 1))
    key = np.concatenate(keys).astype(np.uint32)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> BITS).astype(np.int64), (key & ((1 << BITS) - 1)).astype(np.int64)


def _blocks(column: pa.Array):
    for r0, data, offsets in X.chunks(column):
        for a in range(0, len(offsets) - 1, _ROWS):
            part = offsets[a : a + _ROWS + 1]
            yield r0 + a, data[part[0] : part[-1]], part - part[0]


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the linear hinge-loss model, by coordinate descent on its dual (one variable a row, between 0 and cost)."""
    w = np.zeros(len(scale))
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    square = np.array([v @ v for v in values])
    order = np.random.default_rng(1)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            if square[i] <= 0:
                continue
            g = y[i] * (w[rows[i]] @ values[i]) - 1.0
            pg = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost else g
            if pg:
                worst = max(worst, abs(pg))
                new = min(max(alpha[i] - g / square[i], 0.0), cost)
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
        if worst < tolerance:
            break
    return w


def fit_model(rows: list[np.ndarray], y: np.ndarray, *, cost: float = 0.05, smoothing: float = 1.0, blend: float = 0.5) -> np.ndarray:
    """Weight of each column: ratio times the model's weight, blended with its mean size; y is 0 or 1."""
    counts = [np.full(1 << BITS, smoothing) for _ in range(2)]
    for r, label in zip(rows, y, strict=True):
        counts[label][r] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    ratio[0] = 1.0
    w = descend(rows, np.where(y == 1, 1.0, -1.0), ratio, cost)
    size = np.abs(w[w != 0]).mean() if w.any() else 0.0
    mixed = (1 - blend) * size + blend * w
    mixed[0] = w[0]
    return mixed * ratio


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[float]] | None:
    """Weights and the curve (a, b), from a bounded sample of labelled rows; executors make the features."""
    X.prepare(docs.sparkSession)

    def emit(batches):
        for b in batches:
            for r0, data, offsets in _blocks(b.column(1)):
                row, col = columns(data, offsets)
                cut = np.searchsorted(row, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, len(offsets) - 1), pa.array([col[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(offsets) - 1)], pa.binary()), b.column(2).slice(r0, len(offsets) - 1)], names=["id", "cols", "y"])

    sample = training(docs, labels, label_col, id_col=id_col, text_col=text_col, rows=rows)
    got = sample.select("id", "text", "y").mapInArrow(emit, "id long, cols binary, y int").toArrow()
    got = got.sort_by([("id", "ascending"), ("cols", "ascending")])
    y = got["y"].to_numpy()
    if len(set(y.tolist()) & {0, 1}) < 2:
        return None
    feats = [np.frombuffer(v, np.int32) for v in got["cols"].to_pylist()]
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % 3 if min((y == 0).sum(), (y == 1).sum()) >= 6 else None
    if fold is None:
        w = fit_model(feats, y)
        return w, [1.0, 0.0]
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        w = fit_model([feats[i] for i in inside], y[inside])
        for i in np.flatnonzero(fold == k):
            margins[i] = w[feats[i]].sum()
    curve = fit_logistic(margins[:, None], y.astype(float), ridge=1e-2)
    return fit_model(feats, y), [float(c) for c in curve]


def scored(docs: DataFrame, model, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with the score (0 to 1, higher: label 1 likelier) of each row's whole text; one map, no shuffle."""
    X.prepare(docs.sparkSession)
    docs = X.without(docs, score_col, text_col)
    if model is None:
        return docs.withColumn(score_col, F.lit(0.5))
    weights, (slope, constant) = model[0].astype(np.float32), model[1]
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            margin = np.zeros(b.num_rows)
            for r0, data, offsets in _blocks(b.column(at)):
                row, col = columns(data, offsets)
                margin[r0 : r0 + len(offsets) - 1] = np.bincount(row, weights[col].astype(float), len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(slope * margin + constant))], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, *, limit: float = 0.3, **learn_options) -> DataFrame:
    model = learn(docs, labels, **learn_options)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= limit).cast("int").alias("predicted"))
