"""Mixing to target weights with soft membership.

A softmax classifier, fitted on a labelled table (rows of ids and domains),
gives each document a posterior over domains. Rates r >= 0 of documents are then
fitted by least squares, such that the expected tokens of the domains,
sum of r * tokens * posterior, match the targets:

    minimise  sum_k ((S_k(r) - T_k) / T)^2 + pull * sum_d t_d / T * (r_d - 1)^2

by projected gradient steps (with Nesterov's momentum, scaled by tokens, clipped
at 0). A step needs the domains' sums only. They are aggregated over all
documents; a document's rate follows from its posterior and the few vectors of
the steps so far, so rates are never stored, sent or collected. Documents of
almost equal posteriors (CELLS steps a domain) have almost equal rates, so most
steps run over one row for each such cell; the last ones run over all documents,
until the sums of these meet the tolerance.

The rate takes effect as copies: its whole part, and one more with the
probability of the rest, decided by a hash of the row.

Defined cases: null and empty texts have no tokens, so no target asks for
another rate than 1; without labels of two domains all posteriors are equal; a
domain without labels has posterior 0 where others have labels; rows that repeat
have one rate and the same copies each; a long text is one row like others; an
empty table gives no row; columns of any name are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import textops as X
from .labelled import TRAIN_ROWS, training
from .nbsvm import BITS, _blocks, columns


#: Steps of a domain's posterior in which documents are counted together.
CELLS = 256


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_softmax(rows: list[np.ndarray], y: np.ndarray, k: int, rounds: int = 6, rate: float = 0.5) -> np.ndarray:
    """Weights (columns x k) of a softmax on length-normalised indicators, by AdaGrad steps."""
    w, seen = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-2)
    order = np.random.default_rng(2)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            r = rows[i]
            unit = len(r) ** -0.5
            p = _softmax(w[r].sum(0) * unit)
            p[y[i]] -= 1
            g = p * unit
            seen[r] += g * g
            w[r] -= rate * g / np.sqrt(seen[r])
    return w


def learn_domains(docs: DataFrame, labels: DataFrame, domain_col: str, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
    """(weights, whether it has labels) of the domains 0 ... the largest labelled, or None where there are fewer than two."""
    X.prepare(docs.sparkSession)

    def emit(batches):
        for b in batches:
            for r0, data, offsets in _blocks(b.column(1)):
                row, col = columns(data, offsets)
                cut = np.searchsorted(row, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, len(offsets) - 1), pa.array([col[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(offsets) - 1)], pa.binary()), b.column(2).slice(r0, len(offsets) - 1)], names=["id", "cols", "y"])

    got = training(docs, labels, domain_col, id_col=id_col, text_col=text_col, rows=rows).select("id", "text", "y").mapInArrow(emit, "id long, cols binary, y int").toArrow()
    got = got.sort_by([("id", "ascending"), ("cols", "ascending")])
    y = got["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    k = int(y.max()) + 1
    return fit_softmax([np.frombuffer(v, np.int32) for v in got["cols"].to_pylist()], y, k).astype(np.float32), np.bincount(y, minlength=k) > 0


def posteriors(docs: DataFrame, learned, k: int, *, text_col: str = "text", tokens: str = "_tokens", posterior: str = "_posterior") -> DataFrame:
    """docs with the token count (words) and the domain posterior of each row."""
    X.prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    weights, open_ = None, np.ones(k, bool)
    if learned is not None:
        have = min(k, learned[0].shape[1])
        weights, open_ = np.zeros((1 << BITS, k), np.float32), np.zeros(k, bool)
        weights[:, :have], open_[:have] = learned[0][:, :have], learned[1][:have]
    schema = StructType([*docs.schema.fields, StructField(tokens, LongType()), StructField(posterior, ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z, n = np.zeros((b.num_rows, k)), np.zeros(b.num_rows, np.int64)
            for r0, data, offsets in _blocks(b.column(at)):
                many = len(offsets) - 1
                n[r0 : r0 + many] = np.diff(X.split(data, offsets, X.PLAIN)[2])
                if weights is not None:
                    row, col = columns(data, offsets)
                    unit = np.maximum(np.bincount(row, minlength=many), 1) ** -0.5
                    for j in range(k):
                        z[r0 : r0 + many, j] = np.bincount(row, weights[col, j].astype(float), many) * unit
            z[:, ~open_] = -np.inf
            p = _softmax(z)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))], names=[*b.schema.names, tokens, posterior])

    return docs.mapInArrow(run, schema)


class Plan:
    """The steps so far; rate(p) replays them for posteriors p."""

    def __init__(self, pull: float) -> None:
        self.pull, self.step = pull, 1.0 / (1.0 + pull)
        self.gaps: list[np.ndarray] = []

    def rates(self, p: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates after all steps; ahead: the point at which the next step takes its gradient."""
        r = last = np.ones(len(p))
        y, t = r, 1.0
        for gap in self.gaps:
            last, r = r, np.maximum(0.0, y - self.step * (p @ gap + self.pull * (y - 1.0)))
            t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            y = r + (before - 1) / t * (r - last)
        return y if ahead else r


def fit_rates(table: DataFrame, weights: list[float], *, anchor: int | None = None, headroom: float = 1.0, pull: float = 1e-3, steps: int = 40, tolerance: float = 1e-4) -> Plan:
    """Steps towards domain sums in proportion to weights; table has _tokens and _posterior.

    The total asked for is that of the table, or, with an anchor domain, such
    that the anchor keeps headroom times the tokens it has.
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    plan = Plan(pull)

    def sums(rows, ahead: bool, rate=True):
        def run(batches):
            total = np.zeros(k)
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                t = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                total += (t * (plan.rates(p, ahead) if rate else 1.0)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], names=["k", "s"])

        got = rows.select("_tokens", "_posterior").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(k)
        for r in got:
            out[r["k"]] = r["s"]
        return out

    now = sums(table, False, rate=False)
    total = now.sum()
    if total <= 0:
        return plan
    target = share * (total if anchor is None or share[anchor] <= 0 else headroom * now[anchor] / share[anchor])
    cell = F.transform("_posterior", lambda p: F.round(p * CELLS).cast("int"))
    mean = F.array(*(F.sum(F.col("_posterior")[j] * F.col("_tokens")) / F.sum("_tokens") for j in range(k)))
    cells = table.where("_tokens > 0").groupBy(cell.alias("cell")).agg(F.sum("_tokens").cast("long").alias("_tokens"), mean.alias("_posterior"))
    spread = X.checkpointed(cells)
    cells = X.checkpointed(spread.coalesce(1 + spread.count() // 50_000))
    X.discard(spread)
    for rows, most in ((cells, steps), (table, 5)):
        current = now if rows is cells else sums(table, True)
        for _ in range(most):
            gap = (current - target) / total
            if np.abs(gap).max() < tolerance:
                break
            plan.gaps.append(gap)
            current = sums(rows, True)
    X.discard(cells)
    return plan


def mixed(docs: DataFrame, labels: DataFrame, domain_col: str, weights: list[float], *, id_col: str = "doc_id", text_col: str = "text", apply: bool = True, rows: int = TRAIN_ROWS, **fit_options) -> DataFrame:
    """docs with each row as often as its rate says; with apply=False for each row its id, n_tokens, posterior, rate and copies."""
    k = len(weights)
    learned = learn_domains(docs, labels, domain_col, id_col=id_col, text_col=text_col, rows=rows)
    tokens, posterior, row_name, rate_name, copies, one = ["_tokens", "_posterior", "_row", "_rate", "_copies", "_one"]
    if apply:  # texts are classified once: they are written with their posteriors
        tokens, posterior, row_name, rate_name, copies, one = X.fresh(docs, tokens, posterior, row_name, rate_name, copies, one)
        full = X.written(posteriors(docs.withColumn(row_name, F.xxhash64(id_col, text_col)), learned, k, text_col=text_col, tokens=tokens, posterior=posterior))
        plan = fit_rates(full.select(F.col(tokens).alias("_tokens"), F.col(posterior).alias("_posterior")), weights, **fit_options)
    else:
        own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
        full = X.checkpointed(posteriors(own, learned, k, text_col="_text").drop("_text"))
        plan = fit_rates(full, weights, **fit_options)
    at, row = full.columns.index(posterior), full.columns.index(row_name)

    def rate(batches):
        for b in batches:
            if b.num_rows:
                p = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                r = plan.rates(p)
                u = (X.mix(b.column(row).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(11)).astype(float) * 2.0**-53
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r), pa.array(np.floor(r + u).astype(np.int64))], names=[*b.schema.names, rate_name, copies])

    rated = full.mapInArrow(rate, StructType([*full.schema.fields, StructField(rate_name, DoubleType()), StructField(copies, LongType())]))
    if not apply:
        return rated.select(F.col("_id").alias(id_col), F.col("_tokens").alias("n_tokens"), F.col("_posterior").alias("posterior"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
    return rated.where(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
