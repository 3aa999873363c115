"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts
and digits or signs that stand for letters to Latin letters, and turns the rest
into spaces. The lexicon holds a short fixed list and entries learned from
labelled rows: words and beginnings of words that toxic documents have and
clean ones mostly don't, weighted by log odds. One automaton finds the entries
and the exception phrases; an entry inside an exception phrase doesn't count,
and the entries that begin at one word count once, with the largest weight. The weights found,
set against the text's length, give the score through a logistic curve that is
fitted on labelled rows which the weights were not learned from.

Defined cases: null and empty texts match nothing and score as a text without
hits; a very long text takes time in proportion to its length and hits; rows that
repeat score alike; without labels of both classes (or in an empty table) only
the fixed list and fixed coefficients are used; no other column than the text is
read for a score; a column of the score's name that is there already is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textops as X
from .labelled import fit_logistic, held_out, sigmoid, training

# Words of abuse, and phrases in which such a word is harmless.
INSULTS = "idiot moron stupid loser trash pathetic worthless disgusting scum clown imbecile dumbass retard bastard bitch asshole scumbag jackass pig vermin filth degenerate cretin".split()
EXCEPTIONS = ["trash can", "trash bin", "taking out the trash", "take out the trash", "class clown", "clown fish", "circus clown", "loser pays", "guinea pig", "pig iron", "white trash novel", "stupid question", "pond scum"]
#: Labelled rows that entries, weights and curve are learned from, at most: rare entries need many.
LEXICON_ROWS = 20_000
#: Weight of a word of the fixed list that labelled rows don't tell about.
PRIOR = 3.0
# Letters of other scripts, digits and signs by what they look like.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "г": "r", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "з": "z", "ӏ": "l",
    # Greek
    "α": "a", "β": "b", "ς": "c", "δ": "d", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ζ": "z",
    # Latin letters that do not decompose
    "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ſ": "s", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Log odds of an entry count up to this: two rare entries weigh more than one that is frequent.
MOST = 7.0
#: Lengths of the word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7, 8)


class _Fold(dict):
    """Character table for str.translate, filled as characters come."""

    def __missing__(self, code: int):
        c = chr(code)
        got = []
        for d in unicodedata.normalize("NFKD", c.lower()):
            d = LOOKALIKES.get(d, DIGITS.get(d, d))
            if len(d) == 1 and (unicodedata.combining(d) or unicodedata.category(d) == "Cf"):
                continue
            got.append(d if d.isalnum() else " ")
        self[code] = out = "".join(got)
        return out


_fold = _Fold()
#: Signs count as letters only before a letter; runs of them are decoration.
_SIGNS = re.compile(r"[@$]+(?![^\W\d_])|[@$]{2,}")
_SPACES = re.compile(" {2,}")


def fold(text: str) -> str:
    """Folded words with one space before, between and after."""
    if "$" in text or "@" in text:
        text = _SIGNS.sub(" ", text)
    return _SPACES.sub(" ", f" {text.translate(_fold)} ")


def entries_of(words) -> set[str]:
    """The entries that words could give: each whole (between spaces), and its beginnings (after a space)."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in BEGINNINGS if k < len(w))
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase).strip()) + 2, None))
        self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """log of the summed weights, of hits against length, of different entries, and of words."""
        folded = fold(text or "")
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, weight) in self.automaton.iter(folded):
            if weight is None:
                spared.append((end - size + 1, end))
            else:
                at = end - size + 1
                best[at] = (size, max(weight, best[at][1]) if at in best else weight)  # of one beginning, the longest comes last
        if spared:
            # phrases in order of their starts; furthest: the last character that those up to each reach
            spared.sort()
            starts, furthest, reach = [a for a, _ in spared], [], -1
            for _, b in spared:
                furthest.append(reach := max(reach, b))
            # spaces are shared by neighbours, so an entry lies inside a phrase if one that starts before or with it reaches its end
            inside = [x for x, (size, _) in best.items() if (k := bisect_right(starts, x)) and furthest[k - 1] >= x + size - 1]
            for at in inside:
                del best[at]
        words = folded.count(" ") - 1 if folded.strip() else 0
        times = Counter(folded[a : a + s] for a, (s, _) in best.items())
        weight = {folded[a : a + s]: w for a, (s, w) in best.items()}
        # one entry over and over says less than several: its count enters by its logarithm
        total = sum(weight[e] * (1 + math.log(n)) for e, n in times.items())
        different = len(times)
        return math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(different), math.log1p(words)


#: Coefficients where labels can't give them: a sum of about two strong entries in a short text is toxic.
DEFAULT = [1.0, 1.0, 0.5, 0.0, -4.0]


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = LEXICON_ROWS, least: int = 3, odds: float = 1.6) -> tuple[dict[str, float], list[float]]:
    """Weights by entry and the curve's coefficients, from a bounded sample of labelled rows.

    The entries' counts are summed by Spark; only entries seen in `least` toxic
    documents or more, with log odds of `odds` or more, come to the driver.
    """
    X.prepare(docs.sparkSession)
    sample = X.checkpointed(training(docs, labels, label_col, id_col=id_col, text_col=text_col, rows=rows).select("id", "text", "y", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(3)).alias("part")))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    weights = {f" {w} ": PRIOR for w in INSULTS}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 8:
        return weights, DEFAULT

    def emit(batches):
        for b in batches:
            entry, y, part = [], [], []
            for text, label, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = entries_of(set(fold(text or "").split()))
                entry += own
                y += [label] * len(own)
                part += [p] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), pa.array(y, pa.int32()), pa.array(part, pa.int32())], names=["entry", "y", "part"])

    counted = sample.select("text", "y", F.col("part").cast("int")).mapInArrow(emit, "entry string, y int, part int").groupBy("entry").agg(
        *(F.sum(F.when((F.col("y") == y) & (F.col("part") != out), 1).otherwise(0)).alias(f"n{y}_{out}") for y in (0, 1) for out in (0, 1, 2, 3))
    )

    def odds_of(out):  # 3: all parts
        n = {(r["y"]): r["n"] for r in sample.where(F.col("part") != out).groupBy("y").agg(F.count("*").alias("n")).collect()}
        return F.log((F.col(f"n1_{out}") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col(f"n0_{out}") + 0.5) / (n.get(0, 0) + 1.0))

    scored = counted.where(f"n1_3 >= {least}").select("entry", *(F.when(F.col(f"n1_{o}") >= least - (o < 3), odds_of(o)).alias(f"w{o}") for o in range(4)))
    found = scored.where(" or ".join(f"w{o} >= {odds}" for o in range(4))).collect()

    def lexicon(o):
        out = dict(weights)
        for r in found:
            if (w := r[f"w{o}"]) is not None and w >= odds:
                out[r["entry"]] = min(float(w), MOST)
        return out

    # each third is scored with weights from the other two, for the curve to be fair
    tables = {o: lexicon(o) for o in range(3)}

    def features(batches):
        own = {o: Lexicon(t, EXCEPTIONS) for o, t in tables.items()}
        for b in batches:
            got = [own[p].features(t) for t, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.float64()) for i in range(4)), b.column(1)], names=["f0", "f1", "f2", "f3", "y"])

    rows_ = sample.select("text", "y", F.col("part").cast("int")).mapInArrow(features, "f0 double, f1 double, f2 double, f3 double, y int").collect()
    m = np.array([tuple(r) for r in rows_], float)
    m = m[np.lexsort(m.T)]
    return lexicon(3), [float(b) for b in fit_logistic(m[:, :4], m[:, 4], ridge=0.1)]


def scored(docs: DataFrame, model: tuple[dict[str, float], list[float]], *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with the score (0 to 1) of each row's whole text; one map, no shuffle."""
    X.prepare(docs.sparkSession)
    weights, curve = model
    docs = X.without(docs, score_col, text_col)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches):
        lexicon = Lexicon(weights, EXCEPTIONS)
        for b in batches:
            if b.num_rows:
                f = np.array([lexicon.features(t.as_py()) for t in b.column(at)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(f @ np.array(curve[:-1]) + curve[-1]))], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame, **learn_options) -> DataFrame:
    model = learn(docs, labels, **learn_options)
    return scored(docs.select(F.col("doc_id"), "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below limit, with their columns."""
    (name,) = X.fresh(docs, "_toxicity")
    return scored(docs, learn(docs, labels), score_col=name).where(F.col(name) < limit).drop(name)
