"""Exact substring dedup with suffix automata of reference shards.

A word (a run of bytes other than ASCII white space, taken as it is) goes if a
window of 13 consecutive words covers it whose words also start in a document
with a smaller id. All documents are each other's reference, so the corpus is
cut into reference shards first, such that a window and all its copies meet in
one shard and most text meets none:

1. Every window has an anchor, the smallest hash of the 4-grams in it. Anchors
   in one document only (an aggregate with map-side combine) are dropped.
2. Neighbouring windows with one anchor are a segment. Equal segments are
   aggregated by hash to one with its smallest document: a segment of a later
   document goes whole. So exact copies, however many, end here.
3. The different segments of one anchor are a part of a reference shard. A suffix
   automaton of them, with the smallest document of each state, is built; each
   segment is streamed through it, and matching statistics of 13 words or more
   whose state has a smaller document mark its windows.

The shards are bounded: an anchor in more than hot_docs documents is not used
as a key. Its windows are keyed one by one by their own hash, where equality
settles all, so no key has more than one segment and nothing is left out.

Defined cases: null or empty texts have no words; rows with a null id neither
refer nor lose words; rows that share an id don't remove each other's words,
each is judged with its own text; text order decides nothing, only ids do; a very
long text is one row of a task, its windows are dealt like others; an empty table
gives no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .automaton import SuffixAutomaton

GRAM = 4
#: Windows in a segment at most (bits of its mask).
SEGMENT = 32
#: Words of reference segments in one automaton, more only if one anchor has more.
SHARD_WORDS = 20_000
HOT_DOCS = 2_000
#: Bits of an anchor that are dropped: anchors only bring candidates together, so shorter ones cost nothing but a few of them.
SHORT = 12

_U = np.uint64


def _windows(data, offsets, window):
    """Of a flat run of texts: word starts and ends, word bounds and hashes, and the anchor of the window at each word (with validity)."""
    starts, ends, bounds = X.split(data, offsets, X.PLAIN)
    words = X.word_hashes(data, starts, ends, X.PLAIN)
    count = max(0, len(words) - window + 1)
    grams = X.gram_hashes(words, GRAM)
    low, have, need = grams, 1, window - GRAM + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    rows = X.row_of(bounds)
    valid = np.arange(count) + window <= bounds[1:][rows[:count]]
    return starts, ends, bounds, words, rows, low[:count] >> _U(SHORT), valid


def _runs(anchor, rows, valid):
    """First window and number of windows of each run with one anchor within a row."""
    n = len(valid)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:n] != rows[: n - 1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    keep = valid[at]
    return at[keep], size[keep]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(a, d): the distinct anchors of each document."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for r0, data, offsets in X.chunks(b.column(1)):
                *_, rows, anchor, valid = _windows(data, offsets, window)
                at, _ = _runs(anchor, rows, valid)
                if len(at):
                    a, r = anchor[at], rows[at]
                    order = np.lexsort((a, r))
                    a, r = a[order], r[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(X.signed(a[new])), pa.array(ids[r0 + r[new]], pa.int64())], names=["a", "d"])

    return docs.mapInArrow(run, "a long, d long")


def _parts(words, at, size, window):
    """Of runs the segments of SEGMENT windows at most: first and end window, and a hash of the words."""
    parts = -(-size // SEGMENT)
    first = np.repeat(at, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
    end = np.minimum(first + SEGMENT, np.repeat(at + size, parts))
    if not len(first):
        return first, end, np.zeros(0, _U)
    width = end - first + window - 1
    cut = np.cumsum(width) - width
    within = np.arange(width.sum()) - np.repeat(cut, width)
    terms = X.mix(words[np.repeat(first, width) + within] + (within.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F))
    return first, end, X.mix(np.add.reduceat(terms, cut))


def _single(words, window):
    """Two hashes of every window by itself."""
    return X.gram_hashes(words, window), X.gram_hashes(words ^ _U(0x5851F42D4C957F2D), window)


def _listed(lists, r0, rows):
    """Of the rows' lists of hashes: each with its row worked in, and the flat values' slice."""
    part = lists.slice(r0, rows)
    sizes = np.diff(part.offsets.to_numpy()[: rows + 1])
    return _at(np.repeat(np.arange(rows), sizes), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U))


def _at(row, value):
    return value ^ X.mix(row.astype(_U) + _U(1))


def _segments(marked: DataFrame, window: int) -> DataFrame:
    """(a, s, d): segments of anchors that other documents have too; those of hot anchors by window."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for r0, data, offsets in X.chunks(b.column(1)):
                *_, words, rows, anchor, valid = _windows(data, offsets, window)
                at, size = _runs(anchor, rows, valid)
                if not len(at):
                    continue
                key, many = _at(rows[at], anchor[at]), len(offsets) - 1
                cold, hot = (np.isin(key, _listed(b.column(c), r0, many)) for c in (2, 3))
                first, _, s = _parts(words, at[cold], size[cold], window)
                a, d = anchor[first], ids[r0 + rows[first]]
                if hot.any():
                    sizes = size[hot]
                    p = np.repeat(at[hot], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    one, two = (x[p] for x in _single(words, window))
                    a, s, d = np.concatenate([a, one]), np.concatenate([s, two]), np.concatenate([d, ids[r0 + rows[p]]])
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(a)), pa.array(X.signed(s)), pa.array(d, pa.int64())], names=["a", "s", "d"])

    return marked.mapInArrow(run, "a long, s long, d long")


def _segment_words(asked: DataFrame, window: int) -> DataFrame:
    """(a, s, m, seg): the words of the segments that are asked for (hashes in the third column), each once a document."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for r0, data, offsets in X.chunks(b.column(1)):
                starts, ends, _, words, rows, anchor, valid = _windows(data, offsets, window)
                first, end, s = _parts(words, *_runs(anchor, rows, valid), window)
                if not len(first):
                    continue
                key = _at(rows[first], s)
                _, once = np.unique(key, return_index=True)
                pick = once[np.isin(key[once], _listed(b.column(2), r0, len(offsets) - 1))]
                first, end, s, raw = first[pick], end[pick], s[pick], data.tobytes()
                seg = [b" ".join(raw[x:y].split()) for x, y in zip(starts[first].tolist(), ends[end + window - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(anchor[first])), pa.array(X.signed(s)), pa.array(ids[r0 + rows[first]], pa.int64()), pa.array(seg, pa.binary())], names=["a", "s", "m", "seg"])

    return asked.mapInArrow(run, "a long, s long, m long, seg binary")


def _shard_masks(segments: DataFrame, window: int) -> DataFrame:
    """(a, s, mask): of the different segments of shared anchors, sorted by anchor, the windows that a smaller document has."""

    def solve(segments):
        """Build the automaton of some anchors' segments and stream them through it."""
        sam = SuffixAutomaton()
        segments = [(a, s, m, seg.split()) for a, s, m, seg in segments]
        for _, _, m, words in segments:
            sam.add(words, m)
        sam.settle()
        link, length, owners = sam.link, sam.length, sam.owners
        found = []
        for a, s, m, words in segments:
            mask = 0
            for i, (state, n) in enumerate(sam.walk(words)):
                if n >= window:
                    while length[link[state]] >= window:
                        state = link[state]
                    if owners[state] < m:
                        mask |= 1 << (i - window + 1)
            if mask:
                found.append((a, s, mask))
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["a", "s", "mask"])

    def run(batches):
        shard, words, current = [], 0, None
        for b in batches:
            for a, s, m, seg in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if a != current and words >= SHARD_WORDS:
                    yield solve(shard)
                    shard, words = [], 0
                current = a
                shard.append((a, s, m, seg))
                words += seg.count(b" ") + 1
        if shard:
            yield solve(shard)

    return segments.mapInArrow(run, "a long, s long, mask long")


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc_id, text, gone) of each row; gone: array of (s, mask), the hashes of its segments with the windows that go, -1 for all."""
    spark = docs.sparkSession
    X.prepare(spark)
    base = docs.select(X.column(docs, id_col, "doc_id", "bigint"), X.column(docs, text_col, "text", "string"))
    known = base.where(F.col("doc_id").isNotNull())
    occurrences = _anchors(known, window)
    repeated = occurrences.groupBy("a").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("docs")).where("lo < hi").select("a", (F.col("docs") > hot_docs).alias("hot"))
    marks = occurrences.join(repeated, "a").groupBy("d").agg(F.collect_list(F.when(~F.col("hot"), F.col("a"))).alias("cold_a"), F.collect_list(F.when(F.col("hot"), F.col("a"))).alias("hot_a"))
    # the texts are shuffled once: the three joins with them have one exchange
    marked = known.join(marks.withColumnRenamed("d", "doc_id"), "doc_id")
    segments = _segments(marked, window)
    # the tests for null, which joins bring along, stand here so that the three uses of this have one exchange
    firsts = segments.where("s is not null and a is not null").groupBy("s", "a").agg(F.min("d").alias("m")).where("m is not null")
    # anchors with different segments make the reference shards
    shared = firsts.groupBy("a").agg(F.count("*").alias("many"), F.max("m").alias("last")).where("many > 1 and last is not null").select("a")
    asked = firsts.join(shared, "a").groupBy(F.col("m").alias("doc_id")).agg(F.collect_list("s").alias("s"))
    shards = _segment_words(known.join(asked, "doc_id"), window)
    masks = _shard_masks(shards.repartition(X.scaled_partitions(spark), "a").sortWithinPartitions("a"), window)
    both = F.struct("s", "a").alias("sa")
    judged = firsts.select(both, "m").join(masks.select(both, "mask"), "sa", "left")
    gone = segments.select(both, "s", "d").join(judged, "sa").withColumn("mask", F.expr("case when d > m then -1L else mask end")).where("mask != 0").groupBy("d").agg(F.collect_list(F.struct("s", "mask")).alias("gone"))
    found = known.join(gone.withColumnRenamed("d", "doc_id"), "doc_id", "left")
    return found.unionByName(base.where(F.col("doc_id").isNull()), allowMissingColumns=True)


def _stay(words, anchor, valid, rows, bounds, gone, r0, window) -> np.ndarray:
    """Of a chunk's words, those that no window to remove covers."""
    many = len(bounds) - 1
    part = gone.slice(r0, many)
    sizes = np.nan_to_num(np.array(part.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    values = part.flatten()
    stay = np.ones(len(words), bool)
    if not len(values):
        return stay
    known = _at(np.repeat(np.arange(many), sizes), values.field(0).to_numpy(zero_copy_only=False).view(_U))
    masks = values.field(1).to_numpy(zero_copy_only=False)
    known, order = np.unique(known, return_index=True)
    masks = masks[order]

    met = np.zeros(len(known), bool)

    def look(row, value):
        key = _at(row, value)
        i = np.searchsorted(known, key)
        i[i == len(known)] = 0
        hit = known[i] == key
        met[i[hit]] = True
        return np.where(hit, masks[i], 0)

    change = np.zeros(len(words) + 1, np.int64)
    first, end, s = _parts(words, *_runs(anchor, rows, valid), window)
    got = look(rows[first], s)
    flagged = np.zeros(len(valid), bool)
    for k in range(SEGMENT):
        p = first + k
        p = p[(p < end) & ((got == -1) | (got >> k & 1 == 1))]
        flagged[p] = True
    if not met.all():  # the rest are windows of hot anchors
        flagged |= valid & (look(rows[: len(valid)], _single(words, window)[1]) == -1)
    p = np.flatnonzero(flagged)
    np.add.at(change, p, 1)
    np.add.at(change, p + window, -1)
    return np.cumsum(change[:-1]) == 0


def _apply(found: DataFrame, window: int, make, schema: str, types) -> DataFrame:
    """make(id, number of words, words that stay) of each row of removals()."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for r0, data, offsets in X.chunks(b.column(1)):
                starts, ends, bounds, words, rows, anchor, valid = _windows(data, offsets, window)
                stay = _stay(words, anchor, valid, rows, bounds, b.column(2), r0, window)
                raw, out = data.tobytes(), []
                for r in range(len(bounds) - 1):
                    x, y = int(bounds[r]), int(bounds[r + 1])
                    own = stay[x:y]
                    if own.all():
                        kept = raw[offsets[r] : offsets[r + 1]].split()
                    else:
                        kept = [raw[i:j] for i, j in zip(starts[x:y][own].tolist(), ends[x:y][own].tolist(), strict=True)]
                    out.append(make(ids[r0 + r], y - x, kept))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return found.select("doc_id", "text", "gone").mapInArrow(run, schema)


def digest(found: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of removals()."""

    def make(i, n, kept):
        return i, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _apply(found, window, make, "doc_id long, n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def deduplicated(found: DataFrame, window: int = 13) -> DataFrame:
    """doc_id and the words that stay of each row of removals(), joined by one space."""

    def make(i, n, kept):
        return i, b" ".join(kept).decode()

    return _apply(found, window, make, "doc_id long, text string", [pa.int64(), pa.string()])
