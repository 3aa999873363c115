"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors are normalised and centred; a rotation of their principal axes is
learned on a bounded sample so that the signs are balanced 1-bit codes with
little quantisation error (alternating: codes from signs, rotation from an
orthogonal Procrustes problem). A code of b bits is cut into bands of about 13
bits, and each band is the key of a Hamming table. All rows are in all tables;
two vectors meet if a band agrees, and so do all whose codes differ in fewer
bits than there are bands, and most of the others. Where vectors share a large
mean, or otherwise too few pairs meet, further rotations add tables: recall is
measured on pairs that sampled rows have in the input (by brute force) and on
pairs planted at the threshold. What meets is compared by
Hamming distance and then by the cosine of the original vectors, in double
precision.

A bucket's members are compared in blocks of matrices: a task gives for each
vector how many of the other block it links with (a pair counts in the first
band where it agrees) and links that span the same components, never the pairs.
Large buckets are cut into blocks, and pairs of blocks are spread over tasks.
Equal vectors are one vector with a count first.

Defined cases: labels that are null, rows with a null id, and vectors that are
null, empty, zero or hold null or non-finite components, link with nothing;
vectors of different lengths don't link; rows that share an id are each judged by
their own vector (two rows, two results); an empty table gives no row; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .graph import broadcast_if, components

#: Vectors that the rotation is learned on, at most, and rounds of learning.
SAMPLE_ROWS, LEARN_ROUNDS = 10_000, 30
#: Bits of a band, and rows of a block.
BAND_BITS, BLOCK = 13, 1_024
#: Rotations at most; the recall that pairs of the input and pairs planted at the threshold must reach; rows that it is measured on.
ROTATIONS, RECALL, QUERY_ROWS = 32, 0.97, 256
_U = np.uint64


def learn_rotation(x: np.ndarray, rounds: int = LEARN_ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the projection whose signs are the code: principal axes times the learned rotation."""
    mean = x.mean(0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    v = z @ axes
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        b = np.where(v @ q >= 0, 1.0, -1.0)
        u, _, t = np.linalg.svd(v.T @ b)
        q = u @ t
    return mean, axes @ q


def _met(x: np.ndarray, y: np.ndarray, mean, projection, bands) -> np.ndarray:
    """Whether the unit vectors x[i] and y[i] agree in a band."""
    same = (((x - mean) @ projection) >= 0) == (((y - mean) @ projection) >= 0)
    return np.any([same[:, a:b].all(1) for a, b in bands], 0)


def _true_pairs(vectors: DataFrame, labels: np.ndarray, queries: np.ndarray, d: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the threshold of these unit query vectors and all vectors of (label, e), by brute force; of a batch, 4 for each query at most."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                own = part.column(0).to_numpy()
                e = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d))
                cos = queries @ e.T
                hit = (cos >= threshold) & (cos < 1 - 1e-12) & (labels[:, None] == own[None, :])
                q, r = np.nonzero(hit & (hit.cumsum(1) <= 4))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([x.tobytes() for x in e[r]], pa.binary())], names=["q", "e"])

    got = vectors.mapInArrow(run, "q long, e binary").limit(20_000).collect()
    return queries[[r["q"] for r in got]].reshape(-1, d), np.frombuffer(b"".join(bytes(r["e"]) for r in got)).reshape(-1, d)


def _tables(x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The mean, projections side by side and their bands: rotations are added until true pairs, and pairs planted at the threshold around x, meet."""
    d = x.shape[1]
    random = np.random.default_rng(7)
    other = random.normal(size=x[:2000].shape)
    other -= (other * x[:2000]).sum(1, keepdims=True) * x[:2000]
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    planted = x[:2000], threshold * x[:2000] + math.sqrt(max(0.0, 1 - threshold * threshold)) * other
    cuts = np.linspace(0, d, max(1, math.ceil(d / BAND_BITS)) + 1).astype(int)
    projections, bands, missed = [], [], [np.ones(len(p[0]), bool) for p in (pairs, planted)]
    for k in range(ROTATIONS):
        mean, projection = learn_rotation(x, LEARN_ROUNDS if k == 0 else 3, 5 + k)
        own = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        missed = [m & ~_met(*p, mean, projection, own) for m, p in zip(missed, (pairs, planted), strict=True)]
        projections.append(projection)
        bands += [(k * d + a, k * d + b) for a, b in own]
        if all(m.mean() <= 1 - RECALL for m in missed if len(m)):
            break
    return mean, np.concatenate(projections, 1), bands


def _usable(e):
    """Null unless all components are finite numbers and one isn't zero."""
    plain = F.size(e) > 0
    good = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    return F.when(e.isNotNull() & plain & good, e)


def _unit(e: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1; scaled first, so that no square overflows."""
    e = e.astype(np.float64)
    e = e / np.abs(e).max(1, keepdims=True)
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def _coded(vectors: DataFrame, d: int, mean, projection, bands: list[tuple[int, int]], kind: type) -> DataFrame:
    """(r, label, copies, band, key, code, e) of each band of each vector; e: its bytes, in the precision that it came in."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                e = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(part.num_rows, d)
                bits = ((_unit(e) - mean) @ projection) >= 0
                code = [np.packbits(row).tobytes() for row in bits]
                raw = [row.tobytes() for row in e]
                for k, (x, y) in enumerate(bands):
                    key = bits[:, x:y].astype(np.int64) @ (1 << np.arange(y - x))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(code, pa.binary()), pa.array(raw, pa.binary())], names=["r", "label", "copies", "band", "key", "code", "e"])

    return vectors.select("r", "label", "copies", "e").mapInArrow(run, "r long, label long, copies long, band int, key long, code binary, e binary")


def _roots(links: np.ndarray) -> np.ndarray:
    """Of a square link matrix, for each row the smallest row of its component."""
    root = np.arange(len(links))
    while True:
        low = np.where(links, root[None, :], len(root)).min(1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", threshold: float = 0.98, radius: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    radius: Hamming distance beyond which vectors are not compared; none by
    default (all that meet in a table are compared).
    """
    spark = vectors.sparkSession
    X.prepare(spark)
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = vectors.withColumn("e", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), _usable(F.col("e"))))
    good = rows.where("e is not null")
    # equal vectors of a label: one stands for all, under a number of its own (r)
    same = good.select("vec_id", "label", F.size("e").alias("d"), F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(1), "e").alias("h2"), "e")
    key = ["label", "d", "h1", "h2"]
    single = X.checkpointed(same.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("e").alias("e")).withColumn("r", F.monotonically_increasing_id()))
    counts, spans = None, None
    for d in [r["d"] for r in single.select("d").distinct().collect()]:  # usually one length
        of_d = single.where(F.col("d") == d)
        sampled = of_d.orderBy(F.xxhash64("r"), "r").limit(sample_rows).select("label", "e").collect()
        x = _unit(np.array([r["e"] for r in sampled], float))
        some = np.array([r["label"] for r in sampled[:QUERY_ROWS]])
        mean, projection, bands = _tables(x, _true_pairs(of_d.select("label", "e"), some, x[:QUERY_ROWS], d, threshold), threshold)
        found = _compared(_coded(of_d, d, mean, projection, bands, kind), d, bands, threshold, radius, kind)
        found = X.checkpointed(found)
        part, edge = found.where("n is not null").select("r", "n"), found.where("n is null").select(F.col("r").alias("x"), F.col("other").alias("y"))
        counts, spans = (part, edge) if counts is None else (counts.unionByName(part), spans.unionByName(edge))
    if counts is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    total = counts.groupBy("r").agg(F.sum("n").alias("n"))
    label = components(X.checkpointed(spans))
    # of each component the smallest id
    tops = single.select(F.col("r").alias("v"), "least").join(broadcast_if(label), "v").groupBy("label").agg(F.min("least").alias("component_id"))
    placed = label.join(tops, "label").select(F.col("v").alias("r"), "component_id")
    found = single.select("r", *key, "least", "copies").join(total, "r", "left").join(placed, "r", "left")
    # written, so that the join deals out both sides and can split a vector of many copies
    found = X.checkpointed(found.select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    X.discard(single, label)
    linked = same.select("vec_id", *key).join(found, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _compared(coded: DataFrame, d: int, bands, threshold: float, radius: int | None, kind: type) -> DataFrame:
    """(r, n, other): counts of copies that r links with, and spanning links (n null)."""
    spark = coded.sparkSession
    buckets = coded.groupBy("label", "band", "key").agg(F.count("*").alias("many")).where("many > 1").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    placed = coded.join(buckets.drop("many"), ["label", "band", "key"]).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "r"), F.col("blocks")).cast("int"))
    # block i meets block j >= i in one task: a row goes to the pairs (own, j) and (j, own)
    sent = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "band", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "r", "copies", "code", "e")
    at = ["label", "band", "key", "i", "j"]
    dealt = sent.repartition(X.scaled_partitions(spark), *at).sortWithinPartitions(*at)
    width = bands[-1][1]
    edges = np.array([x for x, _ in bands] + [width])

    def compare(own, r, n, codes, e, band, i, j):
        bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(r), -1), axis=1)[:, :width]
        a, b = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(r)),) * 2
        if not len(a) or not len(b):
            return None
        link = e[a] @ e[b].T >= threshold
        p, q = np.nonzero(link)
        differ = bits[a[p]] != bits[b[q]]
        ok = np.ones(len(p), bool) if radius is None else differ[:, :d].sum(1) <= radius
        for k in range(band):  # counted in an earlier band
            ok &= differ[:, edges[k] : edges[k + 1]].any(1)
        ok &= a[p] != b[q]
        p, q = a[p[ok]], b[q[ok]]
        if not len(p):
            return None
        count = np.bincount(p, n[q], len(r))
        if i != j:
            count += np.bincount(q, n[p], len(r))
        square = np.zeros((len(r), len(r)), bool)
        square[p, q] = square[q, p] = True
        root = _roots(square)
        has, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(r)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([r[has], r[moved]])), pa.array(np.concatenate([count[has], np.zeros(len(moved))]).astype(np.int64), mask=np.arange(len(has) + len(moved)) >= len(has)), pa.array(np.concatenate([np.zeros(len(has), np.int64), r[root[moved]]]))],
            names=["r", "n", "other"],
        )

    def run(batches):
        held: pa.Table | None = None

        def groups(t: pa.Table):
            """Whole groups of the table, of more than one row."""
            keys = np.stack([t[c].to_numpy() for c in at], 1)
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if y - x > 1:
                    g = t.slice(x, y - x)
                    got = compare(g["own"].to_numpy(), g["r"].to_numpy(), g["copies"].to_numpy(), g["code"].to_pylist(), _unit(np.frombuffer(b"".join(g["e"].to_pylist()), kind).reshape(y - x, d)), int(keys[x][1]), int(keys[x][3]), int(keys[x][4]))
                    if got is not None:
                        yield got

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if not held.num_rows:
                continue
            last = np.stack([held[c].to_numpy() for c in at], 1)
            new = np.flatnonzero((last != last[-1]).any(1))
            if len(new):
                end = int(new[-1]) + 1
                yield from groups(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from groups(held)

    return dealt.mapInArrow(run, "r long, n long, other long")
