"""Near-duplicate texts by BagMinHash signatures of their word shingles.

A document is the multiset of its five-word shingles (lower-cased words of
digits, a-z and non-ASCII characters; a text of fewer words is one shingle).
Weights are the counts. Above the discretised weights lies a hierarchy of
Poisson processes: for each shingle the roots are the ranges (0,1], (1,2],
(2,4], ... A process of a wide range gives its first point, which falls on one
of the signature's components and on one weight level, and is then replaced by
the processes of its two halves, which begin where the point is; halves above a
document's weight are never entered. A range of one level goes on by itself. A
component keeps the smallest point at or below the weight, and a process ends
when it has passed the document's largest component. So two documents agree in
a component with a probability of their weighted Jaccard similarity.

Signatures are cut into bands. One document of a bucket leads it. Every document
is compared, exactly, by multiset overlap, with the lead that it shares most
buckets with; documents of a bucket that this leaves in different classes are
then compared with the bucket's other members in blocks, so no link is lost and
a class of copies is not expanded to its pairs.

Defined cases: null and empty texts, texts without a word, and rows with a null
id are alone; equal word sequences are one class without a comparison; rows that
share an id are judged each by its own text; a long text is one task's work only
while it is signed or compared; of ties the smallest id leads a class; an empty
table gives no row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .graph import broadcast_if, components

_U = np.uint64
SHINGLE = 5
BANDS, ROWS = 24, 5
#: Documents and shingles in a block that is compared with another.
BLOCK, BLOCK_SHINGLES = 256, 200_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in each row, and for each different shingle of a row: row, hash, count; sorted by row and hash."""
    starts, ends, bounds = X.split(data, offsets, X.FOLDED)
    words = X.folded_hashes(data, starts, ends)
    n = np.diff(bounds)
    rows = X.row_of(bounds)
    grams = X.gram_hashes(words, SHINGLE)
    ok = np.arange(len(grams)) + SHINGLE <= bounds[1:][rows[: len(grams)]] if len(grams) else np.zeros(0, bool)
    row, value = rows[: len(grams)][ok], grams[ok]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = []
        for r in short:
            x = _U(n[r])
            for w in words[bounds[r] : bounds[r + 1]]:
                x = X.mix(np.array([x ^ w], _U))[0]
            whole.append(x)
        row, value = np.concatenate([row, short]), np.concatenate([value, np.array(whole, _U)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return n, row[at], value[at], np.diff(np.append(at, len(row)))


def _gap(seed: np.ndarray, step: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the step-th point of processes: exponential distances of rate 1, components, and 24 bits for the level."""
    a = X.mix(seed + step * _U(0x9E3779B97F4A7C15))
    b = X.mix(a ^ _U(0xD1B54A32D192ED03))
    return -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53), ((b >> _U(40)) * _U(size) >> _U(24)).astype(np.int64), b & _U(0xFFFFFF)


def _single_levels(low: np.ndarray, size: int, r: np.ndarray, seed: np.ndarray, x: np.ndarray) -> None:
    """Points of processes of one level each, from x on, until each has passed its row's largest component."""
    done, block = 1, 1
    while len(r):
        gap, component, _ = _gap(seed[:, None], (np.arange(done, done + block).astype(_U))[None, :], size)
        points = x[:, None] + np.cumsum(gap, 1)
        np.minimum.at(low, r[:, None] * size + component, points)
        x = points[:, -1]
        go = x < low.reshape(-1, size).max(1)[r]
        r, seed, x = r[go], seed[go], x[go]
        done += block
        block = min(64, block * 4) if len(r) * block * 4 < 4_000_000 else block


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, rows: int, size: int) -> np.ndarray:
    """rows x size smallest points; rows without shingles stay infinite."""
    low = np.full(rows * size, np.inf)

    def seed_of(value, first):
        return X.mix(value ^ (first.astype(_U) + _U(1)) * _U(0xC2B2AE3D27D4EB4F))

    _single_levels(low, size, row, seed_of(value, np.zeros(len(value), np.int64)), np.zeros(len(value)))
    # wide ranges (first, first + width]: the roots that a shingle's count reaches, then halves
    nodes, k = [], 1
    while len(more := np.flatnonzero(count > k)):
        nodes.append((row[more], value[more], count[more], np.full(len(more), k), np.full(len(more), k), np.zeros(len(more))))
        k *= 2
    while nodes:
        r, v, weight, first, width, x = (np.concatenate(c) for c in zip(*nodes, strict=True))
        one = width == 1
        _single_levels(low, size, r[one], seed_of(v[one], first[one]), x[one])
        r, v, weight, first, width, x = (c[~one] for c in (r, v, weight, first, width, x))
        gap, component, bits = _gap(seed_of(v ^ X.mix(width.astype(_U)), first), np.ones(len(r), _U), size)
        x = x + gap / width
        seen = first + 1 + (bits * width.astype(_U) >> _U(24)).astype(np.int64) <= weight
        np.minimum.at(low, (r * size + component)[seen], x[seen])
        go = x < low.reshape(rows, size).max(1)[r]
        half = width // 2
        nodes = [tuple(c[go & (lo < weight)] for c in (r, v, weight, lo, half, x)) for lo in (first, first + half)]
        nodes = [n for n in nodes if len(n[0])]
    return low.reshape(rows, size)


def _kind(docs: DataFrame) -> str:
    return dict(docs.dtypes)["d"]


def _sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(d, h, v, n, keys) of each row: id, hash of the text, a 128-bit hash of its words in order, its shingles and its band keys; v, n and keys are null where it has no words or no id."""

    def run(batches):
        for batch in batches:
            for r0, data, offsets in X.chunks(batch.column(1)):
                many = len(offsets) - 1
                ids = batch.column(0).slice(r0, many)
                starts, ends, bounds = X.split(data, offsets, X.FOLDED)
                words = X.folded_hashes(data, starts, ends)
                within = np.arange(len(words)) - bounds[:-1][X.row_of(bounds)]
                n, row, value, count = shingles(data, offsets)
                some = np.flatnonzero((n > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
                none = np.ones(many, bool)
                none[some] = False
                both = np.zeros((many, 2), _U)
                key = np.zeros((0, bands), _U)
                if len(some):
                    filled = np.flatnonzero(n)
                    for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB)):
                        terms = X.mix(words ^ (within.astype(_U) + _U(1)) * _U(salt))
                        both[filled, k] = X.mix(np.add.reduceat(terms, bounds[:-1][filled]) + _U(salt))
                    low = signatures(row, value, count, many, bands * rows)[some].view(_U).reshape(len(some), bands, rows)
                    key = np.broadcast_to(X.mix(np.arange(1, bands + 1).astype(_U) * _U(0x9E3779B97F4A7C15)), low.shape[:2]).copy()
                    for j in range(rows):
                        key = X.mix(key ^ low[:, :, j])
                at = np.concatenate([[0], np.cumsum(~none) * bands]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(at), pa.array(X.signed(np.ascontiguousarray(key).ravel())), mask=pa.array(none))
                v = pa.array([x.tobytes() for x in both], pa.binary(), mask=none)
                size = np.where(n >= SHINGLE, n - SHINGLE + 1, 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(r0, many), v, pa.array(size, mask=none), keys], names=["d", "h", "v", "n", "keys"])

    return docs.select("d", "text", "h").mapInArrow(run, f"d {_kind(docs)}, h long, v binary, n long, keys array<long>")


def _bags(texts: pa.Array):
    """(shingle hashes in order, counts) of each text."""
    for _, data, offsets in X.chunks(texts):
        _, row, value, count = shingles(data, offsets)
        cut = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield value[a:b], count[a:b]


def _near(own, other, threshold: float) -> bool:
    """Whether the multisets' overlap is threshold or more of their union."""
    n, m = int(own[1].sum()), int(other[1].sum())
    if min(n, m) < threshold * max(n, m):
        return False
    at = np.minimum(np.searchsorted(own[0], other[0]), len(own[0]) - 1)
    hit = own[0][at] == other[0]
    joint = int(np.minimum(own[1][at[hit]], other[1][hit]).sum())
    return joint >= threshold * (n + m - joint)


def _verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose exact multiset overlap is threshold or more. Two joins; that on a lead with many followers can be split."""

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tx = batch.column(2)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(tx.slice(1), tx.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            leads, own, keep = _bags(tx.take(pa.array(np.flatnonzero(new)))), None, []
            for first, other in zip(new.tolist(), _bags(batch.column(3)), strict=True):
                own = next(leads) if first else own
                keep.append(_near(own, other, threshold))
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    one, two = texts.select("d", "text").alias("one"), texts.select("d", "text").alias("two")
    met = one.join(pairs, F.col("one.d") == F.col("y")).select("x", "y", F.col("one.text").alias("ty"))
    met = two.join(met, F.col("two.d") == F.col("x")).select("x", "y", F.col("two.text").alias("tx"), "ty")
    return met.mapInArrow(compare, f"x {_kind(texts)}, y {_kind(texts)}")


def _rest_links(texts: DataFrame, rest: DataFrame, threshold: float) -> DataFrame:
    """(x, y), labels: links between members of a bucket that are in different classes; rest: key, d, n, label.

    A bucket's largest class needs no comparison within itself: the others are
    compared with all members, in blocks. Buckets of the same members are one. A
    block's texts meet in one task, and overlaps are counted through an inverted
    index of the block; pairs are never rows.
    """
    kind = _kind(texts)
    arrow = pa.int64() if kind == "bigint" else pa.string()
    mark = F.xxhash64("d")
    of_class = rest.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(mark).alias("h1"), F.sum(F.shiftrightunsigned(mark, 40)).alias("h2"))
    sizes = of_class.groupBy("key").agg(F.max(F.struct("c", "s", "label")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.bit_xor("h1").alias("h1"), F.sum("h2").alias("h2"))

    def blocks(c, s):
        return F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    sizes = sizes.groupBy("c", "s", "h1", "h2").agg(F.min(F.struct("key", "top")).alias("b"))
    sizes = X.checkpointed(sizes.select("b.key", F.col("b.top.label").alias("main"), blocks(F.col("c"), F.col("s")).alias("all_blocks"), blocks(F.col("c") - F.col("b.top.c"), F.col("s") - F.col("b.top.s")).alias("rest_blocks")))
    dealt = rest.join(broadcast_if(sizes), "key").withColumn("i", F.pmod(F.xxhash64("d"), "rest_blocks").cast("int")).withColumn("j", F.pmod(F.xxhash64(F.lit(1), "d"), "all_blocks").cast("int"))
    # a member of block j goes to the tasks (0..., j), one that asks and is of part i to (i, 0...); part and role: 0 member, 1 both, 2 asks
    asks, small = F.col("label") != F.col("main"), (F.col("all_blocks") == 1) & (F.col("rest_blocks") == 1)
    at = F.lit(0).cast("int")
    member = F.transform(F.sequence(at, F.col("rest_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j"), F.when(small & asks, 1).otherwise(0).alias("asks")))
    asking = F.when(asks & ~small, F.transform(F.sequence(at, F.col("all_blocks") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(2).alias("asks"))))
    sent = dealt.select("d", "key", "label", F.explode(F.concat(member, F.coalesce(asking, F.array().cast("array<struct<i:int,j:int,asks:int>>")))).alias("to")).select(F.col("d").alias("at"), "key", "to.*", "label")

    def compare(batches):
        at, block, index, up = None, [], None, {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        def ask(label, bag):
            """Labels of the block's members that bag is near, where they aren't of its class so far."""
            nonlocal index
            if not block:
                return
            if index is None:
                values = np.concatenate([v for _, v, _ in block])
                order = np.argsort(values)
                owner = np.repeat(np.arange(len(block)), [len(v) for _, v, _ in block])[order]
                index = values[order], owner, np.concatenate([c for _, _, c in block])[order], np.array([c.sum() for _, _, c in block])
            values, owner, counts, sizes = index
            a, b = np.searchsorted(values, bag[0], "left"), np.searchsorted(values, bag[0], "right")
            many = b - a
            to = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
            joint = np.bincount(owner[to], np.minimum(counts[to], np.repeat(bag[1], many)), len(sizes))
            for q in np.flatnonzero(joint >= threshold * (sizes + bag[1].sum() - joint)):
                p, o = root(label), root(block[q][0])
                if p != o:  # one link joins two classes in this task
                    up[p] = o
                    yield label, block[q][0]

        def late():
            """The members of the block that ask."""
            for label, value, count in [x[1:] for x in waiting]:
                yield from ask(label, (value, count))
            waiting.clear()

        waiting: list = []
        schema = pa.schema([("x", arrow), ("y", arrow)])
        for batch in batches:
            out = []
            keys, i, j, role, labels = (batch.column(c).to_pylist() for c in range(5))
            for here, r, label, bag in zip(zip(keys, i, j, strict=True), role, labels, _bags(batch.column(5)), strict=True):
                if here != at:
                    out += late()
                    at, block, index, up = here, [], None, {}
                if r < 2:
                    block.append((label, *bag))
                    if r == 1:
                        waiting.append((here, label, *bag))
                else:
                    out += ask(label, bag)
            yield pa.RecordBatch.from_pylist([{"x": x, "y": y} for x, y in out], schema)
        yield pa.RecordBatch.from_pylist([{"x": x, "y": y} for x, y in late()], schema)

    order = ["key", "i", "j"]
    with_text = sent.join(texts, F.col("at") == F.col("d")).select(*order, "asks", "label", "text")
    return with_text.repartition(X.scaled_partitions(texts.sparkSession), *order).sortWithinPartitions(*order, "asks").mapInArrow(compare, f"x {kind}, y {kind}").distinct()


def _labels(leads: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(v, label) of the texts that stars link, and (v, label) of those labels that further links join."""
    entries = leads.select("d", "n", F.explode("keys").alias("key"))
    buckets = X.checkpointed(entries.groupBy("key").agg(F.min("d").alias("lead"), F.count("*").alias("many")).where("many > 1").select("key", "lead"))
    members = X.checkpointed(entries.join(buckets, "key").select("key", "d", "n", "lead"))
    X.discard(buckets)
    # each document is compared with the one lead that it shares most buckets with
    likely = members.where("d != lead").groupBy(F.col("d").alias("y")).agg(F.mode("lead", True).alias("x"))
    links = X.checkpointed(_verified(texts, likely, threshold))
    found = components(links)
    X.discard(links)
    # what else meets in a bucket and is in different classes so far
    label = broadcast_if(found)
    placed = members.join(label.select(F.col("v").alias("d"), F.col("label").alias("own")), "d", "left").join(label.select(F.col("v").alias("lead"), F.col("label").alias("led")), "lead", "left")
    placed = placed.select("key", "d", "n", F.coalesce("own", "d").alias("label"), F.coalesce("led", "lead").alias("led"))
    mixed = X.checkpointed(placed.where("label != led").select("key").distinct())
    higher = None
    if not mixed.isEmpty():
        rest = X.checkpointed(placed.drop("led").join(broadcast_if(mixed), "key"))
        more = X.checkpointed(_rest_links(texts, rest, threshold))
        higher = components(more)
        X.discard(rest, more)
    X.discard(mixed, members)
    return found, higher


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(d, h, class_id) of each row: its id, the xxhash64 of its text and the smallest id of its class.

    Ids are integers or strings; ids of other types are taken as strings.
    """
    X.prepare(docs.sparkSession)
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    base = docs.select(F.col(id_col).cast("bigint" if whole else "string").alias("d"), F.col(text_col).cast("string").alias("text"))
    signed = X.checkpointed(_sign(base.withColumn("h", F.xxhash64("text")), bands, rows))
    # equal word sequences first: one stands for all of them
    leads = X.checkpointed(signed.where("v is not null").groupBy("v").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    found, higher = _labels(leads, base, threshold)
    placed = leads.select("v", "d").join(broadcast_if(found).select(F.col("v").alias("d"), "label"), "d", "left").select("v", F.coalesce("label", "d").alias("class_id"))
    if higher is not None:
        placed = placed.join(broadcast_if(higher).select(F.col("v").alias("class_id"), "label"), "class_id", "left").select("v", F.coalesce("label", "class_id").alias("class_id"))
    # written, so that the join deals out both sides and can split a class of many copies
    placed = X.checkpointed(placed)
    X.discard(leads, found, higher)
    return signed.select("d", "h", "v").join(placed, "v", "left").select("d", "h", F.coalesce("class_id", "d").alias("class_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each row of docs: its id, class_id (smallest id of the class; its own if alone) and kept."""
    found = classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    return found.select(F.col("d").alias("doc_id"), "class_id", F.coalesce(F.col("d") == F.col("class_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay: those of the smallest id of each class, and all rows with a null id.

    Of rows with an equal id and an equal text one stays, the first in the order
    of a hash of all columns; different texts of one id both stay.
    """
    gone_id, gone_h, h, every, n = X.fresh(docs, "_gone", "_gone_h", "_h", "_every", "_n")
    gone = classes(docs, id_col=id_col, text_col=text_col, threshold=threshold).where("d != class_id").select(F.col("d").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    left = known.join(gone, (F.col(id_col).cast(gone.schema[gone_id].dataType) == F.col(gone_id)) & (F.col(h) == F.col(gone_h)), "left_anti")
    plain = [c for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]
    order = Window.partitionBy(id_col, h).orderBy(every)
    left = left.withColumn(every, F.xxhash64(*plain)).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(h, every, n)
    return left.unionByName(docs.where(F.col(id_col).isNull()))
