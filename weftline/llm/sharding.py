"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A row's key is 60 bits of a digest of its id. The directory starts with one
bucket; only a bucket whose bytes exceed the limit is split on its next bit,
until all fit. The sizes that this needs come from aggregates over key prefixes:
16 bits first, then some more at a time below the buckets that are still too
large. The directory is a table as well; rows get their bucket by a join with it
on the key's first bits, about as many as most buckets have. It is broadcast while it
is small; the driver sees the number of buckets of each depth only.

Defined cases: a null text has 0 bytes; a null id is replaced by the text for
the key; rows of one id, or a row above the limit, cannot be split and make a
shard of depth 60 at most that is over the limit; an empty table gives no rows;
columns shard, shard_depth and shard_bytes that are there already are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .graph import broadcast_if

KEY_BITS, ROOT_BITS, STEP_BITS = 60, 16, 4


def key_of(id_col: str, text_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(key: str, bits: int) -> Column:
    return F.shiftright(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(p, d, b): prefix, depth and bytes of each bucket with rows; sized has _key and _bytes."""
    leaves, depth, step, open_ = None, 0, ROOT_BITS, None
    while True:
        low = sized if open_ is None else sized.withColumn("_up", _prefix("_key", depth)).join(broadcast_if(open_), "_up", "left_semi")
        fine = low.groupBy(_prefix("_key", depth + step).alias("p")).agg(F.sum("_bytes").alias("b"))
        sizes = fine.select("p", "b", F.explode(F.sequence(F.lit(0), F.lit(step))).alias("up")).groupBy((F.lit(depth + step) - F.col("up")).alias("d"), F.expr("shiftright(p, up)").alias("p")).agg(F.sum("b").alias("b"))
        sizes = X.checkpointed(sizes)
        fit = sizes.where((F.col("b") <= limit) | (F.col("d") == KEY_BITS))
        inside = fit.where(F.col("b") <= limit).select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("p"))
        found = X.checkpointed(fit.join(inside, ["d", "p"], "left_anti").select("p", "d", "b"))
        leaves = found if leaves is None else leaves.unionByName(found)
        depth += step
        more = sizes.where((F.col("d") == depth) & (F.col("b") > limit) & (F.col("d") < KEY_BITS)) if depth < KEY_BITS else sizes.limit(0)
        open_ = X.checkpointed(more.select(F.col("p").alias("_up"), "b"))
        X.discard(sizes)
        mean = open_.agg(F.avg("b")).first()[0]
        if mean is None:
            return X.checkpointed(leaves)
        open_ = open_.select("_up")
        step = min(KEY_BITS - depth, max(STEP_BITS, math.ceil(math.log2(mean / max(1, limit))) + 1))


def assign(docs: DataFrame, *, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard (the bucket's bits), shard_depth and shard_bytes; no shuffle of the rows while the directory is small."""
    key, root, listing, mine = X.fresh(docs, "_key", "_root", "_list", "_own")
    sized = docs.select(key_of(id_col, text_col).alias("_key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    buckets = directory(sized, max_bytes)
    # shallower buckets than the common depth are listed under each of their extensions: it stays such that these are few
    many, common = {r["d"]: r["n"] for r in buckets.groupBy("d").agg(F.count("*").alias("n")).collect()}, 0
    total = sum(many.values())
    while sum(n for d, n in many.items() if d > common) * 2 > total and sum(n << max(0, common + 1 - d) for d, n in many.items()) <= 4 * total + 4096:
        common += 1
    wide = F.expr(f"case when d >= {common} then array(shiftright(p, d - {common})) else sequence(shiftleft(p, {common} - d), shiftleft(p + 1, {common} - d) - 1) end")
    listed = buckets.withColumn(root, F.explode(wide)).groupBy(root).agg(F.collect_list(F.struct("p", "d", "b")).alias(listing))
    keyed = docs.withColumn(key, key_of(id_col, text_col)).withColumn(root, _prefix(key, common))
    found = keyed.join(broadcast_if(X.checkpointed(listed)), root, "left").withColumn(mine, F.expr(f"filter({listing}, e -> shiftright({key}, {KEY_BITS} - e.d) = e.p)[0]"))
    X.discard(buckets)
    own = F.col(mine)
    bits = F.when(own["d"] == 0, F.lit("")).otherwise(F.expr(f"lpad(bin({mine}.p), {mine}.d, '0')"))
    keep = [c for c in docs.columns if c.lower() not in ("shard", "shard_depth", "shard_bytes")]
    return found.select(*keep, bits.alias("shard"), own["d"].alias("shard_depth"), own["b"].alias("shard_bytes"))


#: The same by the definition: a row's depth is the least at which all that shares its prefix fits.
SQL = """
WITH k AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS key FROM documents),
d AS (SELECT unnest(range(0, 61)) AS depth),
s AS (SELECT depth, key // (1::BIGINT << (60 - depth)) AS p, sum(n)::BIGINT AS b FROM k, d GROUP BY ALL),
f AS (SELECT k.doc_id, k.n, min(s.depth) AS depth FROM k, d JOIN s ON s.depth = d.depth AND s.p = k.key // (1::BIGINT << (60 - d.depth)) WHERE s.b <= {limit} OR s.depth = 60 GROUP BY ALL)
SELECT f.doc_id, f.n AS n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(s.p), f.depth::INT, '0') END AS shard, f.depth::INT AS shard_depth, s.b AS shard_bytes
FROM f JOIN k ON k.doc_id = f.doc_id JOIN s ON s.depth = f.depth AND s.p = k.key // (1::BIGINT << (60 - f.depth))
"""
