import hashlib
import random

from weftline.llm import sharding as S


def brute(docs, limit):
    rows = [(d, t, len((t or "").encode()), int(hashlib.md5((str(d) if d is not None else t or "").encode()).hexdigest()[:15], 16)) for d, t in docs]
    out = []
    for d, _, n, k in rows:
        for depth in range(61):
            total = sum(m for _, _, m, j in rows if j >> (60 - depth) == k >> (60 - depth))
            if total <= limit or depth == 60:
                break
        out.append((d, bin(k >> (60 - depth))[2:].zfill(depth) if depth else "", depth, total))
    return sorted(out, key=str)


def test_equals_definition(spark):
    r = random.Random(2)
    docs = [(i, "é" * r.randint(0, 200)) for i in range(300)] + [(7, "again"), (None, "no id"), (None, None), (400, "x" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as shard_x", "2 as p")
    for limit in (1000, 20_000, 10**9):
        got = S.assign(df, max_bytes=limit)
        assert got.columns == [*df.columns, "shard", "shard_depth", "shard_bytes"]
        assert sorted(((x["doc_id"], x["shard"], x["shard_depth"], x["shard_bytes"]) for x in got.collect()), key=str) == brute(docs, limit)
    assert S.assign(df.limit(0), max_bytes=5).count() == 0


def test_deeper_than_the_roots(spark, monkeypatch):
    monkeypatch.setattr(S, "ROOT_BITS", 2)
    docs = [(i, "x" * 50) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.assign(df, max_bytes=120).collect()
    assert sorted(((x["doc_id"], x["shard"], x["shard_depth"], x["shard_bytes"]) for x in got), key=str) == brute(docs, 120)


def test_one_id_with_most_rows(spark):
    docs = [(7, "x" * 50)] * 300 + [(i, "x" * 50) for i in range(100, 130)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("shard_x", "SHARD")
    got = S.assign(df, max_bytes=120).collect()
    assert sorted(((x["doc_id"], x["shard"], x["shard_depth"], x["shard_bytes"]) for x in got), key=str) == brute(docs, 120)
