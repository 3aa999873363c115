import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from weftline.llm.queries import SHARD_BYTES


def bag(t):
    w = re.findall(r"[a-z0-9]+", t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r, d = random.Random(9), tmp_path_factory.mktemp("sf")
    pool = [f"w{i}" for i in range(900)]
    bench = [(i, " ".join(f"bench{i}x{j}" for j in range(20))) for i in range(5)]
    docs, labels, kind = [], [], {}
    for i in range(300):
        w = [r.choice(pool) for _ in range(r.randint(60, 120))]
        kind[i] = "toxic" if i % 10 == 1 else "leak" if i % 10 == 2 else "low" if i % 10 == 3 else "clean"
        if kind[i] == "toxic":
            for x in ("idiot", "moron", "scum"):
                w.insert(r.randrange(len(w)), x)
        if kind[i] == "leak":
            w[30:30] = bench[i % 5][1].split()
        if kind[i] == "low":
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(kind[i] != "low"), int(kind[i] == "toxic")))
    for i in range(300, 340):  # near copies of clean documents
        w = docs[(i - 300) * 5 % 300 // 10 * 10][1].split()
        w[r.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w), "en", "s", 0))
        kind[i] = "copy"
    docs.append((999, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, kind, bench


def test_stages_against_brute_force(spark, made):
    d, docs, kind, bench = made
    text = {i: t for i, t, *_ in docs}
    df = spark.read.parquet(f"{d}/documents.parquet")
    seen = [set(text)]
    for name, stage in P.STAGES:
        df = stage(spark, df, d).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, df, d)
        seen.append({r["doc_id"] for r in df.select("doc_id").collect()})
        if name == "benchmark decontamination":
            for r in df.collect():
                words = (r["text"] or "").split()
                assert not any(w.startswith("bench") for w in words)
                if kind.get(r["doc_id"]) == "clean":
                    assert r["text"] == text[r["doc_id"]]
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, near, leaks, mixed, shards = seen[1:]
    assert seen[0] - toxic == {i for i, k in kind.items() if k == "toxic"}
    up = {i: i for i in toxic}
    order = sorted(i for i in toxic if text[i])
    for a, i in enumerate(order):
        for j in order[:a]:
            x, y = bag(text[i]), bag(text[j])
            if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                up[i] = up[j]
                break
    assert near == {i for i in toxic if up[i] == i}
    assert leaks == near
    assert {i for i in leaks if kind.get(i) == "clean"} <= mixed <= leaks
    rows = df.collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += len((r["text"] or "").encode())
    assert shards == mixed and all(v <= SHARD_BYTES for v in size.values()) and {r["shard_bytes"] for r in rows} == set(size.values())


def test_run(spark, made):
    got = P.run(spark, made[0])
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "shard_depth", "shard_bytes"]
    assert {r["doc_id"] for r in got.collect()} <= {i for i, k in made[2].items() if k != "toxic"} | {999}


def test_stages_with_odd_rows_and_clashing_columns(spark, made):
    d = made[0]
    names = ["_h", "_n", "_gone", "_toxicity", "_tokens", "_posterior", "_row", "_rate", "_copies", "_one", "_key", "_root", "_list", "_own", "shard", "label", "d", "s", "a", "y", "id", "items", "spans", "toxicity"]
    rows = [(None, None), (None, "same text here"), (None, "same text here"), (1, None), (1, None), (2, ""), (3, "one"), (3, "one"), (4, "long " * 60_000), (5, "\u00e9\U0001f600 \u00a0 x" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(null as long) as n_chars", *(f"'x' as `{n}`" for n in names))
    for source in (df, df.limit(0)):
        for name, stage in P.STAGES:
            got = stage(spark, source, d)
            assert got.columns[: len(df.columns)] == df.columns or name == "sharding"
            n = got.count()
            assert n == source.count() or name in ("minhash near-dedup", "mixing")
            if name == "minhash near-dedup":
                assert n == (8 if source is df else 0)
            if name == "sharding":
                assert len(set(got.columns)) == len(got.columns)
