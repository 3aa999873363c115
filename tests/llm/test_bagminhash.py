import random
import re
from collections import Counter

import numpy as np

from weftline.llm import bagminhash as B

FOLD = {c: c + 32 for c in range(65, 91)}


def bag(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(docs):
    ids = sorted({d for d, _ in docs if d is not None})
    bags = [(d, bag(t)) for d, t in docs if d is not None]
    up = {d: d for d in ids}

    def root(d):
        return d if up[d] == d else root(up[d])

    for i, (x, a) in enumerate(bags):
        for y, b in bags[:i]:
            if a and b and jaccard(a, b) >= 0.8:
                p, q = sorted((root(x), root(y)))
                up[q] = p
    return {d: root(d) for d in ids}


def corpus():
    r = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [r.choice(pool) for _ in range(r.choice([3, 5, 40, 120, 300]))]
        for c in range(r.choice([1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 3, 12])):
                w[r.randrange(len(w))] = r.choice(pool)
            docs.append((g * 10 + c, " ".join(w)))
    # a chain: each near the next, the ends far apart
    w = [f"c{i}" for i in range(300)]
    for k in range(8):
        docs.append((500 + k, " ".join(w)))
        w = w[12:] + [f"c{k}_{i}" for i in range(12)]
    return docs + [(900, None), (901, ""), (902, "!!"), (None, docs[0][1]), (903, docs[0][1].upper()), (0, docs[0][1]), (904, "tt " * 3000), (905, "tt " * 3100), (906, "tt " * 1000)]


def test_signature_is_unbiased():
    r = np.random.default_rng(0)
    items = r.integers(1, 2**63, 300).astype(np.uint64)
    a, b = r.integers(1, 12, 300), r.integers(1, 12, 300)
    rows = np.repeat([0, 1], 300)
    low = B.signatures(rows, np.concatenate([items, items]), np.concatenate([a, b]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((low[0] == low[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_classes_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    got = B.near_duplicates(df).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    left = B.without_near_duplicates(df.selectExpr("*", "'x' as label", "1 as d"), threshold=0.8).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(map(str, [*set(want.values()), None]))


def test_classes_in_small_blocks(spark, monkeypatch):
    """A cluster whose smallest member is near few of the others, and several classes in one bucket."""
    monkeypatch.setattr(B, "BLOCK", 4)
    r = random.Random(8)
    base, docs = [f"b{i}" for i in range(200)], []
    for k in range(60):
        w = list(base)
        for _ in range(r.choice([1, 2, 4, 5, 6, 8])):
            w[r.randrange(200)] = f"x{k}_{r.random()}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in B.near_duplicates(df).collect()}
    assert got == brute(docs)
    assert 1 < len(set(got.values())) < 60


def test_empty(spark):
    assert B.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_string_ids_and_clashing_columns(spark):
    docs = [(f"d{d:04}", t) for d, t in corpus() if d is not None]
    rows = [(d, t, "x", "y", 1, None) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id string, text string, h string, v string, keys int, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(df).collect()}
    assert got == brute(docs)
    left = B.without_near_duplicates(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {c for d, c in got.items() if d == c}


def test_rows_that_share_an_id(spark):
    r = random.Random(2)
    a, b, c = (" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(60)) for _ in range(3))
    near = b + " tail"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, near), (9, c), (9, c), (9, a)]
    got = sorted((x["doc_id"], x["class_id"]) for x in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 5), (9, 1), (9, 9), (9, 9)]
    left = sorted((x["doc_id"], x["text"]) for x in B.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted([(1, a), (5, b), (9, c)])


def test_long_texts(spark):
    r = random.Random(4)
    words = [r.choice("abcdefghij") * r.randint(1, 4) for _ in range(150_000)]
    other = list(words)
    other[70_000] = "edit"
    df = spark.createDataFrame([(2, " ".join(words)), (1, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted((x["doc_id"], x["class_id"]) for x in B.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_wide_ranges_are_split():
    """Counts of any size: agreement of two signatures is the weighted Jaccard similarity."""
    r = np.random.default_rng(7)
    items = r.integers(1, 2**63, 40).astype(np.uint64)
    for a, b in ((r.integers(1, 500, 40), r.integers(1, 500, 40)), (np.full(40, 64), np.full(40, 33)), (np.full(40, 1000), np.full(40, 999))):
        low = B.signatures(np.repeat([0, 1], 40), np.concatenate([items, items]), np.concatenate([a, b]), 2, 4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((low[0] == low[1]).mean() - want) < 4.5 * np.sqrt(want * (1 - want) / 4096 + 1e-6)
