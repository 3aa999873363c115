import hashlib
import random
import re

import pytest

from weftline.llm import substrings as S


def brute(docs, k=13):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in split:
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if d is not None and (g not in first or d < first[g]):
                first[g] = d
    out = []
    for d, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if d is not None and first[tuple(w[p : p + k])] < d:
                gone |= set(range(p, p + k))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    pool = [f"w{i}é" for i in range(60)]
    passages = [[r.choice(pool) for _ in range(r.choice([12, 13, 14, 30, 80]))] for _ in range(6)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages) if r.random() < 0.6 else [r.choice(pool) for _ in range(r.randint(1, 40))]
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = "edit"
        docs.append((d, "".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in w)))
    docs += [(100 + i, docs[7][1]) for i in range(8)] + [(7, docs[9][1]), (7, docs[7][1]), (3, None), (None, docs[5][1]), (200, ""), (201, "same " * 500), (202, "same " * 700), (203, " nbsp  " * 20)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("hot", [2_000, 3])
def test_equals_brute_force(spark, hot):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.digest(S.removals(df, hot_docs=hot)).collect()), key=str) == brute(docs)


def test_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m y")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in S.deduplicated(S.removals(df)).collect()} == {1: "a b c d e f g h i j k l m n", 2: "x y"}
    assert S.digest(S.removals(df.limit(0))).count() == 0


def test_long_text_and_clashing_columns(spark):
    r = random.Random(9)
    words = [r.choice("abcdefghij") * r.randint(1, 6) for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, "x " + " ".join(words[20_000:50_000]) + " y"), (3, " ".join(words[10:22])), (4, "\t".join(words[30:60]))]
    rows = [(d, t, "z", 1, None, "q") for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, s int, d string, gone string")
    assert sorted(map(tuple, S.digest(S.removals(df)).collect()), key=str) == brute(docs)
