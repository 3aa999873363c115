import random

import numpy as np

from weftline.llm import mixing as M


def corpus():
    r = random.Random(1)
    pools = [[f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)], [f"c{i}" for i in range(80)]]
    docs, labels = [], []
    for d in range(900):
        k = r.choices((0, 1, 2), (6, 3, 1))[0]
        docs.append((d, " ".join(r.choice(pools[k]) for _ in range(r.randint(5, 60))), k))
        if d % 2:
            labels.append((d, k))
    return docs, labels


def test_expected_tokens_meet_targets(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in docs], "doc_id long, text string, _tokens string").withColumnRenamed("_tokens", "rate_")
    lab = spark.createDataFrame(labels, "doc_id long, domain int")
    weights = [0.3, 0.3, 0.4]
    got = M.mixed(df, lab, "domain", weights, apply=False).collect()
    tokens = np.array([r["n_tokens"] for r in got], float)
    post = np.array([r["posterior"] for r in got])
    rate = np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and len(got) == len(docs)
    truth = {d: k for d, _, k in docs}
    assert np.mean([p.argmax() == truth[r["doc_id"]] for p, r in zip(post, got, strict=True)]) > 0.98
    made = (rate * tokens) @ post
    assert np.abs(made / tokens.sum() - weights).max() < 0.01
    # the same problem solved by plain projected gradient on all rates at once
    r = np.ones(len(got))
    for _ in range(20_000):
        gap = ((r * tokens) @ post - np.array(weights) * tokens.sum()) / tokens.sum()
        r = np.maximum(0, r - (post @ gap + 1e-3 * (r - 1)) / 1.001)
    assert np.abs(((r * tokens) @ post - made) / tokens.sum()).max() < 0.01
    rows = M.mixed(df, lab, "domain", weights).collect()
    size = sum(len(x["text"].split()) for x in rows if truth[x["doc_id"]] == 2)
    assert abs(size / tokens.sum() - 0.4) < 0.06 and rows[0].__fields__ == df.columns


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, None)], "doc_id long, domain int")
    got = M.mixed(df, lab, "domain", [1.0, 1.0]).collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    assert M.mixed(df.limit(0), lab, "domain", [1.0, 1.0]).count() == 0
