import random
import zlib

import numpy as np
import pytest

from weftline.llm import nbsvm, toxicity
from weftline.llm.labelled import fit_logistic, sigmoid


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def quality_corpus(n=500):
    r = random.Random(4)
    pool = [f"{r.choice('abcd')}{i}" for i in range(300)]
    docs, labels = [], []
    for d in range(n):
        w = [r.choice(pool) for _ in range(r.randint(10, 80))]
        good = r.random() < 0.7
        if not good:
            kind = r.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + r.choice(("$$$", "***")) for x in w] if kind == 1 else [w[0]] * len(w)
        docs.append((d, " ".join(w)))
        labels.append((d, int(good), 0))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_corpus()
    extra = [(9001, None), (9002, ""), (None, "text"), (3, docs[3][1]), (9003, "word " * 50_000)]
    df, lab = spark.createDataFrame(docs + extra, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = nbsvm.digest(df, lab).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {d: q for d, q, _ in labels}
    out = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 60 and np.mean(out) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and (r["doc_id"] is None or r["held_out"] == held(r["doc_id"])) for r in got)
    assert all(s["score"] == t["score"] for s in got for t in got if s["doc_id"] in (9001, 9002) and t["doc_id"] in (9001, 9002))


def test_held_out_labels_are_never_used(spark):
    docs, labels = quality_corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(d, 1 - q if held(d) else q, 1 if held(d) else 0) for d, q, _ in labels]
    for f in (nbsvm.digest, toxicity.digest):
        a, b = ({r["doc_id"]: r["score"] for r in f(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
        assert a == b


def test_without_labels(spark):
    df, none = spark.createDataFrame([(1, "you idiot, what a moron"), (2, "a fine day")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in nbsvm.digest(df, none).collect()} == {0.5}
    assert {r["doc_id"]: r["predicted"] for r in toxicity.digest(df, none).collect()} == {1: 1, 2: 0}


def test_dual_descent_separates():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 40, 6) + (40 if k % 2 else 0)) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    w = nbsvm.descend(rows, y, np.ones(80), cost=1.0)
    assert all(np.sign(w[x].sum()) == t for x, t in zip(rows, y, strict=True))
    hinge = np.maximum(0, 1 - y * [w[x].sum() for x in rows]).sum() + 0.5 * w @ w
    for _ in range(50):  # no small step improves the objective much
        v = w + r.normal(0, 0.01, 80)
        assert np.maximum(0, 1 - y * [v[x].sum() for x in rows]).sum() + 0.5 * v @ v > hinge - 1e-2


def test_logistic_recovers_a_curve():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 1))
    y = (r.random(4000) < sigmoid(2 * x[:, 0] - 1)).astype(float)
    assert fit_logistic(x, y) == pytest.approx([2, -1], abs=0.25)


def test_folding():
    assert toxicity.fold("Ïd1ÖT! m0rоn, $cum l@me") == " idiot moron scum lame "
    assert toxicity.fold("price$$$ a@b $5") == " price ab 5 ".replace(" 5 ", " s ") or toxicity.fold("price$$$") == " price "
    assert toxicity.fold("") == " " and toxicity.fold("ΙDІОТ") == " idiot "


def test_each_lookalike_folds_to_its_letter():
    import unicodedata

    for sign, letter in toxicity.LOOKALIKES.items():
        assert toxicity.fold(f"x{sign}x") == f" x{letter}x ", (sign, unicodedata.name(sign))
    assert toxicity.fold("m\u03bfr\u03bfn idi\u03bft \u0455cum") == " moron idiot scum "


def test_a_column_of_the_scores_name_is_replaced(spark):
    df, none = spark.createDataFrame([(1, "you idiot, what a moron", "x"), (2, "a fine day", None)], "doc_id long, text string, Toxicity string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(df, toxicity.learn(df, none))
    assert got.columns == ["doc_id", "text", "toxicity"] and [r["toxicity"] >= 0.5 for r in got.collect()] == [True, False]
    model = (np.zeros(1 << nbsvm.BITS), [1.0, 0.0])
    for m in (None, model):
        got = nbsvm.scored(df.withColumnRenamed("Toxicity", "quality_score"), m)
        assert got.columns == ["doc_id", "text", "quality_score"] and {r["quality_score"] for r in got.collect()} == {0.5}
    assert toxicity.digest(df.limit(0), none).count() == nbsvm.digest(df.limit(0), none).count() == 0


def test_many_exceptions_in_a_long_text():
    import time

    lex = toxicity.Lexicon({" trash ": 3.0}, ["trash can"])
    began = time.time()
    assert np.expm1(lex.features("the trash can and " * 50_000)[0]) == pytest.approx(0)
    assert np.expm1(lex.features("the trash can and " * 50_000 + "trash")[0]) == pytest.approx(3)
    assert time.time() - began < 20


def test_lexicon_counts_and_exceptions():
    lex = toxicity.Lexicon({" trash ": 3.0, " clown ": 3.0, " clow": 1.0, " idio": 2.0}, ["trash can", "class clown"])
    total = lambda t: np.expm1(lex.features(t)[0])
    assert total("trash") == pytest.approx(3) and total("the trash can is full") == pytest.approx(0)
    assert total("clown clown clowns") == pytest.approx(3 * (1 + np.log(2)) + 1) and total("class clown") == pytest.approx(0)
    assert total("1d10t") == pytest.approx(2) and total("antitrash") == pytest.approx(0) and total(None) == 0
    assert lex.features("trash")[1] > lex.features("trash " + "word " * 500)[1]


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(6)
    pool, bad = [f"w{i}" for i in range(400)], ["idiot", "moron", "zzkro", "zzkrox", "qwump"]
    docs, labels = [], []
    for d in range(600):
        w, toxic = [r.choice(pool) for _ in range(r.randint(5, 60))], r.random() < 0.25
        for _ in range(r.randint(2, 4) if toxic else 0):
            x = r.choice(bad)
            w.insert(r.randrange(len(w)), x.replace("o", "0") if r.random() < 0.3 else x.upper() if r.random() < 0.2 else x)
        docs.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.digest(df, lab).collect()
    out = [r_["predicted"] == labels[r_["doc_id"]][2] for r_ in got if r_["held_out"]]
    assert np.mean(out) > 0.97
    kept = toxicity.without_toxic(df.selectExpr("*", "'a' as toxicity"), lab)
    assert kept.columns == ["doc_id", "text", "toxicity"] and abs(kept.count() - sum(not t for *_, t in labels)) < 15
