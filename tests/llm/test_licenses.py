from weftline.llm import licenses as L
from weftline.llm.license_texts import TEMPLATES


def test_finds_all_templates_in_noise(spark):
    noise = "lorem ipsum under the dolor version of sit amet " * 30
    docs, want = [], []
    for k, (name, text) in enumerate(TEMPLATES.items()):
        docs.append((k, noise + "\n" + text.upper() + "\n" + noise))
        want.append((k, name))
    w = TEMPLATES["MIT"].split()
    edited = w[:20] + ["EXTRA", "WORDS"] + w[20:60] + w[64:]
    docs += [(100, noise), (101, None), (102, ""), (103, noise + " ".join(edited) + " x"), (104, " ".join(w[: len(w) // 2])), (105, (TEMPLATES["MIT line"] + " y ") * 2)]
    got = L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    exact = {(r["doc_id"], r["license"]) for r in got if r["coverage"] == 1.0}
    assert set(want) <= exact
    assert not [r for r in got if r["doc_id"] in (100, 101, 102, 104)]
    (near,) = [r for r in got if r["doc_id"] == 103]
    n = len(noise.split())
    assert near["license"] == "MIT" and 0.95 < near["coverage"] < 1 and near["first_word"] == n
    assert sorted(r["first_word"] for r in got if r["doc_id"] == 105) == [0, 6]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_winnowing_meets_any_five_words():
    import numpy as np

    from weftline.llm import textops as X

    r = np.random.default_rng(0)
    words = r.integers(0, 2**63, 400).astype(np.uint64)
    full = X.gram_hashes(words, L.GRAM)
    kept = set(full[L.winnowed(full, np.ones(len(full), bool))].tolist())
    for p in range(0, 390):
        part = X.gram_hashes(words[p : p + 5], L.GRAM)
        assert kept & set(part.tolist())


def brute(template, text, start, band):
    """The longest common subsequence whose pairs lie in the band, by the definition over the whole table."""
    best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i, w in enumerate(template):
        for j, x in enumerate(text):
            same = w == x and abs(j - start - i) <= band
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + same)
    return best[-1][-1]


def test_banded_alignment_equals_brute_force():
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        template = [r.randrange(6) for _ in range(r.randint(3, 30))]
        text = [r.randrange(6) for _ in range(r.randint(0, 5))] + [w for w in template if r.random() > 0.2 for w in ([w] if r.random() > 0.2 else [w, r.randrange(6)])] + [r.randrange(6) for _ in range(r.randint(0, 5))]
        index = L.Index({"x": "a b c"})
        index.words = [np.array(template, np.uint64)]
        start, band = r.randint(-2, 8), r.randint(1, 6)
        got = index._align(np.array(text, np.uint64), 0, start, band, 0, len(text))
        want = brute(template, text, start, band)
        assert (got[0] if got else 0) == want
        if got:
            assert 0 <= got[1] <= got[2] < len(text) and text[got[1]] in template and text[got[2]] in template


def test_repeated_and_long_rows(spark):
    long = "word " * 40_000 + TEMPLATES["Zlib"] + " word" * 40_000
    rows = [(1, TEMPLATES["MIT line"], "x")] * 2 + [(2, long, "y"), (None, TEMPLATES["CC0-1.0 line"], None)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((str(r["doc_id"]), r["license"], r["first_word"]) for r in got) == [("1", "MIT line", 0), ("1", "MIT line", 0), ("2", "Zlib", 40_000), ("None", "CC0-1.0 line", 0)]
