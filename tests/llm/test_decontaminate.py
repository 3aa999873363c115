import hashlib
import re

from weftline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, k=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - k + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if x := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    got |= x
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEM = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [
    (1, "x " + ITEM + " y"),
    (2, ITEM.upper().replace(" ", "--")),
    (3, " ".join(ITEM.split()[:9])),
    (4, None),
    (5, ""),
    (6, "SHORT  itém here, short itém"),
    (7, "zz " * 5000 + ITEM),
    (7, "zz " * 5000 + ITEM),
    (8, ITEM + " " + ITEM[6:] + " alpha alpha"),
    (None, ITEM),
]
ITEMS = [(1, ITEM), (10, ITEM[6:] + " nu"), (2, "short itém"), (3, None), (4, ""), (5, "alpha alpha")]


def test_scan_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumnsRenamed({})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    for shard_words in (D.SHARD_WORDS, 20):
        got = D.digest(D.scan(docs, items, shard_words=shard_words)).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["contaminated"] for r in D.digest(D.scan(docs, none)).collect())
    assert D.scan(docs.limit(0), none).count() == 0


def test_remove_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "aa bb " * 20 + ITEM + " cc", "e", 9), (2, ITEM, "e", 9), (3, "clean words", "e", 9)], "doc_id long, text string, items string, n_chars long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r for r in D.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3}
    assert got[1]["text"] == "aa bb " * 20 + " cc" and got[1]["n_chars"] == 123 and got[3]["n_chars"] == 9


def removed(text, items, max_coverage=0.5, k=10):
    """The text without its hit words and what lies between neighbouring ones; None if too many are hit."""
    at = [m.span() for m in WORD.finditer((text or "").translate(FOLD))]
    w, hit = words(text), set()
    for _, t in items:
        x = words(t)
        for q in range(max(1, len(x) - k + 1) if x else 0):
            win = x[q : q + k]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
    if len(hit) > max_coverage * len(w):
        return None
    out, end = "", 0
    for p in sorted(hit):
        out += text[end if p - 1 not in hit else at[p][0] : at[p][0]]
        end = at[p][1]
    return out + text[end:] if hit else text


def test_remove_in_shards_equals_brute_force(spark):
    w = [f"w{i}" for i in range(100)]
    items = [(i, " ".join(w[i * 5 : i * 5 + 10])) for i in range(12)] + [(100 + i, f"a{i} b{i} c{i}") for i in range(12)]
    docs = [(0, " ".join(f"f{i}" for i in range(60)) + " " + " ".join(w[:15]) + " end"), (1, " ".join(w[:65]) + " " + " ".join(f"g{i}" for i in range(80)))]
    # 6 of 10 words hit, by two items
    docs += [(10 + i * 12 + j, f"a{i} b{i} c{i} x y z u a{j} b{j} c{j}") for i in range(12) for j in range(12)]
    # the words left around a cut make another item
    docs += [(1000 + i * 12 + j, f"p q r s a{j} a{i} b{i} c{i} b{j} c{j} p q r s t") for i in range(12) for j in range(12)]
    docs += [(2000, "é " * 9 + "A0, b0; c0 - a1 b1 c1 ü tail more words here to keep it"), (2001, None), (2002, "")]
    want = {d: t for d, text in docs if (t := removed(text, items)) is not None or text is None}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), shard_words=20)
    assert got.columns == ["doc_id", "text"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert {r["doc_id"]: r["text"] for r in D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == want


def test_long_text_and_clashing_columns(spark):
    long = "pp qq " * 50_000 + ITEM + " rr" * 50_000
    rows = [(1, long, "x", "y", "z", "w"), (1, long, "x", "y", "z", "w"), (2, None, None, "y", "z", "w"), (3, "aa bb " * 20 + ITEM[6:] + " nu", "x", "y", "z", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k string, _hits string, k string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard_words in (D.SHARD_WORDS, 20):
        got = D.decontaminate(docs, items, shard_words=shard_words)
        assert got.columns == docs.columns
        texts = sorted((str(r["doc_id"]), (r["text"] or "").replace(" ", "")[:12], len(r["text"] or "")) for r in got.collect())
        assert texts == sorted([("1", "ppqqppqqppqq", len(long) - len(ITEM)), ("1", "ppqqppqqppqq", len(long) - len(ITEM)), ("2", "", 0), ("3", "aabbaabbaabb", 120)])
        found = sorted(map(tuple, D.digest(D.scan(docs, items, shard_words=shard_words)).collect()), key=str)
        assert found == brute([(r[0], r[1]) for r in rows], ITEMS)
