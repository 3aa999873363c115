import numpy as np

from weftline.llm import itq


def brute(rows, threshold=0.98):
    use = [(i, l, np.array(e, float)) for i, l, e in rows if i is not None and l is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    n, up = {}, {i: i for i, *_ in rows}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, (i, l, x) in enumerate(use):
        for j, m, y in use[:a]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (n.get(i, 0), None if i is None else root(i)) for i, *_ in rows}


def data():
    r = np.random.default_rng(0)
    rows, i = [], 0
    for _ in range(40):
        base = r.normal(size=64)
        base /= np.linalg.norm(base)
        for c in range(r.integers(1, 7)):
            v = base + r.normal(size=64) * 0.009 * c
            rows.append((i, int(r.integers(0, 2)), [float(np.float32(x)) for x in v]))
            i += 1
    e = rows[3][2]
    rows += [(1000 + k, rows[3][1], e) for k in range(30)] + [(2000, None, e), (2001, 0, None), (2002, 0, [0.0] * 64), (2003, 0, [float("nan")] * 64), (2004, 0, [None] * 64), (2005, 0, [float("inf")] * 64), (2006, 0, []), (2007, rows[3][1], [x * 1e30 for x in e]), (2008, 0, [1.0, 2.0]), (2009, 0, [1.0, 2.0])]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = data()
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.links(df).collect()}
    assert len(got) == len(rows)
    missed = [i for i in want if got[i] != want[i]]
    assert not missed, [(i, got[i], want[i]) for i in missed]
    monkeypatch.setattr(itq, "BLOCK", 5)
    again = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.links(df).collect()}
    assert again == got


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, 1, None)], "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, itq.links(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert itq.links(df.limit(0)).count() == 0


def test_vectors_that_share_a_large_mean(spark):
    r = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    common, rows = unit(r.normal(size=64)), []
    for i in range(400):
        n = r.normal(size=64)
        x = unit(0.9**0.5 * common + 0.1**0.5 * unit(n - (n @ common) * common))
        o = r.normal(size=64)
        y = 0.981 * x + (1 - 0.981**2) ** 0.5 * unit(o - (o @ x) * x)
        rows += [(2 * i, i % 40, x.tolist()), (2 * i + 1, i % 40, y.tolist())]
    want = brute(rows)
    got = {q["vec_id"]: q["n_links"] for q in itq.links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    found, total = sum(got.values()), sum(n for n, _ in want.values())
    assert all(got[i] <= want[i][0] for i in want) and total >= 800
    assert found >= 0.93 * total, (found, total)


def test_rows_that_share_an_id(spark):
    r = np.random.default_rng(5)
    a, b = r.normal(size=(2, 64))
    near = b + 0.01 * r.normal(size=64)
    rows = [(1, 0, a.tolist()), (1, 0, b.tolist()), (2, 0, a.tolist()), (3, 0, near.tolist()), (None, 0, a.tolist())]
    got = sorted(map(str, ((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in itq.links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())))
    assert got == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True)]))


def test_recall_by_length(spark):
    """Pairs at the threshold are found whatever the vectors' length."""
    r = np.random.default_rng(9)
    for d in (8, 16, 32, 64):
        x = r.normal(size=(500, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = r.normal(size=(500, d))
        o -= (o * x).sum(1, keepdims=True) * x
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        y = 0.981 * x + (1 - 0.981**2) ** 0.5 * o
        rows = [(2 * i + k, i % 50, [float(c) for c in v[i]]) for i in range(500) for k, v in enumerate((x, y))]
        want = sum(n for n, _ in brute(rows).values())
        got = sum(q["n_links"] for q in itq.links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
        assert 0.93 * want <= got <= want, (d, got, want)
