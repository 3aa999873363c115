import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import columns, keys, mapping, profile, provenance, quality, setbased, storage, tables
from weftline.plans import table_search

LONG = "table_name string, group_id int, col string, col_pos int, dtype string, row_id long, value string"


def long(spark, tables_):
    """tables_: {name: (group, {col: (dtype, [values])})}"""
    rows = [(t, g, c, p, k, i, v) for t, (g, cols) in tables_.items() for p, (c, (k, vals)) in enumerate(cols.items()) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, LONG)


def brute_pairs(a, b):
    out = {}
    for (ta, (_, ca)), (tb, (_, cb)) in itertools.product(a.items(), b.items()):
        for (x, (kx, vx)), (y, (ky, vy)) in itertools.product(ca.items(), cb.items()):
            sx, sy = ({v for v in s if v is not None} for s in (vx, vy))
            if kx == ky and sx & sy and "index" not in x + y:
                out[ta, x, tb, y] = len(sx & sy) / len(sx | sy)
    return out


def brute_greedy(pairs, least=0.0):
    out = {}
    for ta, tb in {(a, b) for a, _, b, _ in pairs}:
        used_a, used_b = set(), set()
        for s, x, y in sorted(((-s, x, y) for (a, x, b, y), s in pairs.items() if (a, b) == (ta, tb) and s >= least)):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                out[ta, x, tb, y] = -s
    return out


A = {"A": (1, {"a": ("int64", ["1", "2"]), "b": ("object", ["x", "y"])})}
B = {"B": (2, {"c": ("int64", ["1", "2", "3"]), "d": ("object", ["x"]), "e": ("float64", ["1", "2"])})}


def test_table_similarity_literal(spark):
    got = tables.table_similarity(long(spark, A), long(spark, B)).first()
    assert got["sim"] == pytest.approx(0.388889, abs=1e-6) and got["n_mapped"] == 2


def made(seed, n=4):
    r = random.Random(seed)
    return {f"t{i}": (i // 2, {f"{'index' if k == 3 else 'c'}{k}": (r.choice(("int64", "object")), [r.choice([None, *"abcdefgh"]) for _ in range(12)]) for k in range(5)}) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_mapping_equals_brute_force(spark, seed):
    t = made(seed)
    v = long(spark, t)
    pairs = brute_pairs(t, t)
    got = {(r["a_table_name"], r["a_col"], r["b_table_name"], r["b_col"]): r["sim"] for r in mapping.column_pairs(v, v).collect()}
    assert got == pytest.approx(pairs)
    got = {(r["a_table_name"], r["a_col"], r["b_table_name"], r["b_col"]): r["sim"] for r in mapping.map_tables(v, v).collect()}
    assert got == pytest.approx(brute_greedy(pairs, 0.3))
    sums = {}
    for (a, _, b, _), s in brute_greedy(pairs).items():
        sums[a, b] = sums.get((a, b), 0) + s / 5
    assert {(r["a_table_name"], r["b_table_name"]): r["sim"] for r in tables.table_similarity(v, v).collect()} == pytest.approx(sums)


def test_extend_mapping_leaves_known_pairs(spark):
    a, b = long(spark, A), long(spark, B)
    known = spark.createDataFrame([("A", "B", "b", "d", 0.5)], "a_table_name string, b_table_name string, a_col string, b_col string, sim double")
    got = {(r["a_col"], r["b_col"]) for r in mapping.extend_mapping(known, a, b).collect()}
    assert got == {("b", "d"), ("a", "c")}


def test_groups_and_schema_elements(spark):
    t = {"t1": (1, {"k": ("int64", ["1", "2"])}), "t2": (1, {"k": ("int64", ["2", "3"]), "m": ("object", ["q"])}), "u": (2, {"z": ("int64", ["9"])})}
    v = long(spark, t)
    idx = {(r["group_id"], r["col"]): (r["sid"], r["n_tables"], r["n_distinct"]) for r in profile.schema_index(v).collect()}
    assert idx == {(1, "k"): (1, 2, 3), (1, "m"): (2, 1, 1), (2, "z"): (1, 1, 1)}
    q = long(spark, {"q": (0, {"x": ("int64", ["1", "2", "3"])})})
    assert [(r["b_group_id"], r["best"]) for r in mapping.matching_groups(q, profile.schema_values(v)).collect()] == [(1, 1.0)]
    same = mapping.mapping_by_schema(v.where("table_name = 't1'"), v.where("table_name = 't2'"), profile.schema_index(v)).first()
    assert (same["a_col"], same["b_col"], same["sid"]) == ("k", "k", 1)
    both = mapping.join_mapping(mapping.column_pairs(q, v, least=0.9), mapping.column_pairs(q, v))
    assert {(r["b_table_name"], r["b_col"]) for r in both.collect()} == {("t1", "k"), ("t2", "k")}


def test_sketches(spark):
    v = long(spark, {"t": (1, {f"c{k}": ("float64" if k == 0 else "object", [str(i % (k + 1)) for i in range(10)]) for k in range(8)})})
    got = profile.sketch_columns(profile.column_profile(v), 3).orderBy("rank").collect()
    assert [r["col"] for r in got] == ["c7", "c6", "c5"]
    few = profile.sketch_values(v, ["table_name"], 2)
    assert few.groupBy("col").count().agg(F.max("count")).first()[0] == 2
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, profile.sketch_values(v.repartition(5), ["table_name"], 2).collect()))


def test_sizes_and_identity(spark):
    v = long(spark, {"t": (1, {"i": ("int64", ["1", "1", None]), "s": ("object", ["ab", "ab", "c"]), "f": ("float64", ["1", None, None])}), "u": (1, {"i": ("int64", [None, "1", "1"]), "s": ("object", ["c", "ab", "ab"]), "f": ("float64", [None, "1", None])}), "w": (1, {"i": ("int64", ["1"])})})
    assert {r["table_name"]: r["n_bytes"] for r in profile.table_sizes(v).collect()} == {"t": 21, "u": 21, "w": 4}
    assert {r["table_name"]: r["n_bytes"] for r in profile.table_sizes(v, distinct=True).collect()} == {"t": 15, "u": 15, "w": 4}
    ids = {r["table_name"]: r["same_as"] for r in profile.content_ids(v).collect()}
    assert ids == {"t": "t", "u": "t", "w": "w"}
    ranked = spark.createDataFrame([("t", 1.0), ("u", 2.0), ("w", 0.5)], "table_name string, score double")
    assert [r["table_name"] for r in tables.drop_same_content(ranked, profile.content_ids(v), 5).collect()] == ["u", "w"]


def test_key_scores(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (3, "z")], "k int, v string")
    assert keys.key_score(a, b, "k", ["v"]).first()["score"] == 0.75
    twice = a.unionAll(a)
    assert keys.key_score(twice, b, "k", ["v"]).first()["score"] == 0.0
    assert keys.join_key_score(a, twice, "k").first()["score"] == 1.0
    assert keys.join_key_score(twice, twice, "k", prune=0.1).first()["score"] == 0.5
    best = keys.best_key(spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.7)], "t string, key string, score double"), ["t"]).first()
    assert best["key"] == "b"


def test_column_similarity_literal(spark):
    got = spark.range(1).select(tables.col_similarity(F.lit(2), F.lit(3), F.lit(3), F.lit(0.75)).alias("x")).first()["x"]
    assert got == pytest.approx(0.4375)
    one = spark.createDataFrame([("a",), (None,)], "v string")
    assert tables.row_similarity(one, one.limit(0)).first()["sim"] == 0 and tables.row_similarity(one.limit(0), one.limit(0)).first()["sim"] == 0
    assert tables.row_similarity(one, spark.createDataFrame([("a",), ("b",)], "v string")).first()["sim"] == 0.5


def test_search_orders_by_score(spark):
    t = made(3, 6)
    v = long(spark, t)
    got = table_search.similar(v.where("table_name = 't0'"), v, k=3).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and all(r["b_table_name"] != "t0" for r in got)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def brute_parts(t, name, join, prune):
    """By definition: of each table with mapped columns (mapped, key, key score, row similarity)."""
    mapped = brute_greedy(brute_pairs({name: t[name]}, {k: x for k, x in t.items() if k != name}), 0.3)
    out = {}
    for b in {k[2] for k in mapped}:
        own = {k[1]: (k[3], s) for k, s in mapped.items() if k[2] == b}
        cols_a, cols_b = t[name][1], t[b][1]
        rows_a = list(zip(*(cols_a[x][1] for x in own), strict=True))
        rows_b = list(zip(*(cols_b[own[x][0]][1] for x in own), strict=True))
        scores = []
        for i, x in enumerate(own):
            ka, kb = {r[i] for r in rows_a}, {r[i] for r in rows_b}
            least, n = min(len(ka) / len(rows_a), len(kb) / len(rows_b)), len(rows_a) + len(rows_b)
            if join:
                of = [len({r for r in rows_a + rows_b if r[i] in k}) / n for k in (ka, kb)]
                s = 1.0 if len(ka) == len(rows_a) or len(kb) == len(rows_b) else 0.0 if least < prune else max(of)
            else:
                s = 0.0 if least <= prune else len(set(rows_a + rows_b)) / n
            scores.append((-s, -own[x][1], x))
        s, sim, key = min(scores)
        out[b] = (len(own), key, -s, -sim)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_search_equals_brute_force(spark, seed):
    t = made(seed, 6)
    v = long(spark, t)
    q = v.where("table_name = 't0'")
    for prune in (0.3, 0.6) if seed == 3 else (0.9,):
        parts = brute_parts(t, "t0", False, prune)
        want = {b: 0.1 * (1 + (n - 1) * s) / (10 - n) + 0.9 * sim for b, (n, _, s, sim) in parts.items()}
        got = table_search.similar(q, v, k=3, prune=prune).collect()
        top = sorted(want, key=lambda b: (-round(want[b], 12), b))[:3]
        assert [(r["b_table_name"], r["key"]) for r in got] == [(b, parts[b][1]) for b in top] and [r["score"] for r in got] == pytest.approx([want[b] for b in top])
        parts = brute_parts(t, "t0", True, prune)
        want = {b: 0.1 * (1 + 4 * s) / (9 - n) + 0.9 * sim for b, (n, _, s, sim) in parts.items()}
        got = {r["b_table_name"]: r["score"] for r in table_search.joinable(q, v, k=9, prune=prune).collect()}
        assert got == pytest.approx(want)
        assert table_search.one_pair(q, v.where("table_name = 't1'"), prune=prune) == pytest.approx({b: 0.1 * (1 + (n - 1) * s) / (10 - n) + 0.9 * sim for b, (n, _, s, sim) in brute_parts(t, "t0", False, prune).items()}.get("t1", 0.0))
    far = spark.createDataFrame([(b, float(i)) for i, b in enumerate(t)], "b_table_name string, distance double")
    distance = {b: float(i) for i, b in enumerate(t)}
    parts = brute_parts(t, "t0", False, 0.9)
    want = {b: 90 * (1 + (n - 1) * s) / (10 - n) + 200 * sim + 0.1 * distance[b] for b, (n, _, s, sim) in parts.items()}
    assert {r["b_table_name"]: r["score"] for r in table_search.by_mode(3, q, v, far).collect()} == pytest.approx(want)
    want = {b: 0.5 * n / (10 - n) + 0.5 / (distance[b] + 1) for b, (n, *_) in parts.items()}
    assert {r["b_table_name"]: r["score"] for r in table_search.by_mode(1, q, v, far).collect()} == pytest.approx(want)
    assert table_search.by_mode(2, q, v).count() == len(parts)


def test_key_literal(spark):
    a, b = long(spark, {"A": (1, {"k": ("int64", ["1", "2"]), "v": ("object", ["x", "y"])})}), long(spark, {"B": (1, {"k": ("int64", ["1", "3"]), "v": ("object", ["x", "z"])})})
    mapped = spark.createDataFrame([("A", "B", "k", "k"), ("A", "B", "v", "v")], "a_table_name string, b_table_name string, a_col string, b_col string")
    assert {r["a_col"]: r["score"] for r in keys.pair_keys(a, b, mapped).collect()} == {"k": 0.75, "v": 0.75}
    twice = b.unionByName(b.withColumn("row_id", F.col("row_id") + 10))
    both = a.unionByName(a.withColumn("row_id", F.col("row_id") + 10))
    assert {r["score"] for r in keys.pair_keys(both, twice, mapped, join=True, prune=0.1).collect()} == {0.25}
    assert {r["score"] for r in keys.pair_keys(both, twice, mapped, join=True, prune=0.6).collect()} == {0.0}
    assert {r["score"] for r in keys.pair_keys(a, twice, mapped, join=True).collect()} == {1.0}


def test_cells_of_a_row_share_its_number(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "a")], "k int, v string")
    v = columns.long_form(one, "one", 1).unionByName(columns.long_form(two, "two", 1)).unionByName(columns.long_form(one.orderBy(F.desc("k")), "again", 1))
    assert v.groupBy("table_name", "row_id").count().where("count != 2").isEmpty()
    ids = {r["table_name"]: r["same_as"] for r in profile.content_ids(v).collect()}
    assert ids == {"one": "again", "again": "again", "two": "two"}


def test_extend_mapping_through_schema_elements(spark):
    a = long(spark, {"q": (0, {"x": ("int64", ["1", "2"]), "y": ("object", ["u"]), "z": ("object", ["p", "q"])})})
    b = long(spark, {"t": (1, {"k": ("int64", ["8", "9"]), "m": ("object", ["u"]), "o": ("object", ["p", "q"])}), "s": (1, {"k": ("int64", ["1", "2"]), "w": ("float64", ["1"])})})
    to_group = spark.createDataFrame([("q", 1, "x", "k"), ("q", 1, "y", "w")], "a_table_name string, group_id int, a_col string, group_col string")
    known = spark.createDataFrame([("q", "t", "z", "o", 1.0)], "a_table_name string, b_table_name string, a_col string, b_col string, sim double")
    got = {(r["b_table_name"], r["a_col"], r["b_col"], r["sim"]) for r in mapping.extend_mapping(known, a, b, to_group=to_group, index=profile.schema_index(b)).collect()}
    assert got == {("t", "z", "o", 1.0), ("t", "x", "k", 0.0), ("t", "y", "m", 1.0), ("s", "x", "k", 1.0)}


def test_matching_groups_ignores_dtypes(spark):
    q = long(spark, {"q": (0, {"x": ("object", ["1", "2"])})})
    s = profile.schema_values(long(spark, {"t": (7, {"k": ("int64", ["1", "2"])})}))
    assert [(r["b_group_id"], r["best"]) for r in mapping.matching_groups(q, s).collect()] == [(7, 1.0)]


def test_star_distance_literal(spark):
    s = spark.createDataFrame([("x", "n", "+a"), ("x", "n", "+a"), ("x", "n", "-b"), ("y", "m", "+a"), ("y", "m", "-b")], "graph_id string, node string, label string")
    assert provenance.star_distances(s.where("graph_id = 'x'"), s.where("graph_id = 'y'")).first()["distance"] == 2
    assert provenance.mapping_distance(s, s).where("a_id = b_id").agg(F.sum("distance")).first()[0] == 0
    assert provenance.nearest(s.where("graph_id = 'x'"), s, 1).first()["b_id"] == "x"


def test_flow_similarity(spark):
    code = "a = f(b)\nc = a + 1"
    assert provenance.flow_similarity(code, code) == 1.0
    assert provenance.flow_similarity(code, "") == 0.0 and provenance.flow_similarity(None, code) == 0.0
    assert 0 < provenance.flow_similarity(code, "a = f(b)\nc = a * 1") < 1
    df = spark.createDataFrame([(code, code), (code, "x")], "p string, q string")
    assert [r["flow_sim"] for r in provenance.flow_similarities(df, "p", "q").collect()] == [1.0, 0.0]


def test_deadline_gives_none():
    edges = [(f"var_a{i}_1", f"var_b{i}_2", "x") for i in range(9)]
    assert provenance.edit_distance(edges, edges[::-1] + [("var_z_1", "var_q_2", "y")], deadline=-1) is None


def test_previous_definition(spark):
    uses = spark.createDataFrame([("n", 3, "v"), ("n", 1, "v"), ("n", 5, "w")], "nb_name string, cell_id int, var string")
    defs = spark.createDataFrame([("n", 1, "v"), ("n", 2, "v"), ("n", 3, "v")], "nb_name string, cell_id int, var string")
    assert {(r["cell_id"], r["def_cell"]) for r in provenance.previous_definition(uses, defs).collect()} == {(3, 2), (1, None), (5, None)}


def test_storage(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    r = storage.union_rows(a, b).first()
    assert (r["a_in_b"], r["b_in_a"]) == (False, False)
    assert storage.union_rows(a.distinct(), b).first()["a_in_b"] and storage.key_selectivity(a, b, "k").first()["n_joined"] == 3
    c = spark.createDataFrame([("t", 5.0, 3.0, None, 3.0)], "t string, separate double, lineage double, join double, union double")
    assert storage.choose(c, ["t"]).first()["strategy"] == "lineage"
    p = spark.createDataFrame([("t", "b", 2.0), ("t", "a", 2.0), ("t", "c", -1.0)], "t string, partner string, benefit double")
    assert storage.best_partner(p, ["t"]).first()["partner"] == "a"


def test_set_based_scores(spark):
    pairs = spark.createDataFrame([("n", "q1", "d1", 0.9), ("n", "q1", "d2", 0.8), ("n", "q2", "d1", 0.7), ("m", "q1", "d1", 0.5)], "nb_name string, q string, d string, sim double")
    assert {r["nb_name"]: r["code_sim"] for r in setbased.greedy_cells(pairs).collect()} == pytest.approx({"n": 0.9, "m": 0.5})
    assert {r["nb_name"]: r["code_sim"] for r in setbased.best_cells(pairs, 2).collect()} == pytest.approx({"n": 0.8, "m": 0.25})
    assert {r["nb_name"]: r["data_sim"] for r in setbased.table_assignment(pairs, 2).collect()} == pytest.approx({"n": 0.9, "m": 0.0})
    cells = spark.createDataFrame([("n", 2, "b = 2 # c\n# only"), ("n", 1, "a = 1")], "nb_name string, cell_id int, cell_code string")
    assert setbased.whole_code(cells).first()["code"] == "a = 1\nb = 2 "


def test_ranking_quality(spark):
    r = spark.createDataFrame([("q", 1, 0.9, 0), ("q", 2, 0.8, 1), ("q", 3, 0.1, 1)], "q string, i int, s double, g int")
    got = quality.ndcg(r, query="q", item="i", score="s", gain="g", k=10).first()
    assert got["ndcg"] == pytest.approx((1 / 1.5849625 + 0.5) / (1 + 1 / 1.5849625))
    assert quality.average_precision(r, query="q", item="i", score="s", relevant="g").first()["ap"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_greedy_ties_go_by_name(spark):
    p = spark.createDataFrame([("g", "b", "y", 0.5), ("g", "a", "y", 0.5), ("g", "a", "x", 0.5)], "g string, l string, r string, s double")
    assert {(r["l"], r["r"]) for r in columns.greedy(p, ["g"], "l", "r", "s").collect()} == {("a", "x"), ("b", "y")}


def test_stars_without_a_common_label_count(spark):
    rows = [("q", "n1", "+a"), ("q", "n2", "+b"), ("half", "m1", "+a"), ("half", "m2", "+z"), ("none", "k1", "+y"), ("none", "k2", "+w"), ("none", "k2", "+v")]
    s = spark.createDataFrame(rows, "graph_id string, node string, label string")
    got = {r["b_id"]: r["distance"] for r in provenance.mapping_distance(s.where("graph_id = 'q'"), s).collect()}
    assert got == {"q": 0, "half": 1, "none": 4}
    assert provenance.nearest(s.where("graph_id = 'q'"), s, 3).count() == 3


def test_nearest_compares_shapes(spark, monkeypatch):
    import random

    from weftline.operators import score

    r = random.Random(5)
    rows = []
    for g in range(60):
        # names of 9, 10, 100 nodes sort as text; every third graph has the labels of another one under other names
        seed, names = random.Random(g % 20), (["9", "10", "100", "8"] if g % 3 else ["a", "b", "c", "d"])
        for n in names[: seed.randint(1, 4)]:
            rows += [(str(g), f"{g}:{n}", seed.choice(["+a", "+b", "-c", None])) for _ in range(seed.randint(1, 3))]
    r.shuffle(rows)
    s = spark.createDataFrame(rows, "graph_id string, node string, label string")
    a = s.where("graph_id % 5 = 0")
    want = score.top_k_per(provenance.mapping_distance(a, s), ["a_id"], 3, [F.asc("distance"), F.asc("b_id")]).select("a_id", "b_id", "distance", "rank").collect()
    compared, real = [], provenance.mapping_distance
    monkeypatch.setattr(provenance, "mapping_distance", lambda x, y: compared.append(y.select("graph_id").distinct().count()) or real(x, y))
    got = provenance.nearest(a, s, 3).collect()
    assert len(got) == 36 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert compared[0] <= 40


def test_hit_list(spark):
    import json

    hits = spark.createDataFrame([("q", "t", 2), ("q", "u", 1), ("q", "gone", 3)], "a_table_name string, b_table_name string, rank int")
    stored = {"t": spark.createDataFrame([(1, "x")] * 12, "k int, v string"), "u": spark.createDataFrame([(1,)], "k int")}
    got = json.loads(table_search.hit_list(hits, stored.get))
    assert [(x["varName"], x["varSize"]) for x in got] == [("u", "1"), ("t", "24")] and got[1]["varContent"].count("<tr") == 11
