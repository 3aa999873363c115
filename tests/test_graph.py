import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.model import ANY, CELL, ONE, OUTPUT, SHAPES, VAR, Query, QueryNode, SearchConfig, node_score, query, shaped
from weftline.operators import graph_stats, match, reach, scale, score
from weftline.plans import search

# c1->c2, c1->d1, c1->d2, c2->c3, c2->v1, c3->d3
NODES = [("nb", n, t, k, f"code {n}") for n, t, k in (("c1", CELL, None), ("c2", CELL, None), ("c3", CELL, None), ("d1", OUTPUT, "text"), ("d2", OUTPUT, "png"), ("d3", OUTPUT, "text"), ("v1", VAR, None))]
EDGES = [("nb", a, b, "Successor") for a, b in (("c1", "c2"), ("c1", "d1"), ("c1", "d2"), ("c2", "c3"), ("c2", "v1"), ("c3", "d3"))]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, "nb_name string, node string, node_type string, display_type string, cell_code string"), spark.createDataFrame(EDGES, "nb_name string, src string, dst string, rel string")


def brute(nodes, edges, q: Query):
    """All homomorphisms; far edges through AnyWildcard need a path of one edge or more."""
    label = {n: t for _, n, t, *_ in nodes}
    near = {(a, b) for _, a, b, _ in edges}
    far = set(near)
    while True:
        more = {(a, d) for a, b in far for c, d in near if b == c} - far
        if not more:
            break
        far |= more
    steps, names = match._plan(q)
    out = set()
    for pick in itertools.product(*([n for n in label if q.node(x).label in (ONE, label[n])] for x in names)):
        at = dict(zip(names, pick, strict=True))
        if all(((at[a], at[b]) in (far if is_far else near)) for a, b, is_far in steps):
            out.add(tuple(at[x] for x in names))
    return names, out


CASES = {
    "chain": (query({"a": CELL, "b": CELL, "c": CELL}, [("a", "b"), ("b", "c")]), 1),
    "two outputs": (query({"a": CELL, "o": OUTPUT, "p": OUTPUT}, [("a", "o"), ("a", "p")]), 5),
    "cell, output, variable": (query({"a": CELL, "b": CELL, "o": OUTPUT, "v": VAR}, [("a", "b"), ("a", "o"), ("b", "v")]), 2),
    "reach": (query({"a": CELL, "w": ANY, "b": CELL}, [("a", "w"), ("w", "b")]), 3),
    "output and reach": (query({"a": CELL, "o": OUTPUT, "w": ANY, "b": CELL}, [("a", "o"), ("a", "w"), ("w", "b")]), 4),
}


@pytest.mark.parametrize("case", CASES)
def test_golden_counts(graph, case):
    q, want = CASES[case]
    found = match.find(*graph, q, prefilter=False)
    names, all_ = brute(NODES, EDGES, q)
    got = {tuple(r[n] for n in names) for r in found.collect()}
    assert len(got) == found.count() == want and got == all_


@pytest.mark.parametrize("case", ["cell, output, variable", "output and reach"])
def test_edge_order_does_not_matter(graph, case):
    q, want = CASES[case]
    for edges in itertools.permutations(q.edges):
        assert match.find(*graph, Query(q.nodes, tuple(edges)), prefilter=False).count() == want


def test_random_graphs_equal_brute_force(spark):
    r = random.Random(5)
    queries = [query({"a": CELL, "b": VAR, "c": CELL}, [("a", "b"), ("a", "c"), ("b", "c")]), query({"a": CELL, "x": ONE, "b": CELL}, [("a", "x"), ("x", "b")]), query({"a": CELL, "w": ANY, "u": ANY, "b": VAR, "c": VAR}, [("a", "w"), ("w", "u"), ("u", "b"), ("w", "c")])]
    for _ in range(2):
        nodes = [("g", f"n{i}", r.choice((CELL, VAR)), None, "") for i in range(9)]
        edges = [("g", f"n{i}", f"n{j}", "Successor") for i in range(9) for j in range(9) if i != j and r.random() < 0.2]
        n, e = spark.createDataFrame(nodes, "nb_name string, node string, node_type string, display_type string, cell_code string"), spark.createDataFrame(edges, "nb_name string, src string, dst string, rel string")
        for q in queries:
            names, all_ = brute(nodes, edges, q)
            assert {tuple(x[k] for k in names) for x in match.find(n, e, q, prefilter=False).collect()} == all_


def test_prefilter_and_injective(graph):
    q = CASES["two outputs"][0]
    assert match.find(*graph, q).count() == 5
    assert match.find(*graph, q, injective=True).count() == 2
    many = query({"a": CELL, **{f"o{i}": OUTPUT for i in range(4)}}, [("a", f"o{i}") for i in range(4)])
    assert match.find(*graph, many).count() == 0 < match.find(*graph, many, prefilter=False).count()


def test_stats(graph):
    r = graph_stats.workflow_stats(*graph, output_types=("text", "png")).first()
    assert (r["n_cell"], r["n_var"], r["n_output"], r["n_text"], r["n_png"], r["max_in"], r["max_out"]) == (3, 1, 3, 2, 1, 1, 3)
    assert [x["node"] for x in graph_stats.roots(*graph).collect()] == ["c1"]


def test_closure_with_cycles_and_depth(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "d"), ("h", "a", "z")], "nb_name string, src string, dst string")
    got = {(r["nb_name"], r["src"], r["dst"]) for r in reach.closure(e).collect()}
    assert got == {("g", x, y) for x in "abc" for y in "abcd"} | {("h", "a", "z")}
    assert reach.closure(e, max_depth=1).count() == 5
    assert ("g", "a", "d") not in {(r["nb_name"], r["src"], r["dst"]) for r in reach.closure(e, max_depth=2).collect()}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([("g", f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("g", "x", "y"), ("h", "000", "b")], "nb_name string, src string, dst string")
    got = {(r["nb_name"], r["node"]): r["component"] for r in reach.components(e).collect()}
    assert got["g", "060"] == "000" and got["g", "y"] == "x" and got["h", "b"] == "000"


def test_node_score():
    assert node_score(2, 0.6) == pytest.approx(1.2) and node_score(-2, 0.6) == pytest.approx(0.8)


def test_weights():
    q = query({"c": CELL, "o": OUTPUT, "p": OUTPUT, "r": OUTPUT}, [("c", "o"), ("c", "p"), ("c", "r")])
    assert SearchConfig().node_weights(q)[OUTPUT] == pytest.approx(1 / 6)


@pytest.mark.parametrize("mode", ["single", "reference"])
@pytest.mark.parametrize("weights", [(1.0, 1.0, 1.0), (-1.0, 2.0, 0.5), (0.5, -3.0, 1.0)])
def test_pruned_equals_unpruned(spark, mode, weights):
    r = random.Random(1)
    nodes, edges, libs = [], [], []
    for b in range(30):
        for i in range(6):
            nodes.append((f"nb{b:02}", f"{b}:{i}", (CELL, VAR, OUTPUT)[i % 3], r.choice(("text", "png")), " ".join(r.choice("abcdef") for _ in range(4))))
            if i:
                edges.append((f"nb{b:02}", f"{b}:{r.randrange(i)}", f"{b}:{i}", "Successor"))
        libs += [(f"nb{b:02}", x) for x in r.sample("pqrst", 3)]
    n, e = spark.createDataFrame(nodes, "nb_name string, node string, node_type string, display_type string, cell_code string"), spark.createDataFrame(edges, "nb_name string, src string, dst string, rel string")
    lib = spark.createDataFrame(libs, "nb_name string, library string")
    q = query({"c": CELL, "v": VAR}, [("c", "v")], {"c": "a b c"}, libraries=["p", "q"])
    sims = spark.createDataFrame([("v", x[1], r.random()) for x in nodes if x[2] == VAR], "q string, d string, sim double")
    config = SearchConfig(k=4, w_code=weights[0], w_data=weights[1], w_library=weights[2], data_weight_mode=mode)
    a = search.search(n, e, q, config, libraries=lib, pair_sim=sims).collect()
    b = search.pruned_search(n, e, q, config, lambda asked: sims if asked is None else sims.join(asked, ["q", "d"], "left_semi"), libraries=lib).collect()
    assert [x["nb_name"] for x in a] == [x["nb_name"] for x in b] and [x["score"] for x in a] == pytest.approx([x["score"] for x in b])
    c = search.code_pruned_search(n, e, q, config, libraries=lib, pair_sim=sims).collect()
    assert [x["nb_name"] for x in a] == [x["nb_name"] for x in c] and [x["score"] for x in a] == pytest.approx([x["score"] for x in c])
    if mode == "single":
        plain = SearchConfig(k=4, w_code=weights[0], w_data=0.0, w_library=weights[2])
        x, y = search.search(n, e, q, plain, libraries=lib).collect(), search.code_pruned_search(n, e, q, plain, libraries=lib).collect()
        assert [r["score"] for r in x] == pytest.approx([r["score"] for r in y])


def test_search_compares_tables_by_itself(graph, spark):
    long = "table_name string, group_id int, col string, col_pos int, dtype string, row_id long, value string"

    def cells(name, *vals):
        return [(name, 1, "a", 0, "object", i, v) for i, v in enumerate(vals)]

    n, e = graph
    q = query({"c": CELL, "v": VAR}, [("c", "v")])
    tables = spark.createDataFrame(cells("v", "x", "y"), long), spark.createDataFrame(cells("t1", "x", "z") + cells("t2", "q"), long), spark.createDataFrame([("v1", "t1"), ("v2", "t2")], "d string, table_name string")
    config = SearchConfig(w_code=0.0, w_data=1.0, w_output=0.0)
    assert search.search(n, e, q, config, tables=tables).first()["score"] == pytest.approx(1 / 3)
    assert search.search(n, e, q, config, tables=tables, how="search").first()["score"] == pytest.approx(0.1 * 1 / 1 + 0.9 / 3)


def test_similarities_are_computed_once_a_content(spark, monkeypatch):
    from weftline.plans import data_similarity as D

    long = "table_name string, group_id int, col string, col_pos int, dtype string, row_id long, value string"
    cells = lambda name, *vals: [(name, 1, "a", 0, "object", i, v) for i, v in enumerate(vals)]
    query_ = spark.createDataFrame(cells("q", "x", "y"), long)
    values = spark.createDataFrame(cells("t", "x") + cells("u", "x") + cells("w", "y", "x") + cells("z", "o"), long)
    variables = spark.createDataFrame([(f"n{k}", t) for k, t in enumerate("tuwzt")], "d string, table_name string")
    compared = []
    real = D.table_pairs
    monkeypatch.setattr(D, "table_pairs", lambda a, b, **k: compared.append({r["table_name"] for r in b.select("table_name").distinct().collect()}) or real(a, b, **k))
    first, cache = D.pair_similarity(query_, values, variables.where("table_name != 'z'"))
    assert {r["d"]: r["sim"] for r in first.collect()} == {"n0": 0.5, "n1": 0.5, "n2": 1.0, "n4": 0.5}
    again, _ = D.pair_similarity(query_, values, variables, cache=cache)
    assert {r["d"]: r["sim"] for r in again.collect()} == {"n0": 0.5, "n1": 0.5, "n2": 1.0, "n3": 0.0, "n4": 0.5}
    assert compared == [{"t", "w"}, {"z"}]


def test_content_is_only_read_of_tables_that_may_be_equal(spark, monkeypatch):
    from weftline.operators import profile
    from weftline.plans import data_similarity as D

    long = "table_name string, group_id int, col string, col_pos int, dtype string, row_id long, value string"
    cells = lambda name, *vals, dtype="object": [(name, 1, "a", 0, dtype, i, v) for i, v in enumerate(vals)]
    query_ = spark.createDataFrame(cells("q", "x", "y"), long)
    # t and u are equal, n differs in its dtype and e in a value; s has another length, i.e. no equal
    values = spark.createDataFrame(cells("t", "x", None) + cells("u", None, "x") + cells("n", "x", None, dtype="int64") + cells("e", "x", "") + cells("s", "x", "y", "z"), long)
    variables = spark.createDataFrame([(f"v_{t}", t) for t in "tunes"], "d string, table_name string")
    hashed, real = [], profile.content_ids
    monkeypatch.setattr(profile, "content_ids", lambda v: hashed.append({r["table_name"] for r in v.select("table_name").distinct().collect()}) or real(v))
    pairs, cache = D.pair_similarity(query_, values, variables)
    assert hashed[0] == {"t", "u", "n", "e"}
    assert {r["d"]: r["sim"] for r in pairs.collect()} == pytest.approx({"v_t": 1 / 2, "v_u": 1 / 2, "v_n": 0.0, "v_e": 1 / 3, "v_s": 2 / 3})
    assert cache.select("data_id").distinct().count() == cache.count() == 4
    again, _ = D.pair_similarity(query_, values, variables, cache=cache)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pairs.collect()))


def test_content_ids_gather_no_cells(spark):
    from weftline.operators import columns, profile

    v = columns.long_form(spark.range(20).select("id", F.col("id").cast("string").alias("s")), "t", 1)
    plan = profile.content_ids(v)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_workflows_below_roots_and_summary(graph, spark):
    n, e = graph
    got = {r["root"]: (r["n_cell"], r["n_var"], r["n_output"]) for r in graph_stats.root_workflow_stats(n, e, reach.closure(e)).collect()}
    assert got == {"c1": (3, 1, 3)}
    two = n.unionByName(spark.createDataFrame([("other", "z", CELL, None, "")], n.schema))
    rows = {(r["part"], r["name"]): (r["min_v"], r["max_v"], r["avg_v"], r["sum_v"]) for r in graph_stats.dataset_summary(two, spark.createDataFrame([("t", 5), ("u", 7)], "table_name string, n_bytes long")).collect()}
    assert rows["Node", CELL] == (1, 3, 2.0, 4) and rows["Node", VAR] == (0, 1, 0.5, 1) and rows["Table", "table data"] == (5, 7, 6.0, 12)
    v = spark.createDataFrame([("nb", "2_my_df_nb", VAR)], "nb_name string, node string, node_type string")
    assert [tuple(r) for r in graph_stats.table_variables(v).collect()] == [("nb", "my_df")]


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_shapes(shape):
    q = shaped(shape, {"c1": "x = 1"}, ["pandas"])
    assert q.root == "c1" and q.count(CELL) >= 3 and q.node("c1").contents == "x = 1" and q.libraries == ("pandas",)


def test_unmatched_notebooks_on_demand(graph, spark):
    q = query({"c": CELL, "v": VAR}, [("c", "v")])
    n, e = graph
    more = n.unionByName(spark.createDataFrame([("other", "z", CELL, None, "")], n.schema))
    got = search.search(more, e, q, SearchConfig(include_unmatched=True)).collect()
    assert {(r["nb_name"], r["score"] > -1) for r in got} == {("nb", True), ("other", True)}
    assert [r["nb_name"] for r in search.search(more, e, q, SearchConfig()).collect()] == ["nb"]


def test_copies(graph):
    n, e = scale.copies(*graph, 3)
    sizes = {r["nb_name"]: r["count"] for r in n.groupBy("nb_name").count().collect()}
    assert sizes == {"nb": 7, "nbcp1": 8, "nbcp2": 6}
    ends = {r["nb_name"]: r["count"] for r in e.groupBy("nb_name").count().collect()}
    assert ends == {"nb": 6, "nbcp1": 7, "nbcp2": 5}


def test_query_validation_and_json():
    with pytest.raises(ValueError, match="one root"):
        query({"a": CELL, "b": CELL}, [])
    with pytest.raises(ValueError, match="wildcard"):
        query({"a": ANY, "b": CELL}, [("a", "b")])
    q = query({"q0": CELL, "q1": OUTPUT}, [("q0", "q1")], {"q0": "x = 1"}, ["pandas"], {"q1": "png"})
    assert Query.from_json(q.to_json()) == q
    with pytest.raises(ValueError, match="has edges"):
        q.without_node("q0")
    assert q.without_edge("q0", "q1").without_node("q1").nodes == (q.node("q0"),)
    assert query({"a": CELL, "b": CELL}, [("a", "b")], {"a": "1\n\n2", "b": "3"}).joined_code() == "1\n2\n3"


def test_best_match_not_the_first(graph):
    q = query({"a": CELL, "b": CELL}, [("a", "b")], {"a": "code c2", "b": "code c3"})
    n = score.code_similarity(graph[0], q)
    found = match.find(n, graph[1], q, carry=("sim_a", "sim_b", "display_type"))
    best = score.match_scores(found, q, SearchConfig()).orderBy(F.desc("score")).first()
    assert (best["a"], best["b"]) == ("c2", "c3") and best["score"] == pytest.approx(1.0)


def test_nodes_below_roots(graph):
    n, e = graph
    roots = n.where("node = 'c2'").select("nb_name", "node")
    got = {r["node"]: r["number"] for r in reach.from_roots(n, reach.closure(e), roots).collect()}
    assert got == {"c2": 1, "c3": 2, "d3": 3, "v1": 4}


def test_a_wildcard_root_starts_anywhere(graph):
    q = Query((QueryNode("a", ANY), QueryNode("c", CELL)), (("a", "c"),))
    got = {(r["a"], r["c"]) for r in match.find(*graph, q, prefilter=False, wildcard_root=True).collect()}
    assert got == {("c1", "c2"), ("c1", "c3"), ("c2", "c3")}
    one = Query((QueryNode("a", ONE), QueryNode("o", OUTPUT)), (("a", "o"),))
    assert {(r["a"], r["o"]) for r in match.find(*graph, one, prefilter=False, wildcard_root=True).collect()} == {("c1", "d1"), ("c1", "d2"), ("c3", "d3")}
    with pytest.raises(ValueError, match="wildcard"):
        match.find(*graph, q)
