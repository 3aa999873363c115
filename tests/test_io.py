import json

import pytest
from pyspark.sql import functions as F

from weftline.model import CELL, query
from weftline.sources import graph, notebooks, sinks, tables
from weftline.streaming.ingest import ingest

NB = {
    "metadata": {"language_info": {"name": "python"}},
    "cells": [
        {"cell_type": "markdown", "source": ["# t"]},
        {"cell_type": "code", "source": ["import pandas as pd\n", "df = pd.DataFrame()"], "outputs": [{"output_type": "execute_result", "data": {"text/html": ['<table class="dataframe">']}}, {"output_type": "stream", "name": "x"}]},
        {"cell_type": "code", "source": "df.plot()", "outputs": [{"output_type": "display_data", "data": {"image/png": "AAA"}}]},
    ],
}


@pytest.fixture
def notebook(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "my-nb.ipynb").write_text(json.dumps(NB))
    (tmp_path / "k" / "r.ipynb").write_text(json.dumps(NB | {"metadata": {"language_info": {"name": "R"}}}))
    (tmp_path / "k" / "broken.ipynb").write_text("{")
    (tmp_path / "zipped").mkdir()
    (tmp_path / "zipped" / "no.ipynb").write_text(json.dumps(NB))
    return notebooks.read(spark, str(tmp_path))


def test_cells_and_outputs(notebook):
    cells = {(r["cell_id"], r["cell_code"]) for r in notebooks.cells(notebook).collect()}
    assert cells == {(2, "import pandas as pd\ndf = pd.DataFrame()"), (3, "df.plot()")}
    assert {(r["cell_id"], r["data_type"]) for r in notebooks.display_types(notebook).collect()} == {(2, "DataFrame"), (2, "text"), (3, "png")}
    assert {r["nb_name"] for r in notebooks.cells(notebook).collect()} == {"kmynb"}


def test_workflow_from_parts(spark):
    cells = spark.createDataFrame([("n", 1, "a"), ("n", 3, "b")], "nb_name string, cell_id int, cell_code string")
    var = spark.createDataFrame([("n", 1, "df")], "nb_name string, cell_id int, var string")
    uses = spark.createDataFrame([("n", 3, "df"), ("n", 1, "nope")], "nb_name string, cell_id int, var string")
    out = spark.createDataFrame([("n", 3, "png"), ("n", 3, "text")], "nb_name string, cell_id int, data_type string")
    nodes, edges = notebooks.workflow(cells, var, uses, out)
    assert nodes.count() == 5
    got = {(r["src"], r["dst"], r["rel"]) for r in edges.collect()}
    assert got == {("cell_1_n", "cell_3_n", "Successor"), ("cell_1_n", "1_df_n", "Contains"), ("1_df_n", "cell_3_n", "Usedby"), ("cell_3_n", "3_png_n", "Display"), ("cell_3_n", "3_text_n", "Display")}
    assert notebooks.inverse(edges).where("rel = 'Uses'").first()["src"] == "cell_3_n"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "libs")
    df = spark.createDataFrame([("n", "a"), ("n", "a"), ("n", "b")], "nb_name string, library string")
    for _ in range(2):
        sinks.store_libraries(df, path)
    assert spark.read.parquet(path).count() == 2


def test_tables_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "`a (b)` int, c string")
    sinks.store_table(df, str(tmp_path), "t")
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["ab", "c"]
    own = spark.createDataFrame([(1, "x"), (2, "y")], "a int, c string")
    assert sinks.store_version(own, str(tmp_path), "v") and not sinks.store_version(own.orderBy(F.desc("a")), str(tmp_path), "v")
    assert sinks.store_version(own.limit(1), str(tmp_path), "v")
    values, bad = tables.read_all(spark, {"t": (str(tmp_path / "t"), 1), "gone": (str(tmp_path / "gone"), 1)})
    assert set(bad) == {"gone"} and values.select("table_name").distinct().count() == 1


def test_cells_replace_and_dictionary(spark, tmp_path):
    path = str(tmp_path / "cells")
    one = spark.createDataFrame([("n", 1, "a = 1"), ("n", 2, " "), ("m", 1, "a = 1")], "nb_name string, cell_id int, cell_code string")
    sinks.store_cells(one, path, replace=True)
    sinks.store_cells(spark.createDataFrame([("n", 5, "z")], one.schema), path, replace=True)
    got = {(r["nb_name"], r["cell_id"]) for r in spark.read.parquet(path).collect()}
    assert got == {("n", 5), ("m", 1)}
    assert sinks.cell_dictionary(one).where("code = 'YSA9IDE='").first()["cell_id"] == 1
    assert graph.source_code(one, "ncp3").count() == 2


def test_lineage_and_maps(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "view_id string, view_cmd string")
    dep = make([("v", '{"1":{"lhs":["a"],"rhs":[{"var":"b","op":"f"}]}}'), ("w", "{}")])
    got = graph.lineage(dep, make([("v", '{"1":2}'), ("w", "{}")]), make([("v", "3"), ("w", "0")]))
    (r,) = got.collect()
    assert r["dependency"][1]["lhs"] == ["a"] and r["line2cid"] == {1: 2} and r["last_line"] == 3
    for _ in range(2):
        sinks.store_lineage(got, str(tmp_path / "lineage"))
    assert [json.loads(x["line2cid"]) for x in spark.read.parquet(str(tmp_path / "lineage")).collect()] == [{"1": 2}]
    (tmp_path / "m.json").write_text('{"a": "b"}')
    assert [tuple(x) for x in graph.name_map(spark, str(tmp_path / "m.json")).collect()] == [("a", "b")]
    pairs = spark.createDataFrame([("q", "d", 0.5)], "q string, d string, sim double")
    sinks.store_similarities(pairs, str(tmp_path / "s"))
    assert [tuple(x) for x in graph.similarity_cache(spark, str(tmp_path / "s")).collect()] == [("q", "d", 0.5)]
    (tmp_path / "j.csv").write_text("﻿1,2,3,4,5,0,4\n", encoding="utf-8")
    assert graph.judgements(spark, str(tmp_path / "j.csv"), "q1").first()["nb_id"] == 1
    (tmp_path / "names.txt").write_text(" a \nb\na\n\n")
    assert sorted(r[0] for r in graph.valid_names(spark, str(tmp_path / "names.txt")).collect()) == ["a", "b"]


def test_query_files_and_csv(spark, tmp_path):
    q = query({"q0": CELL, "q1": CELL}, [("q0", "q1")], {"q0": "x"}, ["l"])
    sinks.save_query(q, str(tmp_path / "q.json"))
    assert sinks.load_query(str(tmp_path / "q.json")) == q
    df = tables.query_table(spark, 'a,b\n1,"x,y"\n2,z')
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.first()["b"] == "x,y"


def test_catalog(spark):
    spark.range(1).createOrReplaceTempView("exp_view_table_1")
    assert tables.table_names(spark, contains="exp_view", views=True) == ["exp_view_table_1"]


def test_streaming_ingest_writes_each_key_once(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("n", "a"), ("n", "b")], "nb_name string, library string")
    df.write.parquet(src)
    for k in range(2):
        ingest(spark, src, dst, "libraries", ["nb_name", "library"], str(tmp_path / f"cp{k}")).awaitTermination(60)
        df.unionAll(spark.createDataFrame([("m", "c")], df.schema)).write.mode("append").parquet(src)
    assert spark.read.parquet(dst).count() == 3


def test_ingest_from_files_to_graph(spark, tmp_path, notebook):
    from weftline.sources import ingest as whole

    src = [c for c in NB["cells"]] + [{"cell_type": "code", "source": ["dg = df.head()\n", "n = 3"], "outputs": []}]
    (tmp_path / "k" / "my-nb.ipynb").write_text(json.dumps(NB | {"cells": src}))
    root = str(tmp_path / "store")
    for _ in range(2):  # what is stored stays as it is
        done = whole.ingest(spark, str(tmp_path), root, is_table=F.col("var").startswith("d"))
        assert set(done) == {"cells", "libraries", "display_types", "cell_dict", "lineage", "wf_nodes", "wf_edges"} and not any(done.values())
        assert {r["cell_id"] for r in spark.read.parquet(f"{root}/cells").collect()} == {2, 3, 4}
        assert [tuple(r) for r in spark.read.parquet(f"{root}/libraries").collect()] == [("kmynb", "pandas")]
        nodes, edges = graph.load(spark, root)
        assert {(r["node"], r["node_type"]) for r in nodes.collect()} >= {("cell_2_kmynb", "Cell"), ("2_df_kmynb", "Var"), ("4_dg_kmynb", "Var"), ("3_png_kmynb", "Display_data")}
        assert nodes.where("node_type = 'Var'").count() == 2
        assert {(r["src"], r["dst"]) for r in edges.where("rel = 'Usedby'").collect()} == {("2_df_kmynb", "cell_3_kmynb"), ("2_df_kmynb", "cell_4_kmynb")}
    stars = graph.lineage_stars(graph.stored_lineage(spark, f"{root}/lineage"))
    assert {(r["graph_id"], r["node"], r["label"]) for r in stars.where("graph_id = '4_dg_kmynb'").collect()} == {("4_dg_kmynb", n, x) for n, x in (("var_dg_4_kmynb", "-head"), ("var_df_2_kmynb", "+head"), ("var_df_2_kmynb", "-DataFrame"), ("pdkmynb", "+DataFrame"))}
    kept = graph.reused(nodes, edges, "own")
    assert spark.table("own_nodes").count() == kept[0].count()
    for df in kept:
        df.unpersist()


def test_ingest_goes_on_after_a_failure(spark, tmp_path, notebook, monkeypatch):
    from weftline.sources import ingest as whole

    monkeypatch.setattr(sinks, "store_libraries", lambda *_: 1 / 0)
    done = whole.ingest(spark, str(tmp_path / "k"), str(tmp_path / "store"))
    assert done["libraries"].startswith("ZeroDivisionError") and done["cells"] is None and done["wf_edges"] is None


def test_variables_index_and_caches(spark, tmp_path):
    from weftline.operators.columns import long_form

    df = spark.createDataFrame([(1, "x"), (2, "y")], "`a %` int, c string")
    lineage = spark.createDataFrame([("2_v_nb", {1: {"lhs": ["v"], "rhs": []}}, {1: 2}, 1), ("other", {1: {"lhs": ["w"], "rhs": []}}, {1: 2}, 1)], "view_id string, dependency map<int,struct<lhs:array<string>,rhs:array<struct<var:string,op:string>>>>, line2cid map<int,int>, last_line int")
    assert sinks.store_variables({"2_v_nb": df}, lineage, str(tmp_path)) == {}
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "indexed")).collect()] == ["2_v_nb"] and spark.read.parquet(str(tmp_path / "lineage")).count() == 1
    stored = tables.one_table(spark, str(tmp_path / "tables"), "2_v_nb")
    assert stored.columns == ["a", "c"] and tables.one_table(spark, str(tmp_path / "tables"), "gone") is None
    values = long_form(stored, "2_v_nb", 1)
    sinks.build_index(values, str(tmp_path / "index"), spark.createDataFrame([("g", "n", "+a")], "graph_id string, node string, label string"))
    index, found = sinks.load_schema_index(spark, str(tmp_path / "index"))
    assert index.count() == 2 and found.count() == 4 and spark.read.parquet(str(tmp_path / "index" / "sketch")).count() == 4
    (tmp_path / "s.json").write_text('[["q", "d", 0.5],\n ["q", "e", 1], ["q", "d", 0.25]]')
    assert {tuple(r) for r in graph.similarity_list(spark, str(tmp_path / "s.json")).collect()} == {("q", "d", 0.25), ("q", "e", 1.0)}
    sinks.store_ids({"t": 4}, spark, str(tmp_path / "ids"))
    assert [tuple(r) for r in sinks.load_ids(spark, str(tmp_path / "ids")).collect()] == [(4, "t")]


def test_equal_cells_in_other_rows_are_another_version(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "a")], "k int, v string")
    assert sinks.store_version(one, str(tmp_path), "v") and sinks.store_version(two, str(tmp_path), "v")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {(1, "b"), (2, "a")}


def test_statements():
    from weftline.functions.dependencies import statements

    code = "%matplotlib inline\nx = f(1,  # one\n  2)\n\n# only a comment\ny = '#(' # tail\nz = [\n 1,\n]\nopen = (1,"
    assert statements(code) == ["x = f(1,    2)", "y = '#(' ", "z = [ 1,]", "open = (1,"] and statements(None) == []
