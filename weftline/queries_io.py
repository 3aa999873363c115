"""Further queries of the catalogue: what is stored and read again, sources, and switches of scoring. Importing this registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .checkpoints import shared_folder
from .functions import dependencies, text
from .model import ANY, CELL, OUTPUT, VAR, Query, QueryNode, SearchConfig, query
from .operators import graph_stats, mapping, match, profile, setbased
from .operators.columns import long_form
from .plans import search
from .queries import CHAIN, CHAIN_T, COL_SCORE, GROUPS, GROUPS_SQL, N, PROGRAM_OK, PROGRAMS, SQL, E, _data_sim, _match_sql, _pairs_sql, _programs, conv_edges, conv_nodes, events_libraries, jaccard_sql, long_sql, output_type_overlap, parts_sql, q, quoted, table, table_assignment, tokens_sql, values, whole_code_jaccard, library_jaccard
from .sources import graph, sinks, tables
from .streaming.ingest import ingest


def _folder(spark) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@q(SQL["valid_graph"])
def stored_graph(spark, d):
    """A graph written, and read again for the notebooks of an allow-list in a text file."""
    root, n = _folder(spark), conv_nodes(spark, d)
    n.select("nb_name", "node", "node_type", "display_type").write.parquet(f"{root}/wf_nodes")
    conv_edges(spark, d).write.parquet(f"{root}/wf_edges")
    n.where(F.col("node_type") == OUTPUT).select(F.concat(F.lit(" "), "nb_name", F.lit(" "))).write.text(f"{root}/names")
    return graph.load(spark, root, graph.valid_names(spark, f"{root}/names"), ("Successor",))[1].select("nb_name", "src", "dst")


@q("SELECT conv_id::VARCHAR AS nb_name, turn::INT AS cell_id, md5(text) AS h FROM conversations WHERE conv_id = 5")
def cells_of_a_copy(spark, d):
    """The cells of one notebook, asked for by the name of its synthetic copy."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("nb_name"), F.col("turn").cast("int").alias("cell_id"), F.col("text").alias("cell_code"))
    return graph.source_code(c, "5cp12").select("nb_name", "cell_id", F.md5(F.col("cell_code").cast("binary")).alias("h"))


@q(f"SELECT table_name, group_id, col, dtype, count(*) AS n_rows, count(value) AS n_values FROM ({long_sql()}) GROUP BY ALL")
def all_tables(spark, d):
    v, bad = tables.read_all(spark, {t: (f"{d}/{t}.parquet", g) for t, g in GROUPS.items()} | {"missing": (f"{d}/missing.parquet", 9)})
    if set(bad) != {"missing"}:
        raise ValueError(bad)
    return v.groupBy("table_name", "group_id", "col", "dtype").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"))


@q("SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def csv_query_table(spark, d):
    """A query's table from CSV text (here that of nation: a query's table is small)."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    return tables.query_table(spark, "\n".join(["n_nationkey,n_name,n_regionkey", *(",".join(map(str, r)) for r in rows)]))


@q(f"{_pairs_sql(('nation',), ('customer', 'supplier', 'region'))} SELECT ta || '.' || ca AS q, tb || '.' || cb AS d, inter::DOUBLE / (n_a + n_b - inter) AS sim FROM s")
def stored_similarities(spark, d):
    root = _folder(spark)
    p = mapping.column_pairs(values(spark, d, ("nation",)), values(spark, d, ("customer", "supplier", "region")))
    sinks.store_similarities(p.select(F.concat_ws(".", "a_table_name", "a_col").alias("q"), F.concat_ws(".", "b_table_name", "b_col").alias("d"), "sim"), root)
    return graph.similarity_cache(spark, root)


@q("SELECT DISTINCT user_id::VARCHAR AS nb_name, concat_ws('_', event_type, (props->>'$.k')) AS library FROM events")
def stored_libraries(spark, d):
    """Stored twice, each once."""
    root, rows = _folder(spark), events_libraries(spark, d)
    for _ in range(2):
        sinks.store_libraries(rows, root)
    return spark.read.parquet(root)


@q("SELECT DISTINCT user_id::VARCHAR AS nb_name, (event_id % 7)::INT AS cell_id, event_type AS data_type FROM events")
def stored_outputs(spark, d):
    root = _folder(spark)
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("nb_name"), (F.col("event_id") % 7).cast("int").alias("cell_id"), F.col("event_type").alias("data_type"))
    for _ in range(2):
        sinks.store_display_types(rows, root)
    return spark.read.parquet(root)


@q("SELECT DISTINCT user_id::VARCHAR AS nb_name, (event_id % 7)::INT AS cell_id, event_type AS data_type FROM events")
def output_cells(spark, d):
    """The distinct pairs of cell and kind of output of each notebook."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("nb_name"), (F.col("event_id") % 7).cast("int").alias("cell_id"), F.col("event_type").alias("data_type"))
    return graph_stats.output_sets(rows).select("nb_name", F.explode("cells").alias("x")).select("nb_name", "x.cell_id", "x.data_type")


@q("SELECT 'nb' || p_brand AS nb_name, p_partkey::INT AS cell_id, 'price' AS var_name, p_size::VARCHAR AS contents FROM part")
def stored_scalars(spark, d):
    root = _folder(spark)
    rows = table(spark, d, "part").select(F.concat(F.lit("nb"), "p_brand").alias("nb_name"), F.col("p_partkey").cast("int").alias("cell_id"), F.lit("price").alias("var_name"), F.col("p_size").alias("contents"))
    for _ in range(2):
        sinks.store_scalars(rows, root)
    return spark.read.parquet(root)


@q("SELECT conv_id::VARCHAR AS nb_name, turn::INT AS cell_id, md5(CASE WHEN conv_id % 2 = 0 THEN upper(role) ELSE text END) AS h FROM conversations")
def stored_cells(spark, d):
    """All notebooks' cells, then those of every other notebook replaced."""
    root, c = _folder(spark), table(spark, d, "conversations")
    key = [F.col("conv_id").cast("string").alias("nb_name"), F.col("turn").cast("int").alias("cell_id")]
    sinks.store_cells(c.select(*key, F.col("text").alias("cell_code")), root, replace=True)
    sinks.store_cells(c.where("conv_id % 2 = 0").select(*key, F.upper("role").alias("cell_code")), root, replace=True)
    return spark.read.parquet(root).select(F.col("nb_name").cast("string").alias("nb_name"), "cell_id", F.md5(F.col("cell_code").cast("binary")).alias("h"))


@q(
    f"""WITH {PROGRAMS}, s AS (SELECT k, unnest(['var_b' || k || '_4_nb' || k, 'var_b' || k || '_4_nb' || k, 'var_b' || k || '_3_nb' || k, 'var_b' || k || '_3_nb' || k, 'var_b' || k || '_3_nb' || k, 'var_a' || k || '_2_nb' || k, 'var_a' || k || '_2_nb' || k, 'var_a' || k || '_2_nb' || k, 'pdnb' || k, 'var_c' || z || '_1_nb' || k]) AS node,
unnest(['-' || op, '-' || op, '-merge', '-merge', '+' || op, '-read_csv', '+merge', '+' || op, '+read_csv', '+merge']) AS label FROM o) SELECT '4_b' || k || '_nb' || k AS graph_id, node, label FROM s"""
)
def lineage_stars(spark, d):
    """Lineage as three JSON tables, joined, stored, read again, and the star graph around the last variable of each program."""
    root = _folder(spark)
    p = table(spark, d, "part").where(PROGRAM_OK).select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("z"), F.when(F.col("p_size") % 2 == 0, "Add").otherwise("Mult").alias("op"))
    view = F.concat(F.lit("4_b"), "k", F.lit("_nb"), "k").alias("view_id")
    line = '"{n}":{{"lhs":["{w}%1$s"],"rhs":[{rhs}]}}'
    read = '{{"var":"{v}","op":"{op}"}}'
    lines = [line.format(n=1, w="a", rhs=read.format(v="pd", op="read_csv")), line.format(n=2, w="b", rhs=read.format(v="a%1$s", op="merge") + "," + read.format(v="c%2$s", op="merge")), line.format(n=3, w="b", rhs=read.format(v="b%1$s", op="%3$s") + "," + read.format(v="a%1$s", op="%3$s"))]
    dependency = p.select(view, F.format_string("{" + ",".join(lines) + "}", "k", "z", "op").alias("view_cmd"))
    cells, last = p.select(view, F.lit('{"1":2,"2":3,"3":4}').alias("view_cmd")), p.select(view, F.lit("3").alias("view_cmd"))
    for _ in range(2):
        sinks.store_lineage(graph.lineage(dependency, cells, last), root)
    return graph.lineage_stars(graph.stored_lineage(spark, root))


@q("SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(step, stored), (SELECT count(*) AS n_rows, sum(s_suppkey)::BIGINT AS s FROM supplier)")
def stored_versions(spark, d):
    """A table, the same in another row order, and the same cells paired in another way: the second isn't stored."""
    root, s = _folder(spark), table(spark, d, "supplier")
    top = F.lit(s.agg(F.max("s_suppkey")).first()[0] + s.agg(F.min("s_suppkey")).first()[0])
    turned = s.drop("s_name").join(s.select((top - F.col("s_suppkey")).alias("s_suppkey"), "s_name"), "s_suppkey").select(*s.columns)
    done = [(k + 1, sinks.store_version(x, root, "supplier")) for k, x in enumerate((s, s.orderBy(F.desc("s_name")), turned))]
    kept = spark.read.parquet(f"{root}/supplier").agg(F.count("*").alias("n_rows"), F.sum("s_suppkey").alias("s"))
    return kept.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(v).alias("stored")) for k, v in done)))).select("x.step", "x.stored", "n_rows", "s")


@q(SQL["schema_index"])
def stored_schema_index(spark, d):
    root = _folder(spark)
    sinks.build_index(values(spark, d), root)
    return sinks.load_schema_index(spark, root)[0]


@q("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def exported_csv(spark, d):
    root = _folder(spark)
    sinks.export_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), root)
    return spark.read.csv(root, header=True)


@q("SELECT n_nationkey, n_name FROM nation")
def stored_variables(spark, d):
    """Tables of variables with signs in their column names, stored with their lineage and read again by name."""
    root, n = _folder(spark), table(spark, d, "nation").select(F.col("n_nationkey").alias("n_nation (key)"), F.col("n_name").alias("n_%name"))
    lineage = spark.createDataFrame([("2_n_nb", {1: {"lhs": ["n"], "rhs": []}}, {1: 2}, 1)], "view_id string, dependency map<int,struct<lhs:array<string>,rhs:array<struct<var:string,op:string>>>>, line2cid map<int,int>, last_line int")
    if failed := sinks.store_variables({"2_n_nb": n}, lineage, root):
        raise ValueError(failed)
    return tables.one_table(spark, f"{root}/tables", "2_n_nb")


@q("SELECT n_name AS name, n_nationkey::VARCHAR AS value FROM nation")
def name_map(spark, d):
    """A JSON object of names, in a file."""
    root = _folder(spark)
    n = table(spark, d, "nation").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("m"))
    n.select(F.to_json("m").alias("value")).coalesce(1).write.text(root)
    return graph.name_map(spark, root)


@q("SELECT DISTINCT user_id::VARCHAR AS nb_name, concat_ws('_', event_type, (props->>'$.k')) AS library FROM events")
def streamed_libraries(spark, d):
    """Files that arrive become rows; a second stream over all of them adds none."""
    root = _folder(spark)
    events_libraries(spark, d).write.parquet(f"{root}/in")
    for k in range(2):
        ingest(spark, f"{root}/in", f"{root}/out", "libraries", ["nb_name", "library"], f"{root}/cp{k}").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@q(
    f"""SELECT p_partkey::VARCHAR AS nb_name, unnest(CASE WHEN {PROGRAM_OK} THEN range(1, 6) ELSE range(1, 3) END)::INT AS n, unnest(CASE WHEN {PROGRAM_OK} THEN
['import numpy as np, pandas as pd', 'a' || p_partkey || ' = pd.read_csv(''' || p_brand || ''')', 'b' || p_partkey || ' = a' || p_partkey || '.merge(c' || p_size || ')', 'b' || p_partkey || ' = b' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' + a' ELSE ' * a' END || p_partkey || '  ', 'from m' || p_partkey || ' import f' || p_size]
ELSE ['import os', 'x = (' || p_partkey] END) AS statement FROM part"""
)
def cell_statements(spark, d):
    """Code lines with those that an open bracket continues joined, without comments."""
    return dependencies.table_function(_programs(spark, d), "code_statements", "code", ["nb_name"])


@q(f"WITH {PROGRAMS} SELECT k AS nb_name, unnest(['a' || k, 'b' || k]) AS var FROM o")
def code_variables(spark, d):
    return dependencies.table_function(_programs(spark, d), "code_variables", "code", ["nb_name"])


@q("SELECT 'nb' || p_partkey AS nb_name, 'my_v' || p_size AS var FROM part")
def variable_names(spark, d):
    """The table variables of each notebook, from the names of its nodes."""
    k = F.col("p_partkey").cast("string")
    n = table(spark, d, "part").select(F.concat(F.lit("nb"), k).alias("nb_name"), F.concat(F.lit("3_my_v"), F.col("p_size").cast("string"), F.lit("_nb"), k).alias("node"), F.lit("Var").alias("node_type"))
    return graph_stats.table_variables(n)


@q(f"{_match_sql(2.0, 1.0)}, best AS (SELECT nb, max(score) AS score FROM sc GROUP BY nb) SELECT nb AS nb_name, round(greatest(coalesce(score, 0), 0), 6) AS score FROM (SELECT DISTINCT nb FROM n) LEFT JOIN best USING (nb) ORDER BY score DESC, nb_name LIMIT 200")
def raw_scores(spark, d):
    """Weights as they are given; notebooks without a match have 0. The 200 best are the feature."""
    got = search.search(conv_nodes(spark, d), conv_edges(spark, d), CHAIN, SearchConfig(k=200, normalise=False, include_unmatched=True), pair_sim=_data_sim(spark, d)(None))
    return got.select("nb_name", F.round("score", 6).alias("score"))


@q(f"{_match_sql(1.0, 4.0)} SELECT nb AS nb_name, round(score, 6) AS score FROM (SELECT nb, greatest(max(score), 0.0) AS score FROM sc GROUP BY nb ORDER BY score DESC, nb LIMIT 10)")
def topk_data_doubled(spark, d):
    """Data weighed twice, as the studied engine does."""
    got = search.search(conv_nodes(spark, d), conv_edges(spark, d), CHAIN, SearchConfig(w_data=2.0, data_weight_mode="reference"), pair_sim=_data_sim(spark, d)(None))
    return got.select("nb_name", F.round("score", 6).alias("score"))


SHOWN = query({"o1": OUTPUT, "c1": CELL}, [("o1", "c1")], {"c1": CHAIN_T[0]}, display={"o1": "text"})


@q(
    f"""WITH {N}, {E()}, m AS (SELECT e.nb, 0.5 + {jaccard_sql(tokens_sql(quoted(CHAIN_T[0])), tokens_sql('n.text'))} AS score FROM e JOIN n ON n.nb = e.nb AND n.node = e.dst WHERE src_label = 'Display_data' AND dst_label = 'Cell')
SELECT nb AS nb_name, round(max(score), 6) AS score FROM m GROUP BY nb ORDER BY max(score) DESC, nb LIMIT 200"""
)
def topk_outputs(spark, d):
    """A query graph that scores an output's kind. The 200 best are the feature."""
    got = search.search(conv_nodes(spark, d), conv_edges(spark, d), SHOWN, SearchConfig(k=200))
    return got.select("nb_name", F.round("score", 6).alias("score"))


@q(f"{_pairs_sql(('nation',), ('supplier',))} SELECT ca AS a_col, cb AS b_col, inter::DOUBLE / (n_a + n_b - inter) AS sim FROM s")
def without_index_columns(spark, d):
    """Columns that number the rows are not compared."""
    n = table(spark, d, "nation").withColumn("Unnamed: 0", F.col("n_nationkey")).withColumn("my_index", F.col("n_nationkey"))
    got = mapping.column_pairs(long_form(n, "nation", 1), values(spark, d, ("supplier",)))
    return got.select("a_col", "b_col", "sim")


@q("SELECT 'https://host/' || p_brand || '/' || p_type AS url FROM part")
def notebook_links(spark, d):
    return table(spark, d, "part").select(text.notebook_url("https://host/", "p_brand", "p_type").alias("url"))


@q(f"WITH v AS ({long_sql()}), r AS (SELECT table_name, col, dtype, count(*) AS n, count(DISTINCT value)::DOUBLE / count(*) AS ratio, any_value(col_pos) AS pos, count(*) OVER (PARTITION BY table_name) AS n_cols FROM v GROUP BY table_name, col, dtype), c AS (SELECT table_name, col FROM r WHERE n_cols <= 3 OR dtype <> 'float64' QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY ratio DESC, pos) <= 3) SELECT table_name, col, value FROM (SELECT DISTINCT table_name, col, value FROM v JOIN c USING (table_name, col) WHERE value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY table_name, col ORDER BY md5(value), value) <= 50")
def table_sketch(spark, d):
    """Of each table three columns, and of each fifty values: both numbers are the feature."""
    return profile.sketch(values(spark, d), columns=3, rows=50).select("table_name", "col", "value")


FROM_ANYWHERE = Query((QueryNode("a", ANY), QueryNode("c", CELL), QueryNode("v", VAR)), (("a", "c"), ("c", "v")))


@q(f"WITH RECURSIVE {N}, {E()}, r AS (SELECT nb, src, dst FROM e UNION SELECT r.nb, r.src, e.dst FROM r JOIN e ON e.nb = r.nb AND e.src = r.dst) SELECT r.nb AS nb_name, r.src AS a, e.src AS c, e.dst AS v FROM r JOIN e ON e.nb = r.nb AND e.src = r.dst WHERE e.src_label = 'Cell' AND e.dst_label = 'Var'")
def match_wildcard_root(spark, d):
    """A wildcard as the root starts from every node."""
    return match.find(conv_nodes(spark, d), conv_edges(spark, d), FROM_ANYWHERE, prefilter=False, wildcard_root=True).select("nb_name", "a", "c", "v")


@q(
    f"""SELECT nb_name, round(0.0 + coalesce(lib_sim, 0) * 1.0 + coalesce(overlap, 0) * 0.5 + coalesce(code_sim, 0) * 2.0 + coalesce(data_sim, 0) * 1.5, 6) AS score
FROM ({SQL['library_jaccard']}) FULL JOIN ({SQL['output_type_overlap']}) USING (nb_name) FULL JOIN ({SQL['whole_code_jaccard']}) USING (nb_name) FULL JOIN ({SQL['table_assignment']}) USING (nb_name)"""
)
def set_based_with_data(spark, d):
    """The set-based baseline with all four parts."""
    parts = {"lib": (library_jaccard(spark, d), "lib_sim", 1.0), "out": (output_type_overlap(spark, d), "overlap", 0.5), "code": (whole_code_jaccard(spark, d), "code_sim", 2.0), "data": (table_assignment(spark, d), "data_sim", 1.5)}
    return setbased.combined(parts).select("nb_name", F.round("score", 6).alias("score"))


@q(f"{parts_sql(False, 0.9)}, {GROUPS_SQL}, hits AS (SELECT b_table_name, 0.1 * {COL_SCORE} + 0.9 * row_sim AS score FROM best) SELECT 'g' || group_id AS nb_name, round(max(score), 6) AS data_sim FROM hits JOIN gr ON table_name = b_table_name GROUP BY group_id")
def table_assignment_search(spark, d):
    """The set-based data part by table search, a hit's score for all tables of its group; notebooks are the groups."""
    from .plans.data_similarity import table_pairs

    groups = spark.createDataFrame(list(GROUPS.items()), "table_name string, group_id int")
    found = table_pairs(values(spark, d, ("supplier",)), values(spark, d), how="groups", groups=groups)
    pairs = found.join(groups.withColumnRenamed("table_name", "b_table_name"), "b_table_name").select(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("nb_name"), F.col("a_table_name").alias("q"), F.col("b_table_name").alias("d"), "sim")
    return setbased.table_assignment(pairs, 1).select("nb_name", F.round("data_sim", 6).alias("data_sim"))
