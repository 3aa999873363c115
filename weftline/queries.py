"""The query catalogue: each operator on the test tables, with the same question in DuckDB SQL where SQL can ask it.

Conversations stand in for notebooks: a conversation is a notebook, a turn is a
node (user: Cell, assistant: Var, system: Display_data), the next turn its
successor, the text its code. Libraries and outputs are those of users' events.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import align, dependencies, text
from .model import CELL, OUTPUT, VAR, SearchConfig, query
from .operators import columns, graph_stats, keys, mapping, match, profile, provenance, quality, reach, scale, score, setbased, storage, tables
from .plans import search, table_search
from .sources.tables import long_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- carriers -------------------------------------------------------------


def conv_nodes(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    label = F.when(F.col("role") == "user", CELL).when(F.col("role") == "assistant", VAR).otherwise(OUTPUT)
    nb = F.col("conv_id").cast("string")
    return c.select(nb.alias("nb_name"), F.concat(nb, F.lit(":"), F.col("turn").cast("string")).alias("node"), label.alias("node_type"), F.when(label == OUTPUT, F.lit("text")).alias("display_type"), F.col("text").alias("cell_code"), "turn")


def conv_edges(spark, d, far: int = 1) -> DataFrame:
    """Each turn to the next `far` turns, where they are."""
    n = conv_nodes(spark, d)
    to = n.select("nb_name", F.col("node").alias("src"), F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + far)).alias("t"))
    e = to.select("nb_name", "src", F.concat("nb_name", F.lit(":"), F.col("t").cast("string")).alias("dst"), F.lit("Successor").alias("rel"))
    return graph_stats.valid_graph(n, e)[1]


def events_libraries(spark, d) -> DataFrame:
    """(nb_name, library): event type and k of the props of each user's events."""
    e = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    return e.select(F.col("user_id").cast("string").alias("nb_name"), F.concat_ws("_", "event_type", k.cast("string")).alias("library"))


TPC = {
    "region": {"r_regionkey": "int64", "r_name": "object"},
    "nation": {"n_nationkey": "int64", "n_name": "object", "n_regionkey": "int64"},
    "customer": {"c_custkey": "int64", "c_name": "object", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "object"},
    "supplier": {"s_suppkey": "int64", "s_name": "object", "s_nationkey": "int64", "s_acctbal": "float64"},
    "part": {"p_partkey": "int64", "p_name": "object", "p_brand": "object", "p_type": "object", "p_size": "int64", "p_retailprice": "float64"},
    "orders": {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderdate": "datetime64", "o_orderpriority": "object"},
    "lineitem": {"l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int64", "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64", "l_returnflag": "object", "l_linestatus": "object", "l_shipdate": "datetime64"},
}
GROUPS = {"customer": 1, "supplier": 1, "nation": 1, "region": 1, "part": 2, "orders": 3, "lineitem": 3}
DIMENSIONS = ("region", "nation", "customer", "supplier", "part")


def values(spark, d, names=tuple(TPC)) -> DataFrame:
    return long_tables(spark, {n: (table(spark, d, n), GROUPS[n]) for n in names})


# ---- SQL pieces -----------------------------------------------------------

N = "n AS (SELECT conv_id, turn, conv_id::VARCHAR AS nb, conv_id || ':' || turn AS node, CASE role WHEN 'user' THEN 'Cell' WHEN 'assistant' THEN 'Var' ELSE 'Display_data' END AS label, text FROM conversations)"


def E(far: int = 1) -> str:
    return f"e AS (SELECT a.nb, a.node AS src, b.node AS dst, a.label AS src_label, b.label AS dst_label FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + {far})"


DEGREES = "deg AS (SELECT nb, node, sum(o) AS o, sum(i) AS i FROM (SELECT nb, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT nb, dst, 0, 1 FROM e) GROUP BY ALL)"
STATS = f"{DEGREES}, st AS (SELECT n.nb, count(*) FILTER (label = 'Cell') AS n_cell, count(*) FILTER (label = 'Var') AS n_var, count(*) FILTER (label = 'Display_data') AS n_output, coalesce(max(deg.i), 0)::BIGINT AS max_in, coalesce(max(deg.o), 0)::BIGINT AS max_out FROM n LEFT JOIN deg ON deg.nb = n.nb AND deg.node = n.node GROUP BY n.nb)"


def PRE(qu, far: int = 1) -> str:
    need = " AND ".join(f"{m} >= {v}" for m, v in qu.stats().items())
    return f"WITH {N}, {E(far)}, {STATS}, ok AS (SELECT nb FROM st WHERE {need})"


def tokens_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({x}, '\\n|\\t| |,|='), lambda t: t <> ''), lambda t: string_split(t, '.'))))"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN coalesce(len({a}), 0) = 0 OR coalesce(len({b}), 0) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def long_sql(names=tuple(TPC)) -> str:
    """cell_values without row ids, as a union."""
    parts = []
    for t in names:
        for pos, (c, kind) in enumerate(TPC[t].items()):
            parts.append(f"SELECT '{t}' AS table_name, {GROUPS[t]} AS group_id, '{c}' AS col, {pos} AS col_pos, '{kind}' AS dtype, {c}::VARCHAR AS value FROM {t}")
    return " UNION ALL ".join(parts)


def cells_sql(names=tuple(TPC)) -> str:
    """cell_values with row ids, as a union."""
    parts = []
    for t in names:
        for c in TPC[t]:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS col, _r AS row_id, {c}::VARCHAR AS value FROM (SELECT *, row_number() OVER () AS _r FROM {t})")
    return " UNION ALL ".join(parts)


def greedy_sql(name: str, pairs: str, least: float | None = None) -> str:
    """CTEs for name: the greedy one-to-one matching, within each (ga, gb), of pairs' (ga, gb, l, r, s); needs WITH RECURSIVE."""
    where = "" if least is None else f" WHERE s >= {least}"
    return f"""{name}_r AS (SELECT ga, gb, l, r, s, row_number() OVER (PARTITION BY ga, gb ORDER BY s DESC, l, r) AS i FROM {pairs}{where}),
{name}_g AS (SELECT DISTINCT ga, gb, 0::BIGINT AS i, []::VARCHAR[] AS ls, []::VARCHAR[] AS rs, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::DOUBLE AS s FROM {name}_r
UNION ALL SELECT ga, gb, i, CASE WHEN free THEN list_append(ls, l) ELSE ls END, CASE WHEN free THEN list_append(rs, r) ELSE rs END, CASE WHEN free THEN l END, r, s FROM (SELECT x.ga, x.gb, x.i, g.ls, g.rs, x.l, x.r, x.s::DOUBLE AS s, NOT list_contains(g.ls, x.l) AND NOT list_contains(g.rs, x.r) AS free FROM {name}_g g JOIN {name}_r x ON x.ga = g.ga AND x.gb = g.gb AND x.i = g.i + 1)),
{name} AS (SELECT ga, gb, l, r, s FROM {name}_g WHERE l IS NOT NULL)"""


# ---- code and text similarity ----------------------------------------------


@q(
    f"""WITH b AS (SELECT item_id, {tokens_sql('text')} AS toks FROM benchmark), d AS (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents),
bt AS (SELECT item_id, len(toks) AS n, unnest(toks) AS tok FROM b), dt AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS tok FROM d),
p AS (SELECT item_id, doc_id, count(*) AS inter, any_value(bt.n) AS nb, any_value(dt.n) AS nd FROM bt JOIN dt USING (tok) GROUP BY ALL),
s AS (SELECT item_id, doc_id, inter::DOUBLE / (nb + nd - inter) AS sim FROM p)
SELECT item_id, doc_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""
)
def token_jaccard_benchmark_topk(spark, d):
    def toks(t, i, n):
        own = table(spark, d, t).select(i, text.code_tokens("text").alias("toks"))
        return own.select(i, F.size("toks").alias(n), F.explode("toks").alias("tok"))

    # the items' token index is the small side; documents stream past it and their counts combine before the shuffle
    p = toks("documents", "doc_id", "nd").join(toks("benchmark", "item_id", "nb"), "tok").groupBy("item_id", "doc_id").agg(F.count("*").alias("inter"), F.first("nb").alias("nb"), F.first("nd").alias("nd"))
    s = p.select("item_id", "doc_id", (F.col("inter") / (F.col("nb") + F.col("nd") - F.col("inter"))).alias("sim"))
    return score.top_k_per(s, ["item_id"], 3, [F.desc("sim"), F.asc("doc_id")]).select("item_id", "doc_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@q(
    f"""WITH t AS (SELECT item_id, {tokens_sql('text')} AS toks FROM benchmark), u AS (SELECT item_id, len(toks) AS n, unnest(toks) AS tok FROM t)
SELECT a.item_id AS a_id, b.item_id AS b_id, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS sim FROM u a JOIN u b ON a.tok = b.tok AND a.item_id < b.item_id GROUP BY ALL"""
)
def token_jaccard_pairs(spark, d):
    t = table(spark, d, "benchmark").select("item_id", text.code_tokens("text").alias("toks"))
    u = t.select("item_id", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    a, b = u.toDF("a_id", "na", "tok"), u.toDF("b_id", "nb", "tok")
    p = a.join(b, "tok").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return p.select("a_id", "b_id", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("sim"))


LINES = "list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''))"


@q(
    f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents), u AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line FROM l)
SELECT a.doc_id AS q_id, b.doc_id AS d_id, count(*) AS shared, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS sim FROM u a JOIN u b ON a.line = b.line WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL"""
)
def line_jaccard_search(spark, d):
    """Queries are the documents whose id is divisible by 100, against all documents."""
    u = table(spark, d, "documents").select("doc_id", text.code_lines("text").alias("ls"))
    u = u.select("doc_id", F.size("ls").alias("n"), F.explode("ls").alias("line"))
    u = u.select("doc_id", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    a, b = u.where("doc_id % 100 = 0").toDF("q_id", "na", "h1", "h2"), u.toDF("d_id", "nb", "h1", "h2")
    p = a.join(b, ["h1", "h2"]).where("q_id != d_id").groupBy("q_id", "d_id").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return p.select("q_id", "d_id", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("sim"))


@q("SELECT a.n_name AS a_name, b.n_name AS b_name, levenshtein(a.n_name, b.n_name)::INT AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein_pairs(spark, d):
    return _name_pairs(spark, d).select("a_name", "b_name", F.levenshtein("a_name", "b_name").alias("dist"))


def _name_pairs(spark, d):
    n = table(spark, d, "nation")
    return n.toDF("a", "a_name", "r").join(n.toDF("b", "b_name", "r"), "r").where("a < b")


@q(
    """WITH RECURSIVE p AS (SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
g AS (SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda k: 0::BIGINT) AS r FROM p UNION ALL
SELECT x, y, i, list_transform(range(0, length(y) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda t: base[t + 1] - (j - t)))) AS r FROM (SELECT x, y, i + 1 AS i, list_transform(range(0, length(y) + 1), lambda j: CASE WHEN j = 0 THEN 0::BIGINT ELSE greatest(0, r[j] + CASE WHEN substr(y, j, 1) = substr(x, i + 1, 1) THEN 1 ELSE -1 END, r[j + 1] - 1) END) AS base FROM g WHERE i < length(x)))
SELECT x AS a_name, y AS b_name, r[length(y) + 1]::DOUBLE / least(length(x), length(y)) AS sim FROM g WHERE i = length(x)"""
)
def suffix_alignment_pairs(spark, d):
    return _name_pairs(spark, d).select("a_name", "b_name", align.suffix_similarity("a_name", "b_name").alias("sim"))


@q(
    """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS q_id, b.vec_id AS d_id, list_cosine_similarity(a.e, b.e) AS sim FROM n a JOIN n b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT q_id, d_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, d_id) AS rank FROM s) WHERE rank <= 5"""
)
def cosine_search(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all vectors of their label."""
    e = table(spark, d, "embeddings")
    p = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "label", F.col("embedding").alias("x")).join(e.select(F.col("vec_id").alias("d_id"), "label", F.col("embedding").alias("y")), "label").where("q_id != d_id")
    s = p.select("q_id", "d_id", text.cosine("x", "y").alias("sim"))
    return score.top_k_per(s, ["q_id"], 5, [F.desc("sim"), F.asc("d_id")]).select("q_id", "d_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


# ---- workflow graphs ---------------------------------------------------------

CHAIN_T = ["the of and to in", "que de la the", "and a for is"]
CHAIN = query({"c1": CELL, "v1": VAR, "c2": CELL}, [("c1", "v1"), ("v1", "c2")], {"c1": CHAIN_T[0], "v1": CHAIN_T[1], "c2": CHAIN_T[2]})
STAR = query({"c1": CELL, "v1": VAR, "v2": VAR}, [("c1", "v1"), ("c1", "v2")])
DAG = query({"a": CELL, "b": VAR, "c": CELL}, [("a", "b"), ("a", "c"), ("b", "c")])
WILD = query({"a": CELL, "w": model.ANY, "b": VAR}, [("a", "w"), ("w", "b")])
ONE = query({"a": CELL, "x": model.ONE, "b": CELL}, [("a", "x"), ("x", "b")])


@q(f"WITH {N}, {E()}, {STATS} SELECT nb AS nb_name, n_cell, n_var, n_output, max_in, max_out FROM st")
def workflow_stats(spark, d):
    return graph_stats.workflow_stats(conv_nodes(spark, d), conv_edges(spark, d))


@q(
    f"""WITH {N}, {E()}, {STATS}, l AS (UNPIVOT (SELECT n_cell, n_var, n_output, max_in, max_out FROM st) ON n_cell, n_var, n_output, max_in, max_out INTO NAME metric VALUE v)
SELECT metric, min(v) AS min_v, max(v) AS max_v, avg(v) AS avg_v, sum(v)::BIGINT AS sum_v FROM l GROUP BY metric"""
)
def workflow_stats_summary(spark, d):
    return graph_stats.summary(workflow_stats(spark, d))


@q(f"{PRE(CHAIN)} SELECT nb AS nb_name FROM ok")
def structure_prefilter(spark, d):
    return graph_stats.structure_filter(workflow_stats(spark, d), CHAIN).select("nb_name")


@q(f"WITH {N}, {E()} SELECT nb AS nb_name, node FROM n WHERE label = 'Cell' AND NOT EXISTS (SELECT 1 FROM e WHERE e.nb = n.nb AND e.dst = n.node AND e.src_label = 'Cell')")
def workflow_roots(spark, d):
    return graph_stats.roots(conv_nodes(spark, d), conv_edges(spark, d))


@q(f"{PRE(CHAIN)} SELECT DISTINCT x.nb AS nb_name, x.src AS c1, x.dst AS v1, y.dst AS c2 FROM e x JOIN e y ON x.nb = y.nb AND x.dst = y.src JOIN ok ON ok.nb = x.nb WHERE x.src_label = 'Cell' AND x.dst_label = 'Var' AND y.dst_label = 'Cell'")
def match_chain(spark, d):
    return match.find(conv_nodes(spark, d), conv_edges(spark, d), CHAIN)


@q(f"{PRE(STAR, 3)} SELECT DISTINCT x.nb AS nb_name, x.src AS c1, x.dst AS v1, y.dst AS v2 FROM e x JOIN e y ON x.nb = y.nb AND x.src = y.src JOIN ok ON ok.nb = x.nb WHERE x.src_label = 'Cell' AND x.dst_label = 'Var' AND y.dst_label = 'Var'")
def match_star(spark, d):
    return match.find(conv_nodes(spark, d), conv_edges(spark, d, 3), STAR)


@q(f"{PRE(STAR, 3)} SELECT DISTINCT x.nb AS nb_name, x.src AS c1, x.dst AS v1, y.dst AS v2 FROM e x JOIN e y ON x.nb = y.nb AND x.src = y.src JOIN ok ON ok.nb = x.nb WHERE x.src_label = 'Cell' AND x.dst_label = 'Var' AND y.dst_label = 'Var' AND x.dst <> y.dst")
def match_injective(spark, d):
    return match.find(conv_nodes(spark, d), conv_edges(spark, d, 3), STAR, injective=True)


@q(f"{PRE(DAG, 2)} SELECT DISTINCT x.nb AS nb_name, x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.nb = y.nb AND x.src = y.src JOIN e z ON z.nb = x.nb AND z.src = x.dst AND z.dst = y.dst JOIN ok ON ok.nb = x.nb WHERE x.src_label = 'Cell' AND x.dst_label = 'Var' AND y.dst_label = 'Cell'")
def match_dag_crossedge(spark, d):
    return match.find(conv_nodes(spark, d), conv_edges(spark, d, 2), DAG)


@q(f"""WITH RECURSIVE {N}, {E()}, {STATS}, ok AS (SELECT nb FROM st WHERE {' AND '.join(f'{m} >= {v}' for m, v in WILD.stats().items())}),
r AS (SELECT nb, src, dst FROM e UNION SELECT r.nb, r.src, e.dst FROM r JOIN e ON e.nb = r.nb AND e.src = r.dst)
SELECT DISTINCT a.nb AS nb_name, a.node AS a, b.node AS b FROM r JOIN n a ON a.node = r.src JOIN n b ON b.node = r.dst JOIN ok ON ok.nb = r.nb WHERE a.label = 'Cell' AND b.label = 'Var'""")
def match_wildcard(spark, d):
    return match.find(conv_nodes(spark, d), conv_edges(spark, d), WILD)


@q(f"{PRE(ONE)} SELECT DISTINCT x.nb AS nb_name, x.src AS a, x.dst AS x, y.dst AS b FROM e x JOIN e y ON x.nb = y.nb AND x.dst = y.src JOIN ok ON ok.nb = x.nb WHERE x.src_label = 'Cell' AND y.dst_label = 'Cell'")
def match_one_wildcard(spark, d):
    return match.find(conv_nodes(spark, d), conv_edges(spark, d), ONE)


@q(f"WITH RECURSIVE {N}, {E()}, r AS (SELECT nb, src, dst FROM e UNION SELECT r.nb, r.src, e.dst FROM r JOIN e ON e.nb = r.nb AND e.src = r.dst) SELECT nb AS nb_name, src, dst FROM r")
def reach_closure(spark, d):
    return reach.closure(conv_edges(spark, d))


@q(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'all' AS nb, 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'all', 's' || s_suppkey, 'n' || s_nationkey FROM supplier), u AS (SELECT nb, a, b FROM e UNION SELECT nb, b, a FROM e),
r AS (SELECT nb, a, a AS b FROM u UNION SELECT r.nb, r.a, u.b FROM r JOIN u ON u.nb = r.nb AND u.a = r.b) SELECT nb AS nb_name, a AS node, min(b) AS component FROM r GROUP BY ALL"""
)
def graph_components(spark, d):
    """Suppliers, nations and regions."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(F.lit("all").alias("nb_name"), name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    return reach.components(n.unionByName(table(spark, d, "supplier").select(F.lit("all").alias("nb_name"), name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))))


def _scored(spark, d, config):
    n = score.code_similarity(conv_nodes(spark, d), CHAIN)
    n = score.with_pair_similarity(n, _data_sim(spark, d)(None), ["v1"])
    found = match.find(n, conv_edges(spark, d), CHAIN, carry=("sim_c1", "sim_c2", "sim_v1", "display_type"))
    return score.match_scores(found, CHAIN, config)


def _data_sim(spark, d):
    """Similarity of assistant turns to the query's table, here by their text."""

    def sims(asked):
        n = conv_nodes(spark, d).where(F.col("node_type") == VAR).select(F.lit("v1").alias("q"), F.col("node").alias("d"), text.token_jaccard(F.lit(CHAIN_T[1]), F.col("cell_code")).alias("sim"))
        return n if asked is None else n.join(asked, ["q", "d"], "left_semi")

    return sims


def _match_sql(w_code: float, w_data: float) -> str:
    def part(w, s):
        return f"({w} * {s})" if w > 0 else f"({-w} * (1 - {s}))"

    total = f"0.0 + {part(w_code / 2, 's1')} + {part(w_data, 's2')} + {part(w_code / 2, 's3')}"
    t = [tokens_sql(quoted(x)) for x in CHAIN_T]
    return f"""{PRE(CHAIN)}, k AS (SELECT nb, node, {tokens_sql('text')} AS toks FROM n), s AS (SELECT node, {jaccard_sql(t[0], 'toks')} AS s1, {jaccard_sql(t[1], 'toks')} AS s2, {jaccard_sql(t[2], 'toks')} AS s3 FROM k),
m AS (SELECT DISTINCT x.nb AS nb, x.src AS c1, x.dst AS v1, y.dst AS c2 FROM e x JOIN e y ON x.nb = y.nb AND x.dst = y.src JOIN ok ON ok.nb = x.nb WHERE x.src_label = 'Cell' AND x.dst_label = 'Var' AND y.dst_label = 'Cell'),
sc AS (SELECT nb, c1, v1, c2, ({total})::DOUBLE AS score FROM (SELECT m.*, a.s1, b.s2, c.s3 FROM m JOIN s a ON a.node = c1 JOIN s b ON b.node = v1 JOIN s c ON c.node = c2))"""


def _top_sql(w_code, w_data):
    return f"{_match_sql(w_code, w_data)} SELECT nb AS nb_name, round(score, 6) AS score FROM (SELECT nb, greatest(max(score), 0.0) AS score FROM sc GROUP BY nb ORDER BY score DESC, nb LIMIT 10)"


@q(f"{_match_sql(1.0, 1.0)} SELECT nb AS nb_name, c1, v1, c2, round(score, 6) AS score FROM sc")
def score_matches(spark, d):
    return _scored(spark, d, SearchConfig()).select("nb_name", "c1", "v1", "c2", F.round("score", 6).alias("score"))


@q(_top_sql(1.0, 1.0))
def topk_groups(spark, d):
    """The ten best conversations for a query graph; ten is the feature."""
    got = search.search(conv_nodes(spark, d), conv_edges(spark, d), CHAIN, SearchConfig(), pair_sim=_data_sim(spark, d)(None))
    return got.select("nb_name", F.round("score", 6).alias("score"))


@q(_top_sql(-1.0, 1.0))
def topk_dissimilar(spark, d):
    got = search.search(conv_nodes(spark, d), conv_edges(spark, d), CHAIN, SearchConfig(w_code=-1.0), pair_sim=_data_sim(spark, d)(None))
    return got.select("nb_name", F.round("score", 6).alias("score"))


@q(_top_sql(1.0, 1.0))
def topk_pruned(spark, d):
    got = search.pruned_search(conv_nodes(spark, d), conv_edges(spark, d), CHAIN, SearchConfig(), _data_sim(spark, d))
    return got.select("nb_name", F.round("score", 6).alias("score"))


@q(_top_sql(1.0, 1.0))
def topk_code_pruned(spark, d):
    """Code is compared last, for notebooks that can still be among the best."""
    got = search.code_pruned_search(conv_nodes(spark, d), conv_edges(spark, d), CHAIN, SearchConfig(), pair_sim=_data_sim(spark, d)(None))
    return got.select("nb_name", F.round("score", 6).alias("score"))


@q(
    f"""WITH RECURSIVE {N}, {E()}, r AS (SELECT nb, src, dst FROM e UNION SELECT r.nb, r.src, e.dst FROM r JOIN e ON e.nb = r.nb AND e.src = r.dst), t AS (SELECT nb, node FROM n WHERE label = 'Cell' AND NOT EXISTS (SELECT 1 FROM e WHERE e.nb = n.nb AND e.dst = n.node AND e.src_label = 'Cell')),
b AS (SELECT t.nb, t.node AS root, r.dst AS node FROM t JOIN r ON r.nb = t.nb AND r.src = t.node UNION SELECT nb, node, node FROM t)
SELECT b.nb AS nb_name, root, count(*) FILTER (label = 'Cell') AS n_cell, count(*) FILTER (label = 'Var') AS n_var, count(*) FILTER (label = 'Display_data') AS n_output FROM b JOIN n ON n.nb = b.nb AND n.node = b.node GROUP BY ALL"""
)
def root_workflow_stats(spark, d):
    e = conv_edges(spark, d)
    return graph_stats.root_workflow_stats(conv_nodes(spark, d), e, reach.closure(e))


@q(
    f"""WITH {N}, b AS (SELECT DISTINCT nb FROM n), k AS (SELECT DISTINCT 'Node' AS part, label AS name FROM n UNION ALL SELECT DISTINCT 'Outputs', 'text' FROM n WHERE label = 'Display_data'), c AS (SELECT nb, 'Node' AS part, label AS name, count(*) AS v FROM n GROUP BY ALL UNION ALL SELECT nb, 'Outputs', 'text', count(*) FROM n WHERE label = 'Display_data' GROUP BY ALL),
l AS (SELECT k.part, k.name, coalesce(c.v, 0) AS v FROM b CROSS JOIN k LEFT JOIN c ON c.nb = b.nb AND c.part = k.part AND c.name = k.name UNION ALL SELECT 'Table', 'table data', n_bytes FROM (SELECT sum(CASE WHEN dtype IN ('int64', 'bool') THEN 4 WHEN dtype = 'object' THEN length(value) ELSE 8 END)::BIGINT AS n_bytes FROM ({long_sql()}) WHERE value IS NOT NULL GROUP BY table_name))
SELECT part, name, min(v) AS min_v, max(v) AS max_v, avg(v) AS avg_v, sum(v)::BIGINT AS sum_v FROM l GROUP BY ALL"""
)
def dataset_summary(spark, d):
    return graph_stats.dataset_summary(conv_nodes(spark, d), profile.table_sizes(values(spark, d)))


@q(f"WITH {N} SELECT nb AS nb_name, label AS node_type, string_agg(node, ',' ORDER BY node) AS nodes FROM n GROUP BY ALL")
def label_lists(spark, d):
    return graph_stats.label_lists(conv_nodes(spark, d)).select("nb_name", "node_type", F.array_join("nodes", ",").alias("nodes"))


@q(
    f"""WITH {N}, {E()}, c AS (SELECT unnest(range(0, 3)) AS c), l AS (SELECT nb, max(node) AS last FROM n GROUP BY nb), nm AS (SELECT *, CASE WHEN c = 0 THEN '' ELSE 'cp' || c END AS suf FROM c),
nn AS (SELECT n.nb || suf AS nb, n.node || suf AS node FROM n JOIN l USING (nb), nm WHERE c = 0 OR c % 2 = 1 OR n.node <> l.last UNION ALL SELECT nb || suf, last || '+' || suf FROM l, nm WHERE c % 2 = 1),
ee AS (SELECT e.nb || suf AS nb, src || suf AS src FROM e JOIN l USING (nb), nm WHERE NOT (c > 0 AND c % 2 = 0 AND (src = last OR dst = last)) UNION ALL SELECT nb || suf, last || suf FROM l, nm WHERE c % 2 = 1)
SELECT nb AS nb_name, any_value(k) AS n_nodes, count(src) AS n_edges FROM (SELECT nb, count(*) AS k FROM nn GROUP BY nb) LEFT JOIN ee USING (nb) GROUP BY nb"""
)
def synthetic_scale(spark, d):
    n, e = scale.copies(conv_nodes(spark, d).select("nb_name", "node", "node_type"), conv_edges(spark, d), 3)
    return n.groupBy("nb_name").agg(F.count("*").alias("n_nodes")).join(e.groupBy("nb_name").agg(F.count("*").alias("n_edges")), "nb_name", "left").fillna(0, ["n_edges"])


# ---- libraries, outputs, set-based scores ----------------------------------------

LIBS = ["click_1", "click_2", "view_3", "purchase_4", "view_5"]
WANTED = {"click": 20, "view": 15, "purchase": 3}
LIB_SQL = "l AS (SELECT DISTINCT user_id::VARCHAR AS nb, concat_ws('_', event_type, (props->>'$.k')) AS library FROM events)"


def _lib_part() -> str:
    wanted = ", ".join(map(quoted, LIBS))
    return f"lib AS (SELECT nb, (count(*) FILTER (library IN ({wanted})))::DOUBLE / (count(*) + {len(LIBS)} - count(*) FILTER (library IN ({wanted}))) AS lib_sim FROM l GROUP BY nb)"


def _out_part() -> str:
    hit = " + ".join(f"least(count(*) FILTER (event_type = '{t}'), {n})" for t, n in WANTED.items())
    return f"ov AS (SELECT user_id::VARCHAR AS nb, ({hit})::DOUBLE / {sum(WANTED.values())} AS overlap FROM events GROUP BY ALL)"


@q(f"WITH {LIB_SQL}, {_lib_part()} SELECT nb AS nb_name, lib_sim FROM lib")
def library_jaccard(spark, d):
    return setbased.library_overlap(events_libraries(spark, d), LIBS)


@q(f"WITH {_out_part()} SELECT nb AS nb_name, overlap FROM ov")
def output_type_overlap(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("nb_name"), F.col("event_type").alias("data_type"))
    return setbased.output_overlap(e, WANTED)


WHOLE = f"w AS (SELECT conv_id, array_to_string(list_filter(list_transform(string_split(string_agg(text, chr(10) ORDER BY turn), chr(10)), lambda x: regexp_replace(x, '#.*$', '')), lambda x: trim(x) <> ''), chr(10)) AS code FROM conversations GROUP BY conv_id)"


@q(f"WITH {WHOLE}, t AS (SELECT conv_id, {tokens_sql('code')} AS toks FROM w) SELECT conv_id::VARCHAR AS nb_name, {jaccard_sql(tokens_sql(quoted(CHAIN_T[0])), 'toks')} AS code_sim FROM t")
def whole_code_jaccard(spark, d):
    c = conv_nodes(spark, d).select("nb_name", F.col("turn").alias("cell_id"), "cell_code")
    return setbased.code_overlap(c, CHAIN_T[0])


@q(
    f"""WITH {LIB_SQL}, {_lib_part()}, {_out_part()}, {WHOLE}, t AS (SELECT conv_id, {tokens_sql('code')} AS toks FROM w), co AS (SELECT conv_id::VARCHAR AS nb, {jaccard_sql(tokens_sql(quoted(CHAIN_T[0])), 'toks')} AS code_sim FROM t)
SELECT nb AS nb_name, round(0.0 + coalesce(lib_sim, 0) * 1.0 + coalesce(overlap, 0) * 0.5 + coalesce(code_sim, 0) * 2.0, 6) AS score FROM lib FULL JOIN ov USING (nb) FULL JOIN co USING (nb)"""
)
def set_based_sum(spark, d):
    got = setbased.combined({"lib": (library_jaccard(spark, d), "lib_sim", 1.0), "out": (output_type_overlap(spark, d), "overlap", 0.5), "code": (whole_code_jaccard(spark, d), "code_sim", 2.0)})
    return got.select("nb_name", F.round("score", 6).alias("score"))


def _cell_pairs(spark, d):
    cells = conv_nodes(spark, d).where(F.col("node_type") == CELL)
    asked = F.explode(F.array(*(F.struct(F.lit(f"q{i}").alias("q"), F.lit(t).alias("t")) for i, t in enumerate(CHAIN_T))))
    p = cells.select("nb_name", F.col("node").alias("d"), "cell_code", asked.alias("x"))
    return p.select("nb_name", "x.q", "d", text.token_jaccard(F.col("x.t"), F.col("cell_code")).alias("sim"))


CELL_SIMS = f"p AS ({' UNION ALL '.join(f'''SELECT nb, 'q{i}' AS q, node AS d, {jaccard_sql(tokens_sql(quoted(t)), 'toks')} AS sim FROM (SELECT nb, node, {tokens_sql('text')} AS toks FROM n WHERE label = 'Cell')''' for i, t in enumerate(CHAIN_T))})"


@q(f"WITH RECURSIVE {N}, {CELL_SIMS}, p0 AS (SELECT nb AS ga, '' AS gb, q AS l, d AS r, sim AS s FROM p), {greedy_sql('m', 'p0')} SELECT ga AS nb_name, round(sum(s), 6) AS code_sim FROM m GROUP BY ga")
def greedy_cell_matching(spark, d):
    return setbased.greedy_cells(_cell_pairs(spark, d)).select("nb_name", F.round("code_sim", 6).alias("code_sim"))


@q()
def best_cell_alignment(spark, d):
    """Query cells against each notebook's cells by suffix alignment of their texts, the mean of the best."""
    cells = conv_nodes(spark, d).where(F.col("node_type") == CELL)
    asked = F.explode(F.array(*(F.struct(F.lit(f"q{i}").alias("q"), F.lit(t).alias("t")) for i, t in enumerate(CHAIN_T))))
    p = cells.select("nb_name", F.col("node").alias("d"), "cell_code", asked.alias("x")).select("nb_name", "x.q", "d", align.suffix_similarity("x.t", "cell_code").alias("sim"))
    return setbased.best_cells(p, 3).select("nb_name", F.round("code_sim", 6).alias("code_sim"))


@q(f"WITH {N}, {CELL_SIMS} SELECT nb AS nb_name, round(sum(sim) / 3, 6) AS code_sim FROM (SELECT nb, q, max(sim) AS sim FROM p GROUP BY ALL) GROUP BY nb")
def best_cell_matching(spark, d):
    return setbased.best_cells(_cell_pairs(spark, d), 3).select("nb_name", F.round("code_sim", 6).alias("code_sim"))


@q(
    f"""WITH {N}, {CELL_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY nb ORDER BY sim DESC, q, d) AS k, count(*) OVER (PARTITION BY nb) AS c FROM p)
SELECT nb AS nb_name, round(CASE WHEN max(c) >= 3 THEN sum(sim) ELSE 0 END, 6) AS data_sim FROM (SELECT nb, q, max(sim) AS sim, max(c) AS c FROM r WHERE k <= 3 GROUP BY ALL) GROUP BY nb"""
)
def table_assignment(spark, d):
    return setbased.table_assignment(_cell_pairs(spark, d), 3).select("nb_name", F.round("data_sim", 6).alias("data_sim"))


@q("SELECT user_id::VARCHAR AS nb_name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY ALL")
def output_sets(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("nb_name"), F.col("event_type").alias("data_type"), F.lit(1).alias("cell_id"))
    return graph_stats.output_sets(e).select("nb_name", F.array_join("types", ",").alias("types"))


# ---- tables ------------------------------------------------------------------------


@q(f"WITH v AS ({long_sql()}) SELECT table_name, col, col_pos, dtype, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT value) AS n_distinct, count(DISTINCT value)::DOUBLE / count(*) AS ratio FROM v GROUP BY ALL")
def column_profile(spark, d):
    return profile.column_profile(values(spark, d))


@q(
    f"""WITH v AS ({long_sql()}), p0 AS (SELECT table_name, col, col_pos, dtype, count(DISTINCT value)::DOUBLE / count(*) AS ratio FROM v GROUP BY ALL), p AS (SELECT *, count(*) OVER (PARTITION BY table_name) AS n_cols FROM p0),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY ratio DESC, col_pos) AS rank FROM p WHERE n_cols <= 5 OR dtype <> 'float64') SELECT table_name, col, rank FROM r WHERE rank <= 5"""
)
def sketch_columns(spark, d):
    got = profile.sketch_columns(profile.column_profile(values(spark, d)))
    return got.select("table_name", "col", F.col("rank").cast("long").alias("rank"))


@q(f"WITH v AS ({long_sql()}), c AS (SELECT DISTINCT group_id, table_name, col, col_pos, dtype FROM v), n AS (SELECT group_id, col, count(DISTINCT value) AS n_distinct FROM v GROUP BY ALL) SELECT c.group_id, c.col, row_number() OVER (PARTITION BY c.group_id ORDER BY table_name, col_pos, c.col)::INT AS sid, dtype, 1::BIGINT AS n_tables, n_distinct FROM c JOIN n ON n.group_id = c.group_id AND n.col = c.col")
def schema_index(spark, d):
    return profile.schema_index(values(spark, d))


def _pairs_sql(a, b) -> str:
    return f"""WITH a AS (SELECT DISTINCT table_name, col, dtype, value FROM ({long_sql(a)}) WHERE value IS NOT NULL), b AS (SELECT DISTINCT table_name, col, dtype, value FROM ({long_sql(b)}) WHERE value IS NOT NULL),
na AS (SELECT table_name, col, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT table_name, col, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT a.table_name AS ta, a.col AS ca, b.table_name AS tb, b.col AS cb, a.dtype, count(*) AS inter FROM a JOIN b ON a.dtype = b.dtype AND a.value = b.value GROUP BY ALL),
s AS (SELECT p.*, na.n AS n_a, nb.n AS n_b FROM p JOIN na ON na.table_name = ta AND na.col = ca JOIN nb ON nb.table_name = tb AND nb.col = cb)"""


@q(f"{_pairs_sql(('nation',), ('customer', 'supplier', 'region'))} SELECT ta AS a_table_name, ca AS a_col, tb AS b_table_name, cb AS b_col, dtype, inter, n_a, n_b, inter::DOUBLE / (n_a + n_b - inter) AS sim FROM s")
def column_jaccard(spark, d):
    return mapping.column_pairs(values(spark, d, ("nation",)), values(spark, d, ("customer", "supplier", "region")))


@q(f"{_pairs_sql(tuple(TPC), tuple(TPC))} SELECT ta AS a_table_name, ca AS a_col, tb AS b_table_name, cb AS b_col, inter::DOUBLE / least(n_a, n_b) AS containment FROM s WHERE ta < tb")
def containment_join_keys(spark, d):
    v = values(spark, d)
    return keys.containment(mapping.column_pairs(v, v)).where("a_table_name < b_table_name").select("a_table_name", "a_col", "b_table_name", "b_col", "containment")


@q()
def advisory_join_keys(spark, d):
    v = values(spark, d).withColumn("col", F.regexp_replace("col", "^[a-z]+_", ""))
    return keys.join_keys(mapping.column_pairs(v, v).where("a_table_name < b_table_name"))


#: Similarities of all column pairs of all tables, as (ga, gb, l, r, s).
ALL_PAIRS = _pairs_sql(tuple(TPC), tuple(TPC)).replace("WITH a AS", "WITH RECURSIVE a AS", 1) + ", p0 AS (SELECT ta AS ga, tb AS gb, ca AS l, cb AS r, inter::DOUBLE / (n_a + n_b - inter) AS s FROM s WHERE ta <> tb)"


@q(f"{ALL_PAIRS}, {greedy_sql('m', 'p0', 0.3)} SELECT ga AS a_table_name, gb AS b_table_name, l AS a_col, r AS b_col, s AS sim FROM m")
def schema_mapping(spark, d):
    v = values(spark, d)
    return mapping.map_tables(v, v).where("a_table_name != b_table_name")


STEM = "regexp_replace(col, '^[a-z]+_', '')"


@q(
    f"""{ALL_PAIRS}, c AS (SELECT DISTINCT table_name, col, dtype, {STEM} AS stem FROM ({long_sql()})),
k AS (SELECT x.table_name AS ga, y.table_name AS gb, x.col AS l, y.col AS r, coalesce(p0.s, 0.0) AS s FROM c x JOIN c y ON x.stem = y.stem AND x.dtype = y.dtype AND x.table_name <> y.table_name LEFT JOIN p0 ON p0.ga = x.table_name AND p0.gb = y.table_name AND p0.l = x.col AND p0.r = y.col),
f AS (SELECT * FROM p0 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.ga = p0.ga AND k.gb = p0.gb AND (k.l = p0.l OR k.r = p0.r))), {greedy_sql('m', 'f', 0.3)}
SELECT ga AS a_table_name, gb AS b_table_name, l AS a_col, r AS b_col, s AS sim FROM k UNION ALL SELECT ga, gb, l, r, s FROM m"""
)
def schema_mapping_extended(spark, d):
    """Columns of one name (without prefix) and dtype are known pairs; the others are mapped by their values."""
    v = values(spark, d)
    names = v.select("table_name", "col", "dtype").distinct().withColumn("stem", F.regexp_replace("col", "^[a-z]+_", ""))
    left, right = (names.select(F.col("table_name").alias(f"{s}_table_name"), F.col("col").alias(f"{s}_col"), "dtype", "stem") for s in "ab")
    known = left.join(right, ["dtype", "stem"]).where("a_table_name != b_table_name").drop("dtype", "stem")
    known = known.join(mapping.column_pairs(v, v).select("a_table_name", "b_table_name", "a_col", "b_col", "sim"), ["a_table_name", "b_table_name", "a_col", "b_col"], "left").fillna(0.0, ["sim"])
    return mapping.extend_mapping(known, v, v).where("a_table_name != b_table_name")


@q(
    f"""WITH v AS ({long_sql()}), a AS (SELECT DISTINCT table_name, col, value FROM v WHERE value IS NOT NULL), g AS (SELECT DISTINCT group_id, col, value FROM v WHERE value IS NOT NULL),
na AS (SELECT table_name, col, count(*) AS n FROM a GROUP BY ALL), ng AS (SELECT group_id, col, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT a.table_name, a.col AS ca, g.group_id, g.col AS cg, count(*) AS inter FROM a JOIN g ON a.value = g.value GROUP BY ALL)
SELECT p.table_name AS a_table_name, p.group_id AS b_group_id, max(inter::DOUBLE / (na.n + ng.n - inter)) AS best FROM p JOIN na ON na.table_name = p.table_name AND na.col = ca JOIN ng ON ng.group_id = p.group_id AND ng.col = cg GROUP BY ALL HAVING max(inter::DOUBLE / (na.n + ng.n - inter)) >= 0.3"""
)
def matching_groups(spark, d):
    v = values(spark, d)
    return mapping.matching_groups(v, profile.schema_values(v))


@q(f"{ALL_PAIRS}, {greedy_sql('m', 'p0')}, w AS (SELECT table_name, count(DISTINCT col) AS n FROM ({long_sql()}) GROUP BY ALL) SELECT ga AS a_table_name, gb AS b_table_name, count(*) AS n_mapped, round(sum(s) / greatest(any_value(x.n), any_value(y.n)), 6) AS sim FROM m JOIN w x ON x.table_name = ga JOIN w y ON y.table_name = gb GROUP BY ALL")
def table_similarity(spark, d):
    v = values(spark, d)
    return tables.table_similarity(v, v).where("a_table_name != b_table_name").select("a_table_name", "b_table_name", "n_mapped", F.round("sim", 6).alias("sim"))


@q(f"{ALL_PAIRS.replace('FROM s WHERE ta <> tb)', 'FROM s WHERE ta = ' + quoted('supplier') + ')')}, {greedy_sql('m', 'p0')}, w AS (SELECT table_name, count(DISTINCT col) AS n FROM ({long_sql()}) GROUP BY ALL), t AS (SELECT gb, sum(s) / greatest(any_value(x.n), any_value(y.n)) AS sim FROM m JOIN w x ON x.table_name = 'supplier' JOIN w y ON y.table_name = gb GROUP BY gb) SELECT 'v1' AS q, 'var_' || w.table_name AS d, round(coalesce(sim, 0), 6) AS sim FROM w LEFT JOIN t ON gb = w.table_name")
def data_similarity(spark, d):
    """A query table, with the values of supplier, and the table variables of a workflow."""
    from .plans.data_similarity import pair_similarity

    v = values(spark, d)
    variables = spark.createDataFrame([(f"var_{t}", t) for t in TPC], "d string, table_name string")
    got, _ = pair_similarity(values(spark, d, ("supplier",)).withColumn("table_name", F.lit("v1")), v, variables)
    return got.select("q", "d", F.round("sim", 6).alias("sim"))


@q(
    f"""WITH c AS (SELECT table_name, dtype, count(DISTINCT col) AS n FROM ({long_sql()}) GROUP BY ALL), t AS (SELECT table_name, sum(n) AS n FROM c GROUP BY table_name)
SELECT a.table_name AS a_table_name, b.table_name AS b_table_name, sum(least(a.n, b.n))::DOUBLE / any_value(t.n)::DOUBLE AS sim FROM c a JOIN c b ON a.dtype = b.dtype JOIN t ON t.table_name = a.table_name GROUP BY ALL"""
)
def dtype_similarity(spark, d):
    v = values(spark, d)
    return tables.dtype_similarity(v, v)


@q("WITH a AS (SELECT DISTINCT c_nationkey AS v FROM customer), b AS (SELECT DISTINCT s_nationkey AS v FROM supplier) SELECT count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL)::DOUBLE / count(*) AS sim FROM a FULL JOIN b ON a.v = b.v")
def row_similarity(spark, d):
    return tables.row_similarity(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey"))


KEYED = "WITH a AS (SELECT o_orderkey AS k, o_orderdate AS x FROM orders), b AS (SELECT l_orderkey AS k, l_shipdate AS x FROM lineitem), u AS (SELECT k, x FROM a UNION ALL SELECT k, x FROM b), "


def _keyed(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("x")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("x"))


@q(
    KEYED
    + """r AS (SELECT (SELECT count(DISTINCT k)::DOUBLE / count(*) FROM a) AS ratio_a, (SELECT count(DISTINCT k)::DOUBLE / count(*) FROM b) AS ratio_b, (SELECT count(*) FROM (SELECT DISTINCT k, x FROM u))::DOUBLE / (SELECT count(*) FROM u) AS dist)
SELECT ratio_a, ratio_b, CASE WHEN least(ratio_a, ratio_b) <= 0.2 THEN 0.0 ELSE dist END AS score FROM r"""
)
def key_score(spark, d):
    return keys.key_score(*_keyed(spark, d), "k", ["x"], prune=0.2)


@q(
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS na FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS nb FROM lineitem GROUP BY 1), f AS (SELECT * FROM a FULL JOIN b USING (k)),
r AS (SELECT count(na)::DOUBLE / sum(na) AS ratio_a, count(nb)::DOUBLE / sum(nb) AS ratio_b, coalesce(count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL)::DOUBLE / sum(na) FILTER (nb IS NOT NULL), 0.0) AS score_a, coalesce(count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL)::DOUBLE / sum(nb) FILTER (na IS NOT NULL), 0.0) AS score_b FROM f)
SELECT *, CASE WHEN ratio_a = 1 OR ratio_b = 1 THEN 1.0 WHEN least(ratio_a, ratio_b) < 0.0001 THEN 0.0 ELSE greatest(score_a, score_b) END AS score FROM r"""
)
def join_key_score(spark, d):
    li = table(spark, d, "lineitem")
    return keys.join_key_score(li.select(F.col("l_suppkey").alias("k")), li.select(F.col("l_partkey").alias("k")), "k", prune=0.0001)


@q(
    """WITH o AS (SELECT o_custkey AS k, list_distinct([o_orderstatus, o_orderpriority]) AS x FROM orders), s AS (SELECT k, avg(len(list_intersect(a.x, b.x))::DOUBLE / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x)))) AS s FROM o a JOIN o b USING (k) GROUP BY k) SELECT round(avg(s), 6) AS sim, count(*) AS n_keys FROM s"""
)
def row_string_similarity(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", "o_orderpriority")
    got = tables.row_string_similarity(o, o, "k", ["o_orderstatus", "o_orderpriority"])
    return got.select(F.round("sim", 6).alias("sim"), "n_keys")


def parts_sql(join: bool, prune: float, names=tuple(TPC)) -> str:
    """CTEs up to `best`: of supplier and each other table that it maps to the key, its score and the similarity of its values."""
    pairs = ALL_PAIRS.replace("FROM s WHERE ta <> tb)", "FROM s WHERE ta <> tb AND ta = 'supplier')")
    score = "CASE WHEN va = ra OR vb = rb THEN 1.0 WHEN least(va::DOUBLE / ra, vb::DOUBLE / rb) < {0} THEN 0.0 ELSE greatest(oa, ob)::DOUBLE / (ra + rb) END" if join else "CASE WHEN least(va::DOUBLE / ra, vb::DOUBLE / rb) <= {0} THEN 0.0 ELSE different::DOUBLE / (ra + rb) END"
    return f"""{pairs}, {greedy_sql('m', 'p0', 0.3)}, cells AS ({cells_sql()}),
mc AS (SELECT ga, gb, 'a' AS side, row_id, l AS a_col, value FROM cells JOIN m ON table_name = ga AND col = l UNION ALL SELECT ga, gb, 'b', row_id, l, value FROM cells JOIN m ON table_name = gb AND col = r),
rows_ AS (SELECT ga, gb, side, list(struct_pack(a_col := a_col, value := value) ORDER BY a_col) AS r FROM mc GROUP BY ga, gb, side, row_id),
df AS (SELECT ga, gb, r, count(*) FILTER (side = 'a') AS in_a, count(*) FILTER (side = 'b') AS in_b FROM rows_ GROUP BY ga, gb, r),
tot AS (SELECT ga, gb, count(*) AS different, sum(in_a) AS ra, sum(in_b) AS rb FROM df GROUP BY ga, gb), x AS (SELECT ga, gb, in_a, in_b, unnest(r) AS x FROM df),
bv AS (SELECT ga, gb, x.a_col AS a_col, x.value AS value, count(*) AS n, sum(in_a) AS in_a, sum(in_b) AS in_b FROM x GROUP BY ALL),
ok AS (SELECT ga, gb, a_col, count(*) FILTER (in_a > 0) AS va, count(*) FILTER (in_b > 0) AS vb, sum(CASE WHEN in_a > 0 THEN n ELSE 0 END) AS oa, sum(CASE WHEN in_b > 0 THEN n ELSE 0 END) AS ob FROM bv GROUP BY ALL),
ks AS (SELECT ok.ga, ok.gb, a_col, {score.format(prune)} AS score, m.s AS sim, ra, rb FROM ok JOIN tot ON tot.ga = ok.ga AND tot.gb = ok.gb JOIN m ON m.ga = ok.ga AND m.gb = ok.gb AND m.l = a_col),
kr AS (SELECT *, row_number() OVER (PARTITION BY ga, gb ORDER BY score DESC, sim DESC, a_col) AS k FROM ks), nm AS (SELECT ga, gb, count(*) AS n_mapped FROM m GROUP BY ga, gb),
w AS (SELECT table_name, count(DISTINCT col) AS n FROM cells GROUP BY ALL),
best AS (SELECT kr.ga AS a_table_name, kr.gb AS b_table_name, n_mapped, a_col AS key, score AS key_score, sim AS row_sim, ra, rb, wa.n AS an, wb.n AS bn FROM kr JOIN nm ON nm.ga = kr.ga AND nm.gb = kr.gb JOIN w wa ON wa.table_name = kr.ga JOIN w wb ON wb.table_name = kr.gb WHERE k = 1)"""


COL_SCORE = "(1.0 + (n_mapped - 1) * key_score) / (bn + (an - n_mapped))"


def ranked_sql(score: str, columns: str, source: str = "best") -> str:
    return f"SELECT a_table_name, b_table_name, {columns}, round(score, 6) AS score, row_number() OVER (PARTITION BY a_table_name ORDER BY score DESC, b_table_name) AS rank FROM (SELECT *, {score} AS score FROM {source}) QUALIFY rank <= 10"


def _hits(found, *more):
    return found.select("a_table_name", "b_table_name", *more, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"{parts_sql(False, 0.9)} {ranked_sql(f'0.1 * {COL_SCORE} + 0.9 * row_sim', 'n_mapped, key')}")
def search_similar_topk(spark, d):
    return _hits(table_search.similar(values(spark, d, ("supplier",)), values(spark, d)), "n_mapped", "key")


@q(f"{parts_sql(True, 0.2)} {ranked_sql('0.1 * ((1.0 + (greatest(an, bn) - 1) * key_score) / greatest(bn + an - n_mapped - 1, 1)) + 0.9 * row_sim', 'n_mapped, key')}")
def search_joinable_topk(spark, d):
    return _hits(table_search.joinable(values(spark, d, ("supplier",)), values(spark, d)), "n_mapped", "key")


@q(f"{parts_sql(False, 0.9)} {ranked_sql('0.1 * ((1.0 + (greatest(an, bn) - 1) * key_score) / greatest(bn + an - n_mapped, 1)) + 0.9 * row_sim', 'n_mapped, key')}")
def table_joinability(spark, d):
    """Joinability by the common key, of supplier and every table that it maps to."""
    parts = table_search.pair_scores(values(spark, d, ("supplier",)), values(spark, d))
    return _hits(score.top_k_per(table_search.joinability(parts, less=0), ["a_table_name"], 10, [F.desc("score"), F.asc("b_table_name")]), "n_mapped", "key")


def _kind_stars(spark, d):
    """One star a table, with the columns' dtypes for labels: a stand-in for the code that made it."""
    v = values(spark, d).select("table_name", "col", "dtype").distinct()
    return v.select(F.col("table_name").alias("graph_id"), F.lit("x").alias("node"), F.col("dtype").alias("label"))


def _distances(spark, d):
    s = _kind_stars(spark, d)
    return provenance.mapping_distance(s.where("graph_id = 'supplier'"), s).select(F.col("b_id").alias("b_table_name"), F.col("distance").cast("double").alias("distance"))


DISTANCES = f"""kc AS (SELECT table_name, dtype, count(DISTINCT col) AS n FROM ({long_sql()}) GROUP BY ALL), kt AS (SELECT table_name, sum(n) AS n FROM kc GROUP BY ALL), kj AS (SELECT b.table_name, sum(least(a.n, b.n)) AS same FROM kc a JOIN kc b ON a.dtype = b.dtype WHERE a.table_name = 'supplier' GROUP BY ALL),
dist AS (SELECT b.table_name, (abs(a.n - b.n) + greatest(a.n, b.n) - coalesce(same, 0))::DOUBLE AS distance FROM kt b JOIN kt a ON a.table_name = 'supplier' LEFT JOIN kj ON kj.table_name = b.table_name)"""


@q(f"{parts_sql(False, 0.9)}, {DISTANCES}, far AS (SELECT best.*, distance FROM best JOIN dist ON dist.table_name = b_table_name) {ranked_sql('0.5 * ((1.0 + (n_mapped - 1)) / (bn + (an - n_mapped))) + 0.5 / (distance + 1)', 'n_mapped', 'far').replace('n_mapped, round', 'round')}")
def search_additional_training(spark, d):
    return _hits(table_search.additional_training(values(spark, d, ("supplier",)), values(spark, d), _distances(spark, d)))


@q(f"{parts_sql(False, 0.9)}, {DISTANCES}, far AS (SELECT best.*, distance FROM best JOIN dist ON dist.table_name = b_table_name) {ranked_sql(f'90.0 * {COL_SCORE} + 200.0 * row_sim / (abs(ra - rb) + 1) + 0.1 * distance', 'key', 'far')}")
def search_alternative_features(spark, d):
    return _hits(table_search.alternative_features(values(spark, d, ("supplier",)), values(spark, d), _distances(spark, d)), "key")


@q("WITH e AS (SELECT count(*) AS n FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)), f AS (SELECT count(*) AS n FROM (SELECT r_regionkey FROM region EXCEPT ALL SELECT n_regionkey FROM nation)) SELECT e.n = 0 AS a_in_b, f.n = 0 AS b_in_a, (SELECT count(*) FROM nation) AS n_a, (SELECT count(*) FROM region) AS n_b FROM e, f")
def union_row_containment(spark, d):
    return storage.union_rows(table(spark, d, "nation").select(F.col("n_regionkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k")))


@q("SELECT (SELECT count(*) FROM customer) AS n_a, (SELECT count(*) FROM supplier) AS n_b, (SELECT count(*) FROM customer JOIN supplier ON c_nationkey = s_nationkey) AS n_joined")
def key_selectivity(spark, d):
    return storage.key_selectivity(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


COST = "0.1 * p_size + 0.9 * p_retailprice"


@q(f"WITH c AS (SELECT p_partkey, {COST} AS separate, 0.1 * (p_size * 3) + 0.9 * p_size AS lineage, CASE WHEN p_size > 25 THEN 0.1 * p_size + 0.9 * (p_size * 2) END AS \"join\", CASE WHEN p_brand LIKE '%1' THEN 0.1 * p_size + 0.9 * 1 END AS \"union\" FROM part), m AS (SELECT *, least(separate, lineage, coalesce(\"join\", 1e300), coalesce(\"union\", 1e300)) AS cost FROM c) SELECT p_partkey, CASE WHEN separate = cost THEN 'separate' WHEN lineage = cost THEN 'lineage' WHEN \"join\" = cost THEN 'join' ELSE 'union' END AS strategy, round(cost, 6) AS cost FROM m")
def storage_strategy(spark, d):
    p = table(spark, d, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    c = p.select("p_partkey", storage.cost(size, price).alias("separate"), storage.cost(size * 3, size).alias("lineage"), F.when(size > 25, storage.cost(size, size * 2)).alias("join"), F.when(F.col("p_brand").like("%1"), storage.cost(size, F.lit(1))).alias("union"))
    return storage.choose(c, ["p_partkey"]).withColumn("cost", F.round("cost", 6))


def _size_sql(distinct: bool) -> str:
    return f"WITH v AS (SELECT {'DISTINCT ' if distinct else ''}table_name, col, dtype, value FROM ({long_sql()}) WHERE value IS NOT NULL) SELECT table_name, count(DISTINCT col) AS n_cols, count(*) AS n_cells, sum(CASE WHEN dtype IN ('int64', 'bool') THEN 4 WHEN dtype = 'object' THEN length(value) ELSE 8 END)::BIGINT AS n_bytes FROM v GROUP BY table_name"


@q(_size_sql(False))
def table_size(spark, d):
    return profile.table_sizes(values(spark, d))


@q(_size_sql(True))
def table_size_unique(spark, d):
    return profile.table_sizes(values(spark, d), distinct=True)


@q(f"WITH s AS ({_size_sql(False)}) SELECT min(n_bytes) AS min_bytes, max(n_bytes) AS max_bytes, avg(n_bytes) AS avg_bytes, sum(n_bytes)::BIGINT AS sum_bytes, count(*) FILTER (n_cells = 0) AS n_empty FROM s")
def table_size_summary(spark, d):
    return profile.size_summary(profile.table_sizes(values(spark, d)))


def _repeated(spark, d):
    """All tables, two of them again in another row order, and nation with its names turned round: equal cells in different rows."""
    n, o = table(spark, d, "nation"), table(spark, d, "orders")
    turned = n.select("n_nationkey", "n_regionkey").join(n.select((24 - F.col("n_nationkey")).alias("n_nationkey"), "n_name"), "n_nationkey").select(*n.columns)
    more = long_tables(spark, {"nation_again": (n.orderBy(F.desc("n_name")), 1), "nation_turned": (turned, 1), "orders_again": (o.orderBy("o_custkey"), 3)})
    return values(spark, d).unionByName(more)


def _digest_sql(t: str, source: str, name: str) -> str:
    row = " || '|' || ".join(f"coalesce({c}::VARCHAR, 'null') || ':{c}:{k}'" for c, k in TPC[t].items())
    return f"SELECT '{name}' AS table_name, md5(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT md5({row}) AS h FROM {source})"


TURNED = "(SELECT a.n_nationkey, b.n_name, a.n_regionkey FROM nation a JOIN nation b ON b.n_nationkey = 24 - a.n_nationkey)"
CONTENT = "dg AS (" + " UNION ALL ".join([*(_digest_sql(t, t, t) for t in TPC), _digest_sql("nation", "nation", "nation_again"), _digest_sql("nation", TURNED, "nation_turned"), _digest_sql("orders", "orders", "orders_again")]) + "), content AS (SELECT table_name, min(table_name) OVER (PARTITION BY digest) AS same_as FROM dg)"


@q(f"WITH {CONTENT} SELECT * FROM content")
def content_identity(spark, d):
    return profile.content_ids(_repeated(spark, d)).select("table_name", "same_as")


@q("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_same FROM documents")
def text_classes(spark, d):
    return profile.text_classes(table(spark, d, "documents"), "doc_id", "text")


# ---- code and names -------------------------------------------------------------------

CODE = [
    ("n1", "import pandas as pd\ndf = pd.read_csv('a.csv')\nx = df['a'] + df.b\n%matplotlib inline\ny, z = f(x), [x, 1]\ny = y.mean()  # again"),
    ("n2", "from sklearn.svm import SVC\nimport numpy as np, pandas as pd\nimport os # c\na = 1\nb = a * 2\na = b\nc = a > b"),
    ("n3", "x = (\nnot code at all"),
    ("n4", ""),
]


def _code(spark):
    return spark.createDataFrame(CODE, "nb_name string, code string")


#: A program for each part: a, b and c with the part's key or size, an operation by its size; some that are no code.
OP, PROGRAM_OK = "CASE WHEN p_size % 2 = 0 THEN 'Add' ELSE 'Mult' END", "p_size % 10 <> 3"


def _programs(spark, d):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lines = ["import numpy as np, pandas as pd", F.concat(F.lit("a"), k, F.lit(" = pd.read_csv('"), F.col("p_brand"), F.lit("')")), F.concat(F.lit("b"), k, F.lit(" = a"), k, F.lit(".merge(c"), z, F.lit(")")), F.concat(F.lit("b"), k, F.lit(" = b"), k, F.when(F.col("p_size") % 2 == 0, F.lit(" + a")).otherwise(F.lit(" * a")), k, F.lit("  # again")), F.concat(F.lit("from m"), k, F.lit(" import f"), z)]
    code = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    return table(spark, d, "part").select(k.alias("nb_name"), F.when(F.col("p_size") % 10 == 3, F.concat(F.lit("import os\nx = (\n"), k)).otherwise(code).alias("code"))


PROGRAMS = f"o AS (SELECT p_partkey::VARCHAR AS k, p_size::VARCHAR AS z, {OP} AS op FROM part WHERE {PROGRAM_OK})"


@q(f"WITH {PROGRAMS} SELECT k AS graph_id, unnest(['var_pd_1', 'var_a' || k || '_2', 'var_c' || z || '_1', 'var_b' || k || '_3', 'var_a' || k || '_2']) AS src, unnest(['var_a' || k || '_2', 'var_b' || k || '_3', 'var_b' || k || '_3', 'var_b' || k || '_4', 'var_b' || k || '_4']) AS dst, unnest(['read_csv', 'merge', 'merge', op, op]) AS op FROM o")
def dependency_edges(spark, d):
    return provenance.flow_graphs(_programs(spark, d), id_col="nb_name", code_col="code")


@q(f"WITH {PROGRAMS} SELECT k AS nb_name, unnest([2, 3, 3, 4, 4]) AS line, unnest(['a' || k, 'b' || k, 'b' || k, 'b' || k, 'b' || k]) AS lhs, unnest(['pd', 'a' || k, 'c' || z, 'b' || k, 'a' || k]) AS rhs_var, unnest(['read_csv', 'merge', 'merge', op, op]) AS op FROM o")
def code_assignments(spark, d):
    return dependencies.table_function(_programs(spark, d), "code_assignments", "code", ["nb_name"]).select("nb_name", "line", "lhs", "rhs_var", "op")


@q(f"SELECT p_partkey::VARCHAR AS nb_name, unnest(['a', 'b', 'nothing']) AS var, unnest(CASE WHEN {PROGRAM_OK} THEN [2, 4, 0] ELSE [0, 0, 0] END) AS line FROM part")
def last_assignment(spark, d):
    v = _programs(spark, d).withColumn("var", F.explode(F.array(*(F.lit(x) for x in ("a", "b", "nothing")))))
    return v.select("nb_name", "var", text.last_assignment("code", F.when(F.col("var") == "nothing", F.col("var")).otherwise(F.concat("var", "nb_name"))).alias("line"))


@q(f"SELECT p_partkey::VARCHAR AS nb_name, unnest(CASE WHEN {PROGRAM_OK} THEN ['numpyasnp', 'pandas', 'f' || p_size] ELSE ['os'] END) AS library FROM part")
def import_extraction(spark, d):
    return _programs(spark, d).select("nb_name", F.explode(text.imports("code")).alias("library"))


@q(
    """WITH c AS (SELECT user_id AS u, event_type AS l, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT u, sum(n) AS n FROM c GROUP BY u), q AS (SELECT * FROM s WHERE u % 100 = 0),
j AS (SELECT x.u AS a, y.u AS b, sum(least(x.n, y.n)) AS same FROM c x JOIN c y ON x.l = y.l WHERE x.u % 100 = 0 GROUP BY ALL)
SELECT q.u::VARCHAR AS a_id, s.u::VARCHAR AS b_id, (abs(q.n - s.n) + greatest(q.n, s.n) - coalesce(same, 0))::BIGINT AS distance FROM q CROSS JOIN s LEFT JOIN j ON a = q.u AND b = s.u"""
)
def star_distance(spark, d):
    """Stars are users with event types for labels; queries are the users whose id is divisible by 100. Stars without a common label have a distance too."""
    s = table(spark, d, "events").select(F.col("user_id").cast("string").alias("graph_id"), F.lit("x").alias("node"), F.col("event_type").alias("label"))
    return provenance.star_distances(s.where(F.col("graph_id").cast("long") % 100 == 0), s, sharing=False).select("a_id", "b_id", "distance")


@q(
    """WITH u AS (SELECT user_id, event_type, event_id FROM events), s AS (SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_cell, event_type FROM u)
SELECT user_id::VARCHAR AS nb_name, 'v' AS var, event_id AS cell_id, def_cell FROM s WHERE event_type = 'view'"""
)
def previous_definition(spark, d):
    """The latest earlier click of each view's user."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("nb_name"), F.lit("v").alias("var"), F.col("event_id").alias("cell_id"), "event_type")
    return provenance.previous_definition(e.where("event_type = 'view'"), e.where("event_type = 'click'")).select("nb_name", "var", "cell_id", "def_cell")


@q("WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '\\.ipynb', '', 'g'), '[-_]', '', 'g'), '/') AS x FROM pages) SELECT page_id, right(array_to_string(x[greatest(len(x) - 1, 1):], ''), 25) AS name FROM p")
def clean_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_notebook_name("url").alias("name"))


@q("WITH p AS (SELECT p_partkey, 'nb' || p_partkey || CASE p_size % 4 WHEN 0 THEN 'cp' || p_size WHEN 1 THEN '' WHEN 2 THEN 'cp' || (1000 + p_size) ELSE 'cp' END AS name, p_size % 4 = 0 AS is_copy FROM part) SELECT name, is_copy, CASE WHEN is_copy THEN 'nb' || p_partkey ELSE name END AS original FROM p")
def copy_names(spark, d):
    """Names with and without the ending of a copy."""
    z = F.col("p_size")
    end = F.when(z % 4 == 0, F.concat(F.lit("cp"), z.cast("string"))).when(z % 4 == 1, F.lit("")).when(z % 4 == 2, F.concat(F.lit("cp"), (z + 1000).cast("string"))).otherwise(F.lit("cp"))
    n = table(spark, d, "part").select(F.concat(F.lit("nb"), F.col("p_partkey").cast("string"), end).alias("name"))
    return n.select("name", text.is_copy("name").alias("is_copy"), text.original_name(F.col("name")).alias("original"))


@q("SELECT p_partkey AS i, CASE WHEN p_size % 3 = 0 THEN 'DataFrame' WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'png' ELSE 'text' END AS kind FROM part")
def output_kind(spark, d):
    """Outputs with a table of class dataframe, pictures displayed or not, and others."""
    z = F.col("p_size")
    o = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.when(z % 3 == 0, F.lit('<table border="1" class="dataframe">')).otherwise(F.lit("<p>")).alias("html"), (z % 2 == 0).alias("png"), (z % 3 == 1).alias("display"))
    return o.select("i", text.output_kind("html", "png", "display").alias("kind"))


@q("SELECT CASE WHEN grouping(lang) = 0 THEN lang END AS nb_name, sum(length(text))::BIGINT AS sum_chars, max(length(text)) AS max_chars, sum(len(string_split(text, chr(10))))::BIGINT AS sum_lines, max(len(string_split(text, chr(10)))) AS max_lines, grouping(lang)::INT AS is_total FROM documents GROUP BY ROLLUP (lang)")
def code_size_rollup(spark, d):
    return graph_stats.code_sizes(table(spark, d, "documents").select(F.col("lang").alias("nb_name"), F.col("text").alias("cell_code")))


# ---- ranking quality ---------------------------------------------------------------------

RANKED = "WITH j AS (SELECT source, d.doc_id, n_chars::DOUBLE AS score, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS i, sum(quality) OVER (PARTITION BY source ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM j)"


def _ranked(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@q(f"{RANKED}, s AS (SELECT source, sum(CASE WHEN r <= 10 THEN quality / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN quality / log2(i + 1) ELSE 0 END) AS ideal FROM r GROUP BY source) SELECT source, round(dcg, 6) AS dcg, round(ideal, 6) AS ideal, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM s")
def ndcg_by_source(spark, d):
    got = quality.ndcg(_ranked(spark, d), query="source", item="doc_id", score="score", gain="quality", k=10)
    return got.select("source", *(F.round(c, 6).alias(c) for c in ("dcg", "ideal", "ndcg")))


@q(f"{RANKED} SELECT source, round(coalesce(sum(CASE WHEN quality = 1 THEN hits / r END) / sum(quality), 0), 6) AS ap FROM r GROUP BY source")
def average_precision(spark, d):
    got = quality.average_precision(_ranked(spark, d), query="source", item="doc_id", score="score", relevant="quality")
    return got.select("source", F.round("ap", 6).alias("ap"))


# ---- further operators -------------------------------------------------------------------------


@q(f"WITH {N} SELECT DISTINCT nb AS nb_name FROM n")
def notebook_names(spark, d):
    return graph_stats.notebook_names(conv_nodes(spark, d))


@q(f"WITH {N}, {E()}, v AS (SELECT DISTINCT nb FROM n WHERE label = 'Display_data') SELECT e.nb AS nb_name, src, dst FROM e JOIN v USING (nb)")
def valid_graph(spark, d):
    """Edges of the allow-listed notebooks, here those with an output."""
    n = conv_nodes(spark, d)
    return graph_stats.valid_graph(n, conv_edges(spark, d), n.where(F.col("node_type") == OUTPUT).select("nb_name"), ("Successor",))[1].select("nb_name", "src", "dst")


@q(f"WITH {N}, {E()} SELECT nb AS nb_name, dst AS src, src AS dst, 'Parent' AS rel FROM e")
def inverse_edges(spark, d):
    from .sources.notebooks import inverse

    return inverse(conv_edges(spark, d))


@q("WITH l AS (SELECT DISTINCT user_id::VARCHAR AS nb, concat_ws('_', event_type, (props->>'$.k')) AS library FROM events) SELECT nb AS nb_name, string_agg(library, ',' ORDER BY library) AS libraries FROM l GROUP BY nb")
def library_sets(spark, d):
    return graph_stats.library_sets(events_libraries(spark, d)).select("nb_name", F.array_join("libraries", ",").alias("libraries"))


@q(
    f"""WITH RECURSIVE {N}, {E()}, r AS (SELECT nb, src, dst FROM e UNION SELECT r.nb, r.src, e.dst FROM r JOIN e ON e.nb = r.nb AND e.src = r.dst),
t AS (SELECT nb, node FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.nb = n.nb AND e.dst = n.node)), k AS (SELECT nb, node FROM t UNION SELECT r.nb, r.dst FROM r JOIN t ON t.nb = r.nb AND t.node = r.src)
SELECT nb AS nb_name, node, row_number() OVER (PARTITION BY nb ORDER BY node)::INT AS number FROM k"""
)
def result_graph(spark, d):
    """The workflow below the roots of each notebook, numbered, as shown for a result."""
    n, e = conv_nodes(spark, d), conv_edges(spark, d)
    roots = n.select("nb_name", "node").join(e.select("nb_name", F.col("dst").alias("node")), ["nb_name", "node"], "left_anti")
    return reach.from_roots(n, reach.closure(e), roots).select("nb_name", "node", "number")


@q(f"WITH c AS (SELECT DISTINCT table_name, col, dtype FROM ({long_sql()})) SELECT table_name, dtype, count(*) AS n FROM c GROUP BY ALL")
def dtype_counts(spark, d):
    return profile.dtype_counts(values(spark, d))


def sketch_sql(names=tuple(TPC)) -> str:
    """At most a thousand values of each column, those of the smallest md5."""
    return f"SELECT table_name, col, dtype, value FROM (SELECT DISTINCT table_name, col, dtype, value FROM ({long_sql(names)}) WHERE value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY table_name, col ORDER BY md5(value), value) <= 1000"


@q(sketch_sql())
def sketch_values(spark, d):
    """The sketch of each column; a thousand values is the feature."""
    return profile.sketch_values(values(spark, d), ["table_name"])


@q(
    f"""WITH c AS (SELECT DISTINCT table_name, group_id, col, dtype FROM ({long_sql(('orders', 'lineitem'))})), m AS (SELECT *, regexp_replace(col, '^[a-z]_', '') AS k FROM c)
SELECT a.table_name AS a_table_name, b.table_name AS b_table_name, a.k AS a_col, b.k AS b_col FROM m a JOIN m b ON a.k = b.k AND a.group_id = b.group_id AND a.dtype = b.dtype WHERE a.table_name = 'orders' AND b.table_name = 'lineitem'"""
)
def mapping_by_schema(spark, d):
    """Columns of two tables of a group that are one schema element; names without their prefix."""
    v = values(spark, d, ("orders", "lineitem")).withColumn("col", F.regexp_replace("col", "^[a-z]_", ""))
    got = mapping.mapping_by_schema(v.where("table_name = 'orders'"), v.where("table_name = 'lineitem'"), profile.schema_index(v))
    return got.select("a_table_name", "b_table_name", "a_col", "b_col")


@q(
    f"""{ALL_PAIRS.replace("FROM s WHERE ta <> tb)", "FROM s WHERE ta < tb)")}, k AS ({sketch_sql()}), nk AS (SELECT table_name, col, count(*) AS n FROM k GROUP BY ALL),
kp AS (SELECT x.table_name AS ga, y.table_name AS gb, x.col AS l, y.col AS r, count(*) AS inter FROM k x JOIN k y ON x.dtype = y.dtype AND x.value = y.value WHERE x.table_name < y.table_name GROUP BY ALL),
ks AS (SELECT ga, gb, l, r, inter::DOUBLE / (a.n + b.n - inter) AS s FROM kp JOIN nk a ON a.table_name = ga AND a.col = l JOIN nk b ON b.table_name = gb AND b.col = r),
u AS (SELECT ga, gb, l, r, max(s) AS s FROM (SELECT * FROM p0 UNION ALL SELECT * FROM ks) GROUP BY ALL), {greedy_sql('m', 'u', 0.3)} SELECT ga AS a_table_name, gb AS b_table_name, l AS a_col, r AS b_col, s AS sim FROM m"""
)
def join_mapping(spark, d):
    v = values(spark, d)
    k = profile.sketch_values(v, ["table_name"])
    return mapping.join_mapping(mapping.column_pairs(k, k), mapping.column_pairs(v, v)).where("a_table_name < b_table_name")


SIMILAR = f"{parts_sql(False, 0.9)}, hits AS ({ranked_sql(f'0.1 * {COL_SCORE} + 0.9 * row_sim', 'n_mapped')})"
GROUPS_SQL = "gr AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {g})" for t, g in GROUPS.items()) + ") t(table_name, group_id))"


@q(f"{SIMILAR}, {GROUPS_SQL}, best_of AS (SELECT a_table_name, group_id, max(score) AS score FROM hits JOIN gr ON table_name = b_table_name GROUP BY ALL) SELECT a_table_name, table_name AS b_table_name, score FROM best_of JOIN gr USING (group_id)")
def group_scores(spark, d):
    """Hits of table search given to all tables of their groups."""
    hits = table_search.similar(values(spark, d, ("supplier",)), values(spark, d))
    groups = spark.createDataFrame(list(GROUPS.items()), "table_name string, group_id int")
    return table_search.spread_to_groups(hits, groups).select("a_table_name", "b_table_name", F.round("score", 6).alias("score"))


@q(f"{SIMILAR}, also AS (SELECT b_table_name AS table_name, score FROM hits UNION ALL SELECT 'nation_again', score FROM hits WHERE b_table_name = 'nation') SELECT table_name, score FROM also QUALIFY row_number() OVER (PARTITION BY CASE table_name WHEN 'nation_again' THEN 'nation' ELSE table_name END ORDER BY score DESC, table_name) = 1")
def distinct_hits(spark, d):
    """Hits without tables of equal content."""
    v = values(spark, d).unionByName(values(spark, d, ("nation",)).withColumn("table_name", F.lit("nation_again")))
    hits = table_search.similar(values(spark, d, ("supplier",)), v).select(F.col("b_table_name").alias("table_name"), F.round("score", 6).alias("score"))
    return tables.drop_same_content(hits, profile.content_ids(v), 10)


@q(
    f"""WITH RECURSIVE {N}, {E()}, st AS (SELECT nb, src AS node, '+' || dst_label AS label FROM e UNION ALL SELECT nb, dst, '-' || src_label FROM e), c AS (SELECT nb, node, label, count(*) AS n FROM st GROUP BY ALL), z AS (SELECT nb, node, sum(n) AS n FROM c GROUP BY ALL),
sm AS (SELECT x.nb AS ga, x.node AS l, y.nb AS gb, y.node AS r, sum(least(x.n, y.n)) AS same FROM c x JOIN c y ON x.label = y.label WHERE x.nb::BIGINT % 100 = 0 GROUP BY ALL),
p0 AS (SELECT x.nb AS ga, y.nb AS gb, x.node AS l, y.node AS r, -(abs(x.n - y.n) + greatest(x.n, y.n) - coalesce(same, 0)) AS s FROM z x JOIN z y ON x.nb::BIGINT % 100 = 0 LEFT JOIN sm ON sm.ga = x.nb AND sm.gb = y.nb AND sm.l = x.node AND sm.r = y.node),
{greedy_sql('m', 'p0')}, t AS (SELECT ga, gb, sum(-s)::BIGINT AS distance FROM m GROUP BY ALL) SELECT ga AS a_id, gb AS b_id, distance, row_number() OVER (PARTITION BY ga ORDER BY distance, gb) AS rank FROM t QUALIFY rank <= 2"""
)
def nearest_provenance(spark, d):
    """The two nearest graphs of each conversation whose id is divisible by 100, by star mapping; labels are the neighbours' kinds."""
    n, e = conv_nodes(spark, d), conv_edges(spark, d)
    kind = n.select("nb_name", "node", F.col("node_type").alias("kind"))
    e = e.join(kind.withColumnsRenamed({"node": "src", "kind": "src_kind"}), ["nb_name", "src"]).join(kind.withColumnsRenamed({"node": "dst", "kind": "dst_kind"}), ["nb_name", "dst"])
    s = e.select(F.col("nb_name").alias("graph_id"), F.explode(F.array(F.struct(F.col("src").alias("node"), F.concat(F.lit("+"), "dst_kind").alias("label")), F.struct(F.col("dst").alias("node"), F.concat(F.lit("-"), "src_kind").alias("label")))).alias("x")).select("graph_id", "x.node", "x.label")
    found = provenance.nearest(s.where(F.col("graph_id").cast("long") % 100 == 0), s, 2)
    return found.select("a_id", "b_id", "distance", F.col("rank").cast("long").alias("rank"))


@q()
def flow_similarity(spark, d):
    pairs = spark.createDataFrame([(*a, *b) for a, b in itertools.combinations(CODE, 2)], "a_id string, a string, b_id string, b string")
    return provenance.flow_similarities(pairs, "a", "b").select("a_id", "b_id", F.round("flow_sim", 6).alias("flow_sim"))


@q("WITH p AS (SELECT p_brand, p_type, sum(p_size)::DOUBLE AS benefit FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY benefit DESC, p_type) AS k FROM p WHERE benefit > 10) SELECT p_brand, p_type AS partner, benefit FROM r WHERE k = 1")
def best_partner(spark, d):
    p = table(spark, d, "part").groupBy("p_brand", F.col("p_type").alias("partner")).agg(F.sum("p_size").cast("double").alias("benefit"))
    return storage.best_partner(p, ["p_brand"], least=10.0)


@q("SELECT md5(text) AS h, min(turn)::BIGINT AS cell_id FROM conversations GROUP BY text")
def cell_dictionary(spark, d):
    from .sources.sinks import cell_dictionary as dictionary

    c = table(spark, d, "conversations").select(F.col("text").alias("cell_code"), F.col("turn").cast("long").alias("cell_id"))
    return dictionary(c).select(F.md5(F.unbase64("code")).alias("h"), "cell_id")


@q(
    f"""WITH {N}, {E()}, p AS (SELECT x.src AS c1, y.dst AS c2 FROM e x JOIN e y ON x.nb = y.nb AND x.dst = y.src WHERE x.src_label = 'Cell' AND y.dst_label = 'Cell'), k AS (SELECT node, {tokens_sql('text')} AS toks, {LINES} AS ls FROM n)
SELECT c1, c2, round({jaccard_sql('a.toks', 'b.toks')}, 6) AS by_tokens, round({jaccard_sql('a.ls', 'b.ls')}, 6) AS by_lines FROM p JOIN k a ON a.node = c1 JOIN k b ON b.node = c2"""
)
def cell_comparison(spark, d):
    """Cells two turns apart, compared by tokens and by lines."""
    n, e = conv_nodes(spark, d), conv_edges(spark, d)
    cells = n.where(F.col("node_type") == CELL).select("nb_name", "node", "cell_code")
    x = e.select("nb_name", F.col("src").alias("c1"), F.col("dst").alias("m")).join(e.select("nb_name", F.col("src").alias("m"), F.col("dst").alias("c2")), ["nb_name", "m"])
    both = x.join(cells.toDF("nb_name", "c1", "t1"), ["nb_name", "c1"]).join(cells.toDF("nb_name", "c2", "t2"), ["nb_name", "c2"])
    return both.select("c1", "c2", F.round(text.token_jaccard("t1", "t2"), 6).alias("by_tokens"), F.round(text.line_jaccard("t1", "t2"), 6).alias("by_lines"))


@q(f"WITH {N}, {CELL_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM p) SELECT q, d, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5")
def nearest_cells(spark, d):
    """The five nearest cells of each query cell (k nearest neighbours; five is the feature)."""
    got = score.top_k_per(_cell_pairs(spark, d), ["q"], 5, [F.desc("sim"), F.asc("d")])
    return got.select("q", "d", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))
