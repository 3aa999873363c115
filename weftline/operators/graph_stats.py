"""Statistics of workflow graphs, and the structural filter on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CELL, OUTPUT, VAR, Query

METRICS = ("n_cell", "n_var", "n_output", "max_in", "max_out")


def valid_graph(nodes: DataFrame, edges: DataFrame, valid: DataFrame | None = None, relations: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of valid notebooks, and edges of the relations asked for with both ends among them."""
    if valid is not None:
        nodes = nodes.join(valid.select("nb_name").distinct(), "nb_name", "left_semi")
    if relations:
        edges = edges.where(F.col("rel").isin(*relations))
    ends = nodes.select("nb_name", "node")
    edges = edges.join(ends.withColumnRenamed("node", "src"), ["nb_name", "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), ["nb_name", "dst"], "left_semi")
    return nodes, edges


def notebook_names(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.coalesce("nb_name", F.substring_index("node", "_", -1)).alias("nb_name")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(nb_name, node, n_out, n_in) in one aggregate: both ends of an edge are rows of one table."""
    ends = edges.select("nb_name", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("nb_name", F.col("e.node").alias("node")).agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def workflow_stats(nodes: DataFrame, edges: DataFrame, output_types: tuple[str, ...] = ()) -> DataFrame:
    """One row a notebook: nodes by label, outputs by type, largest degrees; zeros where it has none."""
    counted = nodes.groupBy("nb_name").agg(
        *(F.count(F.when(F.col("node_type") == label, 1)).alias(name) for label, name in ((CELL, "n_cell"), (VAR, "n_var"), (OUTPUT, "n_output"))),
        *(F.count(F.when((F.col("node_type") == OUTPUT) & (F.col("display_type") == t), 1)).alias(f"n_{t}") for t in output_types),
    )
    most = degrees(edges).groupBy("nb_name").agg(F.max("n_in").alias("max_in"), F.max("n_out").alias("max_out"))
    return counted.join(most, "nb_name", "left").fillna(0, ["max_in", "max_out"])


def structure_filter(stats: DataFrame, q: Query) -> DataFrame:
    """Notebooks that have at least what the query has. This decides results: matching may bind two query nodes to one node."""
    need = q.stats()
    keep = F.lit(True)
    for m in METRICS:
        keep &= F.col(m) >= need[m]
    return stats.where(keep)


def summary(stats: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, min, max, avg, sum) over notebooks."""
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v")) for m in metrics))).alias("x"))
    return long.groupBy(F.col("x.metric").alias("metric")).agg(F.min("x.v").alias("min_v"), F.max("x.v").alias("max_v"), F.avg("x.v").alias("avg_v"), F.sum("x.v").alias("sum_v"))


def roots(nodes: DataFrame, edges: DataFrame, label: str = CELL) -> DataFrame:
    """Nodes of a label that no node of the label leads to."""
    own = nodes.where(F.col("node_type") == label).select("nb_name", "node")
    into = edges.join(own.withColumnRenamed("node", "src"), ["nb_name", "src"], "left_semi").select("nb_name", F.col("dst").alias("node"))
    return own.join(into, ["nb_name", "node"], "left_anti")


def root_workflow_stats(nodes: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(nb_name, root, n_cell, n_var, n_output): the nodes of the workflow below each root cell, itself included, each once. reach: closure of the edges to follow."""
    top = roots(nodes, edges).select("nb_name", F.col("node").alias("root"))
    below = top.join(reach.select("nb_name", F.col("src").alias("root"), F.col("dst").alias("node")), ["nb_name", "root"]).unionByName(top.withColumn("node", F.col("root"))).distinct()
    kinds = below.join(nodes.select("nb_name", "node", "node_type"), ["nb_name", "node"])
    return kinds.groupBy("nb_name", "root").agg(*(F.count(F.when(F.col("node_type") == label, 1)).alias(name) for label, name in ((CELL, "n_cell"), (VAR, "n_var"), (OUTPUT, "n_output"))))


def dataset_summary(nodes: DataFrame, table_bytes: DataFrame | None = None) -> DataFrame:
    """(part, name, min_v, max_v, avg_v, sum_v): nodes a notebook by label, outputs a notebook by type, and bytes a table; a notebook without any counts as 0."""
    all_ = nodes.select("nb_name").distinct()

    def counted(rows, part, name):
        each = rows.groupBy("nb_name", F.col(name).alias("name")).agg(F.count("*").alias("v"))
        kinds = [r["name"] for r in each.select("name").distinct().collect()]  # labels or output types: a handful
        every = all_.withColumn("name", F.explode(F.array(*(F.lit(x) for x in kinds)) if kinds else F.array().cast("array<string>")))
        return every.join(each, ["nb_name", "name"], "left").select(F.lit(part).alias("part"), "name", F.coalesce("v", F.lit(0)).alias("v"))

    long = counted(nodes, "Node", "node_type").unionByName(counted(nodes.where((F.col("node_type") == OUTPUT) & F.col("display_type").isNotNull()), "Outputs", "display_type"))
    if table_bytes is not None:
        long = long.unionByName(table_bytes.select(F.lit("Table").alias("part"), F.lit("table data").alias("name"), F.col("n_bytes").alias("v")))
    return long.groupBy("part", "name").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("avg_v"), F.sum("v").alias("sum_v"))


def table_variables(nodes: DataFrame) -> DataFrame:
    """(nb_name, var): the names of the notebooks' table variables, from node names <cell>_<var>_<notebook>."""
    return nodes.where(F.col("node_type") == VAR).select("nb_name", F.regexp_extract("node", "^[^_]*_(.*)_[^_]*$", 1).alias("var")).distinct()


def library_sets(libraries: DataFrame) -> DataFrame:
    return libraries.groupBy("nb_name").agg(F.array_sort(F.collect_set("library")).alias("libraries"))


def output_sets(display: DataFrame) -> DataFrame:
    return display.groupBy("nb_name").agg(F.array_sort(F.collect_set("data_type")).alias("types"), F.array_sort(F.collect_set(F.struct("cell_id", "data_type"))).alias("cells"))


def code_sizes(cells: DataFrame) -> DataFrame:
    """Characters and lines of code by notebook, and over all (nb_name null)."""
    n = cells.select("nb_name", F.length("cell_code").cast("long").alias("n_chars"), F.size(F.split("cell_code", "\n")).cast("long").alias("n_lines"))
    return n.rollup("nb_name").agg(F.sum("n_chars").alias("sum_chars"), F.max("n_chars").alias("max_chars"), F.sum("n_lines").alias("sum_lines"), F.max("n_lines").alias("max_lines"), F.grouping("nb_name").cast("int").alias("is_total"))


def label_lists(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("nb_name", "node_type").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
