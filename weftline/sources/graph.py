"""Reading workflow graphs, libraries, outputs and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import notebook_of, original_name
from ..operators.graph_stats import valid_graph


def valid_names(spark: SparkSession, path: str) -> DataFrame:
    """The allow-list: a name a line, trimmed, each once."""
    return spark.read.text(path).select(F.trim("value").alias("nb_name")).where("nb_name != ''").distinct()


def load(spark: SparkSession, path: str, valid: DataFrame | None = None, relations: tuple[str, ...] = ("Successor", "Contains", "Usedby", "Display")) -> tuple[DataFrame, DataFrame]:
    """wf_nodes and wf_edges of valid notebooks and the relations that searching uses."""
    nodes, edges = spark.read.parquet(f"{path}/wf_nodes"), spark.read.parquet(f"{path}/wf_edges")
    return valid_graph(named(nodes), edges, valid, relations)


def named(nodes: DataFrame) -> DataFrame:
    """Nodes with their notebook: variables have it in their name."""
    return nodes.withColumn("nb_name", F.coalesce("nb_name", F.when(F.col("node_type") == "Var", notebook_of("node"))))


def source_code(cells: DataFrame, nb_name: str) -> DataFrame:
    """The cells of one notebook; a synthetic copy has its original's."""
    return cells.where(F.col("nb_name") == original_name(F.lit(nb_name)))


def lineage(dependency: DataFrame, line2cid: DataFrame, last_line: DataFrame) -> DataFrame:
    """One row a view from three tables of (view_id, view_cmd) JSON; views without a last line are dropped."""

    def one(df, name):
        return df.select("view_id", F.col("view_cmd").alias(name))

    both = one(dependency, "dependency").join(one(line2cid, "line2cid"), "view_id").join(one(last_line, "last"), "view_id")

    def by_line(column, kind):  # JSON has text keys only
        return F.transform_keys(F.from_json(column, f"map<string,{kind}>"), lambda k, _: k.cast("int")).alias(column)

    return both.select("view_id", by_line("dependency", "struct<lhs:array<string>,rhs:array<struct<var:string,op:string>>>"), by_line("line2cid", "int"), F.col("last").cast("int").alias("last_line")).where("last_line > 0")


def lineage_stars(lineage_: DataFrame) -> DataFrame:
    """(graph_id, node, label) of the star graph around each stored variable (rows of lineage()); variables without edges have none."""
    from ..functions.dependencies import table_function

    return table_function(lineage_, "lineage_stars", ["view_id", "dependency", "line2cid", "last_line"], ["view_id"]).withColumnRenamed("view_id", "graph_id")


def stored_lineage(spark: SparkSession, path: str) -> DataFrame:
    """Rows of lineage() from a table that sinks.store_lineage() wrote."""
    kept = spark.read.parquet(path)

    def by_line(column, kind):
        return F.transform_keys(F.from_json(column, f"map<string,{kind}>"), lambda k, _: k.cast("int")).alias(column)

    return kept.select("view_id", by_line("dependency", "struct<lhs:array<string>,rhs:array<struct<var:string,op:string>>>"), by_line("line2cid", "int"), "last_line").where("last_line > 0")


def reused(nodes: DataFrame, edges: DataFrame, name: str = "workflow") -> tuple[DataFrame, DataFrame]:
    """A loaded graph kept in memory and on disk, and as views <name>_nodes and <name>_edges, for further searches of the session."""
    kept = nodes.persist(), edges.persist()
    for df, part in zip(kept, ("nodes", "edges"), strict=True):
        df.createOrReplaceTempView(f"{name}_{part}")
    return kept


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a JSON object in a file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("name", "value"))


def similarity_cache(spark: SparkSession, path: str) -> DataFrame:
    """(q, d, sim) of JSON lines that hold [q, d, sim]."""
    return spark.read.text(path).select(F.from_json("value", "array<string>").alias("x")).select(F.col("x")[0].alias("q"), F.col("x")[1].alias("d"), F.col("x")[2].cast("double").alias("sim"))


def similarity_list(spark: SparkSession, path: str) -> DataFrame:
    """(q, d, sim) of a file that holds one JSON list of [q, d, sim] lists; of repeated pairs the last holds."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("i", "x"))
    return whole.groupBy(F.col("x")[0].alias("q"), F.col("x")[1].alias("d")).agg(F.max_by(F.col("x")[2].cast("double"), "i").alias("sim"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def judgements(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """Headerless CSV of seven integers a row, with a byte-order mark."""
    names = ["nb_id", "data", "code", "library", "output", "flow", "overall"]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    return raw.select(F.lit(query_id).alias("query_id"), *(F.regexp_replace(n, "﻿", "").cast("int").alias(n) for n in names))
