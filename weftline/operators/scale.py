"""Synthetic copies of workflows, for scaling tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copies(nodes: DataFrame, edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Each notebook size times: itself, and copies named ...cp1, ...cp2 with one node changed.

    An odd copy has one node more at the last node, an even copy lacks its last
    node (and that node's edges only). The copies are exploded from each row.
    """
    if size > 999:
        raise ValueError("at most 999 copies, for names to tell")

    def copied(df):
        return df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))

    def renamed(c):
        return F.when(F.col("_c") == 0, F.col(c)).otherwise(F.concat(F.col(c), F.lit("cp"), F.col("_c").cast("string")))

    last = nodes.groupBy("nb_name").agg(F.max("node").alias("_last"))
    n = copied(nodes.join(last, "nb_name"))
    kept = n.where((F.col("_c") == 0) | (F.col("_c") % 2 == 1) | (F.col("node") != F.col("_last")))
    more = n.where((F.col("_c") % 2 == 1) & (F.col("node") == F.col("_last"))).withColumn("node", F.concat("node", F.lit("+")))
    new_nodes = kept.unionByName(more).withColumn("nb_name", renamed("nb_name")).withColumn("node", renamed("node")).drop("_c", "_last")
    e = copied(edges.join(last, "nb_name"))
    gone = (F.col("_c") > 0) & (F.col("_c") % 2 == 0) & ((F.col("src") == F.col("_last")) | (F.col("dst") == F.col("_last")))
    link = copied(last).where(F.col("_c") % 2 == 1).select("nb_name", F.col("_last").alias("src"), F.concat("_last", F.lit("+")).alias("dst"), F.lit("Successor").alias("rel"), "_c")
    all_e = e.where(~gone).select("nb_name", "src", "dst", "rel", "_c").unionByName(link)
    new_edges = all_e.withColumn("nb_name", renamed("nb_name")).withColumn("src", renamed("src")).withColumn("dst", renamed("dst")).drop("_c")
    return new_nodes, new_edges
