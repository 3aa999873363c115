"""Reachability and components in workflow graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(nb_name, src, dst): dst is reached from src by one edge or more.

    Paths double in length each round (known paths joined with known paths), so
    a graph of depth d takes about log2(d) rounds. Joins are within a notebook.
    With max_depth the paths grow by one edge a round and stop there.
    """
    step = checkpointed(edges.select("nb_name", "src", "dst").distinct())
    known, count, depth = step, step.count(), 1
    while max_depth is None or depth < max_depth:
        by = step if max_depth is not None else known
        longer = known.alias("a").join(by.alias("b"), (F.col("a.nb_name") == F.col("b.nb_name")) & (F.col("a.dst") == F.col("b.src"))).select("a.nb_name", "a.src", "b.dst")
        grown = checkpointed(known.unionByName(longer).distinct())
        n = grown.count()
        known, depth = grown, depth + 1
        if n == count:
            break
        count = n
    return known


def components(edges: DataFrame) -> DataFrame:
    """(nb_name, node, component): the smallest node of each connected component, edges taken both ways.

    Smallest label among neighbours and then the label's label, until nothing changes.
    """
    both = checkpointed(edges.select("nb_name", "src", "dst").unionByName(edges.select("nb_name", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = checkpointed(both.groupBy("nb_name", F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("nb_name", "node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), ["nb_name", "dst"]).groupBy("nb_name", F.col("src").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, ["nb_name", "node"]).select("nb_name", "node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = labels.select("nb_name", F.col("node").alias("low"), F.col("label").alias("root"))
        step = checkpointed(lower.join(jump, ["nb_name", "low"], "left").select("nb_name", "node", F.least("low", F.coalesce("root", "low")).alias("label"), "was"))
        if step.where("label != was").isEmpty():
            return step.select("nb_name", "node", F.col("label").alias("component"))
        labels = step.drop("was")


def from_roots(nodes: DataFrame, reach: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes at and below the given roots (nb_name, node) of each notebook, numbered by name within it."""
    from pyspark.sql import Window

    below = reach.join(roots.withColumnRenamed("node", "src"), ["nb_name", "src"], "left_semi").select("nb_name", F.col("dst").alias("node"))
    keep = below.unionByName(roots.select("nb_name", "node")).distinct()
    return nodes.join(keep, ["nb_name", "node"], "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("nb_name").orderBy("node")))
