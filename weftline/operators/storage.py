"""Costs of ways to store a table, given what is stored already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_WEIGHT, SPACE_WEIGHT = 0.1, 0.9
STRATEGIES = ("separate", "lineage", "join", "union")


def cost(time_cost: Column, space: Column) -> Column:
    return TIME_WEIGHT * time_cost + SPACE_WEIGHT * space


def key_selectivity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (n_a, n_b, n_joined): rows, and rows of their join on key, from counts by key (the join itself isn't made)."""
    ka, kb = a.groupBy(key).agg(F.count("*").alias("na")), b.groupBy(key).agg(F.count("*").alias("nb"))
    return ka.join(kb, key, "full").agg(F.coalesce(F.sum("na"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("n_joined"))


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (a_in_b, b_in_a, n_a, n_b): whether one table's rows are all in the other, as multisets of whole rows."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*cols).agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    return per.agg(F.coalesce(F.bool_and(F.col("na") <= F.col("nb")), F.lit(True)).alias("a_in_b"), F.coalesce(F.bool_and(F.col("nb") <= F.col("na")), F.lit(True)).alias("b_in_a"), F.coalesce(F.sum("na"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("n_b"))


def choose(costs: DataFrame, id_cols: list[str]) -> DataFrame:
    """The cheapest of the columns separate, lineage, join, union (null: not possible) for each row; ties in that order."""
    options = F.array(*(F.struct(F.coalesce(F.col(s).cast("double"), F.lit(float("inf"))).alias("cost"), F.lit(i).alias("n"), F.lit(s).alias("strategy")) for i, s in enumerate(STRATEGIES)))
    return costs.withColumn("_x", F.array_min(options)).select(*id_cols, F.col("_x.strategy").alias("strategy"), F.col("_x.cost").alias("cost"))


def best_partner(candidates: DataFrame, id_cols: list[str], *, benefit: str = "benefit", partner: str = "partner", least: float = 0.0) -> DataFrame:
    """The partner with the largest benefit above least; ties by name."""
    ok = candidates.where(F.col(benefit) > least)
    best = ok.groupBy(*id_cols).agg(F.min(F.struct((-F.col(benefit)).alias("b"), F.col(partner).alias("p"))).alias("x"))
    return best.select(*id_cols, F.col("x.p").alias(partner), (-F.col("x.b")).alias(benefit))
