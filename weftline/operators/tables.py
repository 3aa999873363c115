"""Similarity of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import greedy
from .mapping import column_pairs


def column_counts(values: DataFrame) -> DataFrame:
    return values.groupBy("table_name").agg(F.count_distinct("col").alias("n_cols"))


def table_similarity(a: DataFrame, b: DataFrame, *, few: bool = False, b_columns: DataFrame | None = None) -> DataFrame:
    """(a_table_name, b_table_name, n_mapped, sim): greedy sum of column similarities over the larger number of columns (index columns count there).

    few: as in column_pairs(). b_columns: (table_name, col) of b's columns, where they are known.
    """
    on = ["a_table_name", "b_table_name"]
    taken = greedy(column_pairs(a, b, few=few), on, "a_col", "b_col", "sim").groupBy(*on).agg(F.sum("sim").alias("total"), F.count("*").alias("n_mapped"))
    n_a, n_b = (column_counts(x).select(F.col("table_name").alias(f"{s}_table_name"), F.col("n_cols").alias(f"{s}_n")) for x, s in ((a, "a"), (b if b_columns is None else b_columns, "b")))
    return taken.join(n_a, "a_table_name").join(n_b, "b_table_name").select(*on, "n_mapped", (F.col("total") / F.greatest("a_n", "b_n")).alias("sim"))


def dtype_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_table_name, b_table_name, sim): smaller counts of columns by dtype, over the columns of a."""

    def counts(x, s):
        own = x.where(~F.col("col").contains("index") & ~F.col("col").startswith("Unnamed")).select("table_name", "col", "dtype").distinct()
        return own.groupBy(F.col("table_name").alias(f"{s}_table_name"), "dtype").agg(F.count("*").alias(f"{s}_n"))

    ca, cb = counts(a, "a"), counts(b, "b")
    total = ca.groupBy("a_table_name").agg(F.sum("a_n").alias("n"))
    return ca.join(cb, "dtype").groupBy("a_table_name", "b_table_name").agg(F.sum(F.least("a_n", "b_n")).alias("same")).join(total, "a_table_name").select("a_table_name", "b_table_name", (F.col("same") / F.col("n")).alias("sim"))


def col_similarity(n_mapped: Column, n_a: Column, n_b: Column, key: Column) -> Column:
    """(1 + (mapped - 1) * key) over the columns of b and those of a that aren't mapped."""
    return (F.lit(1.0) + (n_mapped - 1) * key) / (n_b + (n_a - n_mapped))


def row_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Jaccard of the distinct non-null values of two one-column frames; 0 if both are empty."""
    both = a.toDF("v").where("v is not null").distinct().withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.toDF("v").where("v is not null").distinct().withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    return both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")) / F.count("*"), F.lit(0.0)).alias("sim"))


def row_string_similarity(a: DataFrame, b: DataFrame, key: str, columns: list[str], *, n: int | None = None) -> DataFrame:
    """One row: over the keys that a and b share (the n smallest of them where n is given), the mean of the mean Jaccard of their rows' value sets.

    a and b carry the key and the mapped columns under one name each. Equal value
    sets of a key are counted first, so a key of many rows gives as many pairs as
    it has different rows, each weighted by its counts.
    """

    def rows(x, name):
        values = F.array_sort(F.array_distinct(F.filter(F.array(*(F.col(c).cast("string") for c in columns)), lambda v: v.isNotNull())))
        return x.where(F.col(key).isNotNull()).groupBy(key, values.alias(name)).agg(F.count("*").alias(f"n_{name}"))

    both = F.size(F.array_intersect("x", "y"))
    sim = F.coalesce(both / (F.size("x") + F.size("y") - both), F.lit(0.0))
    pairs = rows(a, "x").join(rows(b, "y"), key)
    weight = F.col("n_x") * F.col("n_y")
    by_key = pairs.groupBy(key).agg((F.sum(sim * weight) / F.sum(weight)).alias("s"))
    if n is not None:
        by_key = by_key.orderBy(key).limit(n)
    return by_key.agg(F.avg("s").alias("sim"), F.count("*").alias("n_keys"))


def drop_same_content(ranked: DataFrame, classes: DataFrame, k: int, *, name: str = "table_name", order: list[Column] | None = None) -> DataFrame:
    """The first k of a ranking, of tables with equal content the first only."""
    order = order or [F.desc("score"), F.asc(name)]
    own = ranked.join(classes.select(F.col("table_name").alias(name), "same_as"), name)
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("same_as").orderBy(*order))).where("_n = 1").drop("_n", "same_as")
    return first.orderBy(*order).limit(k)
