"""Approximate keys and join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRUNE = 0.9


def key_score(a: DataFrame, b: DataFrame, key: str, columns: list[str], prune: float = PRUNE) -> DataFrame:
    """One row (ratio_a, ratio_b, score): how well key determines the mapped columns over both tables.

    0 if the smaller ratio of distinct keys to rows is prune or less; otherwise
    the distinct (key, row)s of both over all rows. a and b have the key and the
    columns by one name each. Rows are compared as structures, so values that hold
    separators can't be confused.
    """
    cols = [key, *(c for c in columns if c != key)]
    both = a.select(*cols).withColumn("_a", F.lit(1)).unionByName(b.select(*cols).withColumn("_a", F.lit(0)))
    row = F.struct(*cols)
    keys = both.groupBy(key).agg(F.sum("_a").alias("a"), F.sum(1 - F.col("_a")).alias("b"))
    ratios = keys.agg((F.count(F.when(F.col("a") > 0, 1)) / F.sum("a")).alias("ratio_a"), (F.count(F.when(F.col("b") > 0, 1)) / F.sum("b")).alias("ratio_b"))
    total = both.select(row.alias("r")).groupBy("r").agg(F.count("*").alias("n")).agg((F.count("*") / F.sum("n")).alias("distinct"))
    return ratios.crossJoin(F.broadcast(total)).select("ratio_a", "ratio_b", F.when(F.least("ratio_a", "ratio_b") <= prune, 0.0).otherwise(F.col("distinct")).alias("score"))  # one row and one row


def join_key_score(a: DataFrame, b: DataFrame, key: str, prune: float = PRUNE) -> DataFrame:
    """One row (ratio_a, ratio_b, score_a, score_b, score): 1 if either side's keys are unique, 0 if the smaller ratio is below prune, otherwise the larger share of distinct to all rows on the keys both have."""
    ka, kb = a.groupBy(key).agg(F.count("*").alias("na")), b.groupBy(key).agg(F.count("*").alias("nb"))
    keys = ka.join(kb, key, "full")
    shared = F.col("na").isNotNull() & F.col("nb").isNotNull()
    got = keys.agg(
        (F.count("na") / F.sum("na")).alias("ratio_a"),
        (F.count("nb") / F.sum("nb")).alias("ratio_b"),
        F.coalesce(F.count(F.when(shared, 1)) / F.sum(F.when(shared, F.col("na"))), F.lit(0.0)).alias("score_a"),
        F.coalesce(F.count(F.when(shared, 1)) / F.sum(F.when(shared, F.col("nb"))), F.lit(0.0)).alias("score_b"),
    )
    return got.withColumn("score", F.when((F.col("ratio_a") == 1) | (F.col("ratio_b") == 1), 1.0).when(F.least("ratio_a", "ratio_b") < prune, 0.0).otherwise(F.greatest("score_a", "score_b")))


PAIR = ["a_table_name", "b_table_name"]


def mapped_rows(a: DataFrame, b: DataFrame, mapped: DataFrame) -> DataFrame:
    """(a_table_name, b_table_name, side, r) of each row of both tables of each mapped pair: its mapped cells as (a_col, value), in order of a_col.

    a and b are cell_values, mapped a mapping (a_table_name, b_table_name, a_col, b_col).
    """

    def side(values, s):
        own = values.select(F.col("table_name").alias(f"{s}_table_name"), F.col("col").alias(f"{s}_col"), "row_id", "value")
        return own.join(mapped.select(*PAIR, "a_col", "b_col"), [f"{s}_table_name", f"{s}_col"]).select(*PAIR, F.lit(s).alias("side"), "row_id", "a_col", "value")

    cells = side(a, "a").unionByName(side(b, "b"))
    return cells.groupBy(*PAIR, "side", "row_id").agg(F.array_sort(F.collect_list(F.struct("a_col", "value"))).alias("r")).drop("row_id")


def pair_keys(a: DataFrame, b: DataFrame, mapped: DataFrame, *, join: bool = False, prune: float = PRUNE) -> DataFrame:
    """(a_table_name, b_table_name, a_col, score): of each mapped column how well it determines the mapped rows of both tables.

    As a common key: 0 if the smaller ratio of distinct values to rows is prune or
    less, otherwise the distinct mapped rows of both tables over all their rows. As
    a join key (join): 1 if either side's values are unique, 0 if the smaller ratio
    is below prune, otherwise the larger of two shares of all rows: the distinct
    rows of the values that one side has, and of those that the other has. All
    pairs at once, by aggregates over their rows; a null is a value like others.
    """
    rows = mapped_rows(a, b, mapped)
    different = rows.groupBy(*PAIR, "r").agg(F.count(F.when(F.col("side") == "a", 1)).alias("in_a"), F.count(F.when(F.col("side") == "b", 1)).alias("in_b"))
    total = different.groupBy(*PAIR).agg(F.count("*").alias("different"), F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b"))
    cells = different.select(*PAIR, "in_a", "in_b", F.explode("r").alias("x")).select(*PAIR, "x.a_col", "x.value", "in_a", "in_b")
    by_value = cells.groupBy(*PAIR, "a_col", "value").agg(F.count("*").alias("n"), F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    of_key = by_value.groupBy(*PAIR, "a_col").agg(*(F.count(F.when(F.col(f"in_{s}") > 0, 1)).alias(f"values_{s}") for s in "ab"), *(F.sum(F.when(F.col(f"in_{s}") > 0, F.col("n")).otherwise(0)).alias(f"of_{s}") for s in "ab"))
    sized = of_key.join(total, PAIR)
    ratio_a, ratio_b = (F.col(f"values_{s}") / F.col(f"rows_{s}") for s in "ab")
    all_rows = F.col("rows_a") + F.col("rows_b")
    if join:
        score = F.when((ratio_a == 1) | (ratio_b == 1), 1.0).when(F.least(ratio_a, ratio_b) < prune, 0.0).otherwise(F.greatest("of_a", "of_b") / all_rows)
    else:
        score = F.when(F.least(ratio_a, ratio_b) <= prune, 0.0).otherwise(F.col("different") / all_rows)
    return sized.select(*PAIR, "a_col", "rows_a", "rows_b", score.alias("score"))


def containment(pairs: DataFrame) -> DataFrame:
    """Column pairs (of pair_jaccard) with containment: common values over the smaller number of values."""
    return pairs.withColumn("containment", F.col("inter") / F.least("n_a", "n_b"))


def join_keys(pairs: DataFrame, *, least_name: float = 0.5, least: float = 0.5) -> DataFrame:
    """Advisory join keys of two tables: columns of like names (up to the first underscore) whose values are contained, matched one to one."""
    from ..functions.align import name_ratio
    from .columns import greedy

    named = containment(pairs).withColumn("name_sim", name_ratio("a_col", "b_col")).where(F.col("name_sim") >= least_name)
    return greedy(named, ["a_table_name", "b_table_name"], "a_col", "b_col", "containment", least=least)


def best_key(scores: DataFrame, group: list[str], key: str = "key", tie: str | None = None) -> DataFrame:
    """Of (group, key, score) rows the best key of each group; ties by the larger tie column, then by the smaller name."""
    order = [F.lit(0.0) if tie is None else -F.col(tie), F.col(key).alias("key")]
    return scores.groupBy(*group).agg(F.min_by(F.struct(*scores.columns), F.struct((-F.col("score")).alias("s"), order[0].alias("t"), order[1])).alias("x")).select(*group, *(f"x.{c}" for c in scores.columns if c not in group))
