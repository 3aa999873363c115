"""Ranking quality against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, *, query: str, item: str, score: str, gain: str, k: int) -> DataFrame:
    """(query, dcg, ideal, ndcg) at k, with gain / log2(rank + 1); ties by item."""
    own = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    best = Window.partitionBy(query).orderBy(F.desc(gain), F.asc(item))
    both = ranked.withColumn("r", F.row_number().over(own)).withColumn("i", F.row_number().over(best))

    def part(n):
        return F.sum(F.when(F.col(n) <= k, F.col(gain) / F.log2(F.col(n) + 1)).otherwise(0.0))

    sums = both.groupBy(query).agg(part("r").alias("dcg"), part("i").alias("ideal"))
    return sums.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))


def average_precision(ranked: DataFrame, *, query: str, item: str, score: str, relevant: str) -> DataFrame:
    """(query, ap) with relevant as 0 or 1."""
    own = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    seen = ranked.withColumn("r", F.row_number().over(own)).withColumn("hits", F.sum(relevant).over(own))
    return seen.groupBy(query).agg(F.coalesce(F.sum(F.when(F.col(relevant) == 1, F.col("hits") / F.col("r"))) / F.sum(relevant), F.lit(0.0)).alias("ap"))
