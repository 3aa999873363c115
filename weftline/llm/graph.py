"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import checkpointed, discard

#: Rows (two ids each) that a side of a join may have to be broadcast. More are shuffled.
BROADCAST_ROWS = 200_000


def broadcast_if(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has rows rows at most. df is a checkpoint, so that counting it costs little."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(links: DataFrame) -> DataFrame:
    """(v, label): of each end of the links (x, y), the smallest vertex that it reaches. links is a checkpoint.

    Each round takes the smallest label among the neighbours and then the label's
    own label, so chains shorten by half. Aggregates combine before the shuffle;
    a hub's rows are on the large side of a join that can be split. Labels of few
    links are broadcast and written in few files.
    """
    n = links.count()
    files = None if n > BROADCAST_ROWS // 2 else 1 + n // 20_000

    def written(df):
        return checkpointed(df if files is None else df.coalesce(files))

    def sent(df):
        return df if files is None else F.broadcast(df)

    links = links.where("x != y")
    both = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("low")).select("v", F.least("v", "low").alias("label")))
    while True:
        near = both.join(sent(labels.withColumnRenamed("v", "y")), "y").select(F.col("x").alias("v"), "label", F.lit(None).alias("was"))
        lower = near.unionByName(labels.withColumn("was", F.col("label"))).groupBy("v").agg(F.min("label").alias("low"), F.max("was").alias("was"))
        roots = labels.select(F.col("v").alias("low"), F.col("label").alias("root"))
        step = written(lower.join(sent(roots), "low", "left").select("v", F.least("low", F.coalesce("root", "low")).alias("label"), "was"))
        discard(labels)
        labels = step.select("v", "label")
        if step.where("label != was").isEmpty():
            discard(both)
            return labels
