"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return where or "/tmp/weftline-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows that a side of a join may have to be broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


def broadcast_if(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has rows rows at most. df is a checkpoint, so that counting it costs little."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
