"""Continuous ingest: files that arrive become new rows of a stored table, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import SCHEMAS
from ..sources.sinks import append_new


def ingest(spark: SparkSession, source: str, target: str, table: str, keys: list[str], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append new rows of Parquet files in source to target. A batch that runs again after a failure writes nothing twice: rows are matched by key."""
    stream = spark.readStream.schema(SCHEMAS[table]).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, target, keys)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
