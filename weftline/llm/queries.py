"""The opN_ queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, html_blocks, itq, licenses, mixing, nbsvm, sharding, substrings, toxicity
from . import decontaminate as decon
from .textops import table


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Target weights of the domains 0 (clean), 1 (low quality), 2 (toxic).
DOMAIN_WEIGHTS = [0.9, 0.08, 0.02]


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing: doc_id and domain."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("domain"))


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.digest(decon.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.assign(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "shard_depth", "shard_bytes")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixed(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), "domain", DOMAIN_WEIGHTS, apply=False)
    return rated.select("doc_id", "n_tokens", "posterior", "rate", "copies")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.removals(table(spark, sf_dir, "documents")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.links(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_blocks, op2_license_scan, op3_decontaminate, op4_embedding_near_dedup, op5_bagminhash, op6_sharding, op7_mixing, op8_substring_dedup, op9_quality, op10_toxicity, pipeline)}
SQL = {"op6_sharding": sharding.SQL.format(limit=SHARD_BYTES)}


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
