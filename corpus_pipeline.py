"""A corpus pipeline of five stages over the documents table.

Each stage works on all rows that the one before kept and returns the columns of
documents (the last adds the shard). Rows with null ids or texts pass through as
their operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bagminhash, decontaminate, mixing, sharding, toxicity
from weftline.llm.queries import DOMAIN_WEIGHTS, SHARD_BYTES, domains
from weftline.llm.textops import discard, table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    return bagminhash.without_near_duplicates(docs, threshold=0.8)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such passages goes."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out so that the domains' tokens come in the target proportions; the clean domain keeps its tokens."""
    return mixing.mixed(docs, domains(table(spark, sf_dir, "labels")), "domain", DOMAIN_WEIGHTS, anchor=0, headroom=1.02)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets a shard of bounded size."""
    return sharding.assign(docs, max_bytes=SHARD_BYTES)


STAGES = [("toxicity", remove_toxic), ("minhash near-dedup", remove_near_duplicates), ("benchmark decontamination", remove_benchmark), ("mixing", mix), ("sharding", shard)]

#: The stages learn from data, sign texts and walk automata: SQL can't express them. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again as the next one's input.

    A stage's rows are deleted when the next one's are written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
