"""Similarity of a query's tables and the notebooks' table variables, as search() takes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators import profile, tables
from ..operators.columns import of_tables
from . import table_search

HOW = ("tables", "search", "groups")


def table_pairs(query: DataFrame, values: DataFrame, *, how: str = "tables", groups: DataFrame | None = None, beta: float = 0.1, k: int | None = None, columns: DataFrame | None = None) -> DataFrame:
    """(a_table_name, b_table_name, sim) of query tables and tables, both as cell_values; pairs without a row have 0.

    how: "tables" by their columns' values, "search" by table search (of the k best
    hits, all by default), "groups" by table search with a hit's score for all
    tables of its group (groups: table_name, group_id). columns: (table_name, col)
    of values' tables, where they are known.
    """
    if how == "tables":
        return tables.table_similarity(query, values, few=True, b_columns=columns).select("a_table_name", "b_table_name", "sim")
    if how not in HOW:
        raise ValueError(f"how is one of {HOW}")
    hits = table_search.similarity(table_search.pair_scores(query, values), beta=beta)
    if k is not None:
        from ..operators.score import top_k_per

        hits = top_k_per(hits, ["a_table_name"], k, [F.desc("score"), F.asc("b_table_name")])
    if how == "groups":
        hits = table_search.spread_to_groups(hits.select("a_table_name", "b_table_name", "score"), groups)
    return hits.select("a_table_name", "b_table_name", F.col("score").alias("sim"))


def pair_similarity(query: DataFrame, values: DataFrame, variables: DataFrame, *, cache: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(q, d, sim) of query tables and variables, and the cache of what has been computed.

    query: cell_values whose table_name is the query node. variables: (d,
    table_name). Tables of equal content are compared once: the cache holds (q,
    data_id, sim) by content, and pairs that it has are not computed again. Without
    a cache only tables with columns of the same names and lengths are compared by content; the
    returned cache finds the content of the others when it is read.
    """
    own = variables.select("d", "table_name").distinct()
    asked = of_tables(values, checkpointed(own.select("table_name").distinct()))
    sizes = checkpointed(profile.column_sizes(asked))
    names = sizes.select("table_name").distinct()

    def digests(x):
        return profile.content_ids(of_tables(asked, x)).select("table_name", F.col("digest").alias("data_id"))

    ids = digests(checkpointed(profile.alike(sizes)) if cache is None else names)
    # a table that is like no other stands for itself
    ids = checkpointed(names.join(ids, "table_name", "left").withColumn("key", F.coalesce("data_id", F.concat(F.lit("table "), "table_name"))))
    one = ids.groupBy("key").agg(F.min("table_name").alias("table_name"))
    asking = query.select(F.col("table_name").alias("q")).distinct()
    # each query table with each content; the query's tables are a handful
    wanted = one.withColumn("q", F.explode(F.array(*(F.lit(r["q"]) for r in asking.collect())))) if not asking.isEmpty() else one.withColumn("q", F.lit(None).cast("string")).limit(0)
    if cache is not None:
        wanted = wanted.join(cache.select("q", F.col("data_id").alias("key")), ["q", "key"], "left_anti")
    wanted = checkpointed(wanted)
    got = table_pairs(query, of_tables(asked, wanted), columns=sizes, **options).select(F.col("a_table_name").alias("q"), F.col("b_table_name").alias("table_name"), "sim")
    new = wanted.join(checkpointed(got), ["q", "table_name"], "left").select("q", "key", "table_name", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    if cache is None:
        by_key, known = new, new.join(digests(wanted), "table_name").select("q", "data_id", "sim")
    else:
        known = cache.select("q", "data_id", "sim").unionByName(new.select("q", F.col("key").alias("data_id"), "sim"))
        by_key = known.withColumnRenamed("data_id", "key")
    pairs = own.join(ids, "table_name").join(by_key.select("q", "key", "sim"), "key").select("q", "d", "sim")
    return pairs, known
