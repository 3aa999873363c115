"""Graph-free baselines: notebooks scored by their sets of libraries, outputs, tables and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .columns import greedy


def output_overlap(outputs: DataFrame, wanted: dict[str, int], *, group: str = "nb_name", kind: str = "data_type") -> DataFrame:
    """(group, overlap): sum over the wanted types of the smaller count, over the wanted total."""
    total = sum(wanted.values())
    counts = outputs.groupBy(group).agg(*(F.count(F.when(F.col(kind) == t, 1)).alias(f"_{i}") for i, t in enumerate(wanted)))
    hit = sum((F.least(F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(wanted.values())), F.lit(0))
    return counts.select(group, (hit / F.lit(total)).alias("overlap") if total else F.lit(0.0).alias("overlap"))


def library_overlap(libraries: DataFrame, wanted: list[str], *, group: str = "nb_name", library: str = "library") -> DataFrame:
    """(group, lib_sim): Jaccard of the distinct libraries with the wanted ones."""
    n = len(set(wanted))
    got = libraries.groupBy(group).agg(F.count_distinct(F.when(F.col(library).isin(*wanted), F.col(library))).alias("hit"), F.count_distinct(library).alias("own"))
    return got.select(group, F.when(F.col("own") > 0, F.col("hit") / (F.col("own") + n - F.col("hit"))).otherwise(0.0).alias("lib_sim"))


def whole_code(cells: DataFrame, *, group: str = "nb_name", order: str = "cell_id", code: str = "cell_code") -> DataFrame:
    """(group, code): a notebook's cells in order as one text, without comments and the lines that they leave empty."""
    joined = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, code))).alias("c"))
    return joined.select(group, text.without_comments(F.array_join(F.transform("c", lambda x: x[code]), "\n")).alias("code"))


def code_overlap(cells: DataFrame, wanted: str, **columns) -> DataFrame:
    """(group, code_sim): token Jaccard of the whole code with the wanted code."""
    own = whole_code(cells, **columns)
    return own.select(own.columns[0], text.token_jaccard(text.without_comments(F.lit(wanted)), F.col("code")).alias("code_sim"))


def greedy_cells(pairs: DataFrame, *, group: str = "nb_name") -> DataFrame:
    """(group, code_sim): sum of a one-to-one greedy matching of query cells and cells, by (group, q, d, sim)."""
    return greedy(pairs, [group], "q", "d", "sim").groupBy(group).agg(F.sum("sim").alias("code_sim"))


def best_cells(pairs: DataFrame, n_query_cells: int, *, group: str = "nb_name") -> DataFrame:
    """(group, code_sim): mean over query cells of the best similarity in the notebook; without a row it is 0."""
    best = pairs.groupBy(group, "q").agg(F.max("sim").alias("sim"))
    return best.groupBy(group).agg((F.sum("sim") / n_query_cells).alias("code_sim"))


def table_assignment(pairs: DataFrame, n_query_tables: int, *, group: str = "nb_name") -> DataFrame:
    """(group, data_sim): of the n best pairs the first of each query table, summed; 0 if there are fewer pairs than query tables."""
    order = Window.partitionBy(group).orderBy(F.desc("sim"), "q", "d")
    top = pairs.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") <= n_query_tables)
    per = top.groupBy(group, "q").agg(F.max("sim").alias("sim"), F.max("_all").alias("_all"))
    return per.groupBy(group).agg(F.when(F.max("_all") >= n_query_tables, F.sum("sim")).otherwise(0.0).alias("data_sim"))


def combined(parts: dict[str, tuple[DataFrame, str, float]], *, group: str = "nb_name") -> DataFrame:
    """(group, score): weighted sum of (frame, column, weight) parts; a missing part is 0."""
    out = None
    for name, (df, column, _) in parts.items():
        one = df.select(group, F.col(column).alias(f"_{name}"))
        out = one if out is None else out.join(one, group, "full")
    total = sum((F.coalesce(F.col(f"_{n}"), F.lit(0.0)) * F.lit(float(w)) for n, (_, _, w) in parts.items()), F.lit(0.0))
    return out.select(group, total.alias("score"))
