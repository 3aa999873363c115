"""Scores of matches and notebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import CELL, OUTPUT, VAR, Query, SearchConfig


def weighted(weight: float, sim: Column) -> Column:
    """w * s for a weight above 0, otherwise |w| * (1 - s)."""
    return F.lit(float(weight)) * sim if weight > 0 else F.lit(float(-weight)) * (1 - sim)


def data_weighted(weight: float, sim: Column, mode: str) -> Column:
    if mode == "reference":
        return F.lit(float(weight)) * (F.lit(float(weight)) * sim) if weight > 0 else F.lit(float(-weight)) * (1 - F.lit(float(weight)) * sim)
    return weighted(weight, sim)


def code_similarity(nodes: DataFrame, q: Query, *, code_col: str = "cell_code", how: str = "tokens") -> DataFrame:
    """nodes with a column sim_<q> for each query cell with code: computed once a node, however many matches it is in."""
    make = {"tokens": text.token_jaccard, "lines": text.line_jaccard}[how] if how != "alignment" else None
    for n in q.nodes:
        if n.label == CELL:
            if make is None:
                from ..functions.align import suffix_similarity

                sim = suffix_similarity(F.col(code_col), F.lit(n.contents or ""))
            else:
                sim = make(F.lit(n.contents or ""), F.col(code_col))
            nodes = nodes.withColumn(f"sim_{n.name}", F.when(F.col("node_type") == CELL, F.coalesce(sim, F.lit(0.0))).otherwise(0.0))
    return nodes


def with_pair_similarity(nodes: DataFrame, pair_sim: DataFrame, names: list[str]) -> DataFrame:
    """nodes with sim_<q> from (q, d, sim) rows; a node without a row has 0."""
    wide = pair_sim.groupBy("d").pivot("q", names).agg(F.max("sim"))
    wide = wide.select(F.col("d").alias("node"), *(F.col(n).alias(f"sim_{n}") for n in names))
    return nodes.join(wide, "node", "left").fillna(0.0, [f"sim_{n}" for n in names])


def match_scores(matches: DataFrame, q: Query, config: SearchConfig, *, code: bool = True, data: bool = True, output: bool = True) -> DataFrame:
    """matches (with carried sim_<q> and display_type columns) with score: the weighted sum over their nodes, of the parts asked for."""
    w = config.node_weights(q)
    total = F.lit(0.0)
    for n in q.nodes:
        if n.name not in matches.columns:
            continue
        if n.label == CELL and code:
            total += weighted(w[CELL], F.col(f"{n.name}__sim_{n.name}"))
        elif n.label == OUTPUT and output:
            total += weighted(w[OUTPUT], F.coalesce((F.col(f"{n.name}__display_type") == F.lit(n.display_type)).cast("double"), F.lit(0.0)))
        elif n.label == VAR and data:
            total += data_weighted(w[VAR], F.col(f"{n.name}__sim_{n.name}"), config.data_weight_mode)
    return matches.withColumn("score", total)


def library_scores(libraries: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(nb_name, lib_sim): Jaccard of a notebook's libraries with the wanted ones, by counts."""
    n = len(set(wanted))
    hit = F.count_distinct(F.when(F.col("library").isin(*wanted), F.col("library"))) if wanted else F.lit(0)
    got = libraries.groupBy("nb_name").agg(hit.alias("hit"), F.count_distinct("library").alias("own"))
    return got.select("nb_name", F.when((F.col("own") > 0) & F.lit(n > 0), F.col("hit") / (F.col("own") + n - F.col("hit"))).otherwise(0.0).alias("lib_sim"))


def notebook_scores(scored: DataFrame, config: SearchConfig, lib_scores: DataFrame | None = None, all_notebooks: DataFrame | None = None) -> DataFrame:
    """(nb_name, score): the best match plus the weighted library similarity, 0 at least."""
    best = scored.groupBy("nb_name").agg(F.max("score").alias("best"))
    if lib_scores is not None:
        best = best.join(lib_scores, "nb_name", "left")
        best = best.select("nb_name", (F.col("best") + config.w_library * F.coalesce("lib_sim", F.lit(0.0))).alias("best"))
    best = best.select("nb_name", F.greatest(F.col("best"), F.lit(0.0)).alias("score"))
    if config.include_unmatched and all_notebooks is not None:
        best = all_notebooks.select("nb_name").distinct().join(best, "nb_name", "left").fillna(0.0, ["score"])
    return best


def top_k(scores: DataFrame, k: int, *, score: str = "score", tie: str = "nb_name") -> DataFrame:
    return scores.orderBy(F.desc(score), F.asc(tie)).limit(k)


def top_k_per(df: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
