"""Graph query to the best notebooks, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..model import CELL, VAR, Query, SearchConfig
from ..operators import match, score


def search(nodes: DataFrame, edges: DataFrame, q: Query, config: SearchConfig, *, libraries: DataFrame | None = None, pair_sim: DataFrame | None = None, tables: tuple[DataFrame, DataFrame, DataFrame] | None = None, reach: DataFrame | None = None, code_col: str = "cell_code", **data_options) -> DataFrame:
    """(nb_name, score) of the config.k best notebooks.

    nodes carry code in code_col. Data similarity comes from pair_sim, (q, d, sim)
    for query tables and table variables, or from tables: cell_values of the query's
    tables (named as its nodes), cell_values of the variables' tables, and (d,
    table_name); data_options as for data_similarity.pair_similarity(), how="tables"
    or by table search. Where it is costly use pruned_search.
    """
    if pair_sim is None and tables is not None and config.w_data != 0:
        from .data_similarity import pair_similarity

        pair_sim = pair_similarity(*tables, **data_options)[0]
    data = [n.name for n in q.nodes if n.label == VAR]
    ready = score.code_similarity(nodes, q, code_col=code_col, how=config.code_similarity)
    ready = score.with_pair_similarity(ready, pair_sim, data) if pair_sim is not None and data else ready.select("*", *(F.lit(0.0).alias(f"sim_{n}") for n in data))
    carry = tuple(c for c in ready.columns if c.startswith("sim_") or c == "display_type")
    found = match.find(ready, edges, q, reach=reach, injective=config.injective, carry=carry)
    scored = score.match_scores(found, q, config)
    lib = score.library_scores(libraries, q.libraries) if libraries is not None else None
    return score.top_k(score.notebook_scores(scored, config, lib, nodes), config.k)


def _pruned(cheap: DataFrame, names: list[str], full, bound: float, config: SearchConfig) -> DataFrame:
    """The best notebooks by full scores, of which only those matches are scored in full that can reach the k-th best with bound more than their cheap part."""
    cheap = checkpointed(cheap.select("nb_name", *names, "score"))
    leaders = score.top_k(cheap.groupBy("nb_name").agg(F.max("score").alias("score")), config.k).select("nb_name")
    first = score.top_k(score.notebook_scores(full(cheap.join(leaders, "nb_name", "left_semi")), config), config.k)
    low = first.agg(F.min("score").alias("low"), F.count("*").alias("n")).first()
    left = cheap.where(F.col("score") + bound >= low["low"]) if low["n"] == config.k else cheap
    return score.top_k(score.notebook_scores(full(left), config), config.k)


def _with_libraries(cheap: DataFrame, q: Query, config: SearchConfig, libraries: DataFrame | None) -> DataFrame:
    if libraries is None:
        return cheap
    lib = score.library_scores(libraries, q.libraries)
    return cheap.join(lib, "nb_name", "left").withColumn("score", F.col("score") + config.w_library * F.coalesce("lib_sim", F.lit(0.0)))


def pruned_search(nodes: DataFrame, edges: DataFrame, q: Query, config: SearchConfig, data_sim, *, libraries: DataFrame | None = None, reach: DataFrame | None = None, code_col: str = "cell_code") -> DataFrame:
    """search() with data similarity computed for few variables only; the result is the same.

    data_sim: a function from (q, d) rows to (q, d, sim) rows. The cheap part of
    all matches is scored first. The exact scores of the best notebooks by it give
    a lower bound of the k-th best score, and only matches that can still reach it
    with the largest possible data part are scored in full.
    """
    data = [n.name for n in q.nodes if n.label == VAR]
    w = config.node_weights(q)[VAR]
    ready = score.code_similarity(nodes, q, code_col=code_col, how=config.code_similarity)
    carry = tuple(c for c in ready.columns if c.startswith("sim_") or c == "display_type")
    cheap = score.match_scores(match.find(ready, edges, q, reach=reach, injective=config.injective, carry=carry), q, config, data=False)
    names = [n.name for n in q.nodes if n.name in cheap.columns]
    cheap = _with_libraries(cheap, q, config, libraries)

    def full(part: DataFrame) -> DataFrame:
        for n in data:
            asked = part.select(F.lit(n).alias("q"), F.col(n).alias("d")).distinct()
            sims = data_sim(asked).where(F.col("q") == n).groupBy(F.col("d").alias(n)).agg(F.max("sim").alias("_s"))
            part = part.join(sims, n, "left").withColumn("score", F.col("score") + score.data_weighted(w, F.coalesce("_s", F.lit(0.0)), config.data_weight_mode)).drop("_s")
        return part

    if not data:
        return score.top_k(score.notebook_scores(cheap, config), config.k)
    # the data part's largest value: similarities lie between 0 and 1
    ends = [w, 0.0] if w > 0 else [-w, 0.0]
    if config.data_weight_mode == "reference":
        ends = [w * w, 0.0] if w > 0 else [-w, -w * (1 - w)]
    return _pruned(cheap, names, full, len(data) * max(ends), config)


def code_pruned_search(nodes: DataFrame, edges: DataFrame, q: Query, config: SearchConfig, *, pair_sim: DataFrame | None = None, libraries: DataFrame | None = None, reach: DataFrame | None = None, code_col: str = "cell_code") -> DataFrame:
    """search() with code similarity computed for few cells only; the result is the same.

    Outputs, libraries and, where pair_sim gives it, data are scored first; code is
    compared in matches that can still reach the k-th best score. For queries
    without a data weight, or whose data similarity is at hand (from table search).
    """
    data, cells = ([n.name for n in q.nodes if n.label == label] for label in (VAR, CELL))
    w = config.node_weights(q)[CELL]
    ready = score.with_pair_similarity(nodes, pair_sim, data) if pair_sim is not None and data else nodes.select("*", *(F.lit(0.0).alias(f"sim_{n}") for n in data))
    carry = tuple(c for c in ready.columns if c.startswith("sim_") or c == "display_type")
    cheap = score.match_scores(match.find(ready, edges, q, reach=reach, injective=config.injective, carry=carry), q, config, code=False)
    names = [n.name for n in q.nodes if n.name in cheap.columns]
    cheap = _with_libraries(cheap, q, config, libraries)

    def full(part: DataFrame) -> DataFrame:
        asked = part.select(F.explode(F.array(*cells)).alias("node")).distinct()
        sims = score.code_similarity(nodes.join(asked, "node", "left_semi"), q, code_col=code_col, how=config.code_similarity)
        for n in cells:
            own = sims.select("nb_name", F.col("node").alias(n), F.col(f"sim_{n}").alias("_s"))
            part = part.join(own, ["nb_name", n], "left").withColumn("score", F.col("score") + score.weighted(w, F.coalesce("_s", F.lit(0.0)))).drop("_s")
        return part

    return _pruned(cheap, names, full, len(cells) * abs(w), config)
