"""Notebook files to stored cells, outputs, libraries, variables, lineage and workflow graphs, in one call."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dependencies import table_function
from . import notebooks, sinks

log = logging.getLogger(__name__)


def libraries(cells: DataFrame) -> DataFrame:
    return cells.select("nb_name", F.explode(text.imports("cell_code")).alias("library")).distinct()


def variables(cells: DataFrame) -> DataFrame:
    """(nb_name, cell_id, var): what each cell assigns."""
    return table_function(cells, "code_variables", "cell_code", ["nb_name", "cell_id"]).select("nb_name", "cell_id", "var")


def uses(cells: DataFrame) -> DataFrame:
    """(nb_name, cell_id, var): the names that each cell reads."""
    return table_function(cells, "code_reads", "cell_code", ["nb_name", "cell_id"]).select("nb_name", "cell_id", "var")


def lineage(cells: DataFrame) -> DataFrame:
    """(view_id, dependency, line2cid, last_line) of each variable of each notebook: the assignments of the notebook's code, one line each, and their cells."""
    flat = table_function(cells, "code_assignments", "cell_code", ["nb_name", "cell_id"])
    each = flat.groupBy("nb_name", "cell_id", "line").agg(F.array_sort(F.collect_set("lhs")).alias("lhs"), F.array_sort(F.collect_set(F.when(F.col("rhs_var").isNotNull(), F.struct(F.col("rhs_var").alias("var"), "op")))).alias("rhs"))
    listed = each.groupBy("nb_name").agg(F.array_sort(F.collect_list(F.struct("cell_id", "line", "lhs", "rhs"))).alias("a"))
    numbered = listed.select("nb_name", F.transform("a", lambda x, i: F.struct((i + 1).alias("n"), x["cell_id"].alias("cell_id"), x["lhs"].alias("lhs"), x["rhs"].alias("rhs"))).alias("a"))
    maps = numbered.select("nb_name", F.map_from_entries(F.transform("a", lambda x: F.struct(x["n"], F.struct(x["lhs"].alias("lhs"), x["rhs"].alias("rhs"))))).alias("dependency"), F.map_from_entries(F.transform("a", lambda x: F.struct(x["n"], x["cell_id"]))).alias("line2cid"), "a")
    last = maps.select("*", F.explode("a").alias("x")).select("nb_name", "dependency", "line2cid", F.explode("x.lhs").alias("var"), "x.n", "x.cell_id")
    order = last.groupBy("nb_name", "var").agg(F.max(F.struct("n", "cell_id")).alias("top"))
    return maps.drop("a").join(order, "nb_name").select(F.concat_ws("_", F.col("top.cell_id").cast("string"), "var", "nb_name").alias("view_id"), "dependency", "line2cid", F.col("top.n").alias("last_line"))


def ingest(spark: SparkSession, path: str, root: str, *, is_table=None) -> dict[str, str | None]:
    """Read the notebooks below path and store what they hold below root; for each part what went wrong, or None.

    Parts: cells, libraries, display_types, cell_dict, lineage, wf_nodes, wf_edges.
    Rows that are stored already stay as they are, so it can run again, over more
    notebooks too. A part that fails is logged and doesn't stop the others.
    is_table: a condition on a variable's name (column var) that keeps tables; all
    variables without it (their types are known only to who runs the code).
    """
    read = notebooks.read(spark, path)
    cells = notebooks.cells(read)
    shown = notebooks.display_types(read)

    def own_variables():
        got = variables(cells)
        return got if is_table is None else got.where(is_table)

    def graph(part: int):
        return notebooks.workflow(cells, own_variables(), uses(cells), shown)[part]

    parts = {
        "cells": lambda: sinks.store_cells(cells, f"{root}/cells"),
        "libraries": lambda: sinks.store_libraries(libraries(cells), f"{root}/libraries"),
        "display_types": lambda: sinks.store_display_types(shown, f"{root}/display_types"),
        "cell_dict": lambda: sinks.append_new(sinks.cell_dictionary(cells), f"{root}/cell_dict", ["code"]),
        "lineage": lambda: sinks.store_lineage(lineage(cells), f"{root}/lineage"),
        "wf_nodes": lambda: sinks.append_new(graph(0), f"{root}/wf_nodes", ["nb_name", "node"]),
        "wf_edges": lambda: sinks.append_new(graph(1), f"{root}/wf_edges", ["nb_name", "src", "dst", "rel"]),
    }
    out: dict[str, str | None] = {}
    for name, store in parts.items():
        try:
            store()
            out[name] = None
        except Exception as e:  # a part that can't be stored must not stop the others
            log.exception("storing %s failed", name)
            out[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return out
