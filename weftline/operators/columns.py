"""Set similarity of columns in long form, through an inverted index, and greedy one-to-one matching.

Long form is cell_values: (table_name, group_id, col, col_pos, dtype, row_id,
value). Columns are only compared when their dtype is the same and are compared
by the values that they share: an equi-join on (dtype, value), never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import broadcast_if
from ..functions.text import is_index_column

#: Smallest Jaccard of two columns that map to each other.
THRESHOLD = 0.3


def long_form(df: DataFrame, table_name: str, group_id: int, *, skip_index: bool = False) -> DataFrame:
    """cell_values rows of a table; values as canonical text, one pass over it."""
    kinds = {"bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64", "double": "float64", "float": "float64", "boolean": "bool", "string": "object"}
    cols = []
    for pos, (name, kind) in enumerate(df.dtypes):
        if skip_index and (name.startswith("Unnamed") or "index" in name):
            continue
        dtype = kinds.get(kind, "datetime64" if kind.startswith(("timestamp", "date")) else kind)
        cols.append(F.struct(F.lit(name).alias("col"), F.lit(pos).alias("col_pos"), F.lit(dtype).alias("dtype"), F.col(f"`{name}`").cast("string").alias("value")))
    # the row's number is made below the explode, so that the cells of a row share it
    rows = df.select(F.array(*cols).alias("x"), F.monotonically_increasing_id().alias("row_id")).select(F.explode("x").alias("x"), "row_id")
    return rows.select(F.lit(table_name).alias("table_name"), F.lit(group_id).alias("group_id"), "x.col", "x.col_pos", "x.dtype", "row_id", "x.value")


#: Tables whose names are listed in a filter; the names of more are joined.
LISTED = 1000


def of_tables(values: DataFrame, names: DataFrame) -> DataFrame:
    """The cells of the tables in names (table_name, a checkpoint); a short list of them leaves whole other tables unread."""
    listed = [r["table_name"] for r in names.select("table_name").distinct().limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        return values.join(broadcast_if(names.select("table_name").distinct()), "table_name", "left_semi")
    return values.where(F.col("table_name").isin(listed))


def present(values: DataFrame) -> DataFrame:
    """Rows with a value, of columns that are no index."""
    return values.where(F.col("value").isNotNull() & (F.col("value") != "NaN") & ~is_index_column("col"))


def distinct_values(values: DataFrame, keys: list[str]) -> DataFrame:
    return present(values).select(*keys, "col", "dtype", "value").distinct()


def pair_jaccard(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str]) -> DataFrame:
    """(a_<keys>, a_col, b_<keys>, b_col, dtype, inter, n_a, n_b, sim) of all column pairs that share a value.

    a and b hold distinct (keys, col, dtype, value). Pairs without a common value
    have similarity 0 and no row.
    """
    left = a.select(*(F.col(k).alias(f"a_{k}") for k in a_keys), F.col("col").alias("a_col"), "dtype", "value")
    right = b.select(*(F.col(k).alias(f"b_{k}") for k in b_keys), F.col("col").alias("b_col"), "dtype", "value")
    ka, kb = [f"a_{k}" for k in a_keys] + ["a_col"], [f"b_{k}" for k in b_keys] + ["b_col"]
    inter = left.join(right, ["dtype", "value"]).groupBy(*ka, *kb, "dtype").agg(F.count("*").alias("inter"))
    n_a, n_b = left.groupBy(*ka, "dtype").agg(F.count("*").alias("n_a")), right.groupBy(*kb, "dtype").agg(F.count("*").alias("n_b"))
    sized = inter.join(n_a, [*ka, "dtype"]).join(n_b, [*kb, "dtype"])
    return sized.withColumn("sim", F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter")))


def greedy(pairs: DataFrame, group: list[str], left: str, right: str, sim: str, *, descending: bool = True, least: float | None = None) -> DataFrame:
    """One-to-one matching within each group: pairs in order of sim (ties by left, then right), taken if both ends are free.

    A fold over the sorted pairs of a group, as one expression; groups are pairs
    of tables, so their pairs are at most columns times columns.
    """
    if least is not None:
        pairs = pairs.where(F.col(sim) >= least)
    rank = -F.col(sim) if descending else F.col(sim)
    listed = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col(left).alias("a"), F.col(right).alias("b"), F.col(sim).alias("s")))).alias("p"))
    kind = dict(listed.dtypes)["p"]

    def take(held: Column, x: Column) -> Column:
        free = ~F.exists(held, lambda h: (h["a"] == x["a"]) | (h["b"] == x["b"]))
        return F.when(free, F.concat(held, F.array(x))).otherwise(held)

    got = listed.withColumn("p", F.aggregate("p", F.array().cast(kind), take)).withColumn("p", F.explode("p"))
    return got.select(*group, F.col("p.a").alias(left), F.col("p.b").alias(right), F.col("p.s").alias(sim))
