"""Schema mapping between tables and groups of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import broadcast_if, checkpointed
from .columns import THRESHOLD, distinct_values, greedy, pair_jaccard


def column_pairs(a: DataFrame, b: DataFrame, *, a_key: str = "table_name", b_key: str = "table_name", least: float | None = None, few: bool = False) -> DataFrame:
    """Similarity of the columns of a's tables (or groups) and b's.

    few: a is small beside b. Its values are then found at once and broadcast up to
    BROADCAST_ROWS, and of b only the columns of its dtypes are made distinct.
    """
    left = distinct_values(a, [a_key])
    if few:
        left = broadcast_if(checkpointed(left))
        b = b.where(F.col("dtype").isin([r["dtype"] for r in left.select("dtype").distinct().collect()]))
    pairs = pair_jaccard(left, distinct_values(b, [b_key]), [a_key], [b_key])
    return pairs if least is None else pairs.where(F.col("sim") >= least)


def map_tables(a: DataFrame, b: DataFrame, *, a_key: str = "table_name", b_key: str = "table_name", least: float = THRESHOLD) -> DataFrame:
    """One-to-one mapping of columns for each pair of tables (or groups)."""
    return greedy(column_pairs(a, b, a_key=a_key, b_key=b_key), [f"a_{a_key}", f"b_{b_key}"], "a_col", "b_col", "sim", least=least)


def linked_pairs(a: DataFrame, b: DataFrame, to_group: DataFrame, index: DataFrame) -> DataFrame:
    """Column pairs that meet in a schema element: a's column is mapped to a column of b's group, b's column is the same element, and both are of one dtype.

    to_group: (a_table_name, group_id, a_col, group_col); index: group_id, col and
    sid of the groups' columns. Of several columns of a that are one element the
    last counts.
    """
    kinds_a = a.select(F.col("table_name").alias("a_table_name"), F.col("col").alias("a_col"), "col_pos", F.col("dtype").alias("a_dtype")).distinct()
    kinds_b = b.select(F.col("table_name").alias("b_table_name"), "group_id", F.col("col").alias("b_col"), F.col("dtype").alias("b_dtype")).distinct()
    sids = index.select("group_id", "col", "sid")
    left = to_group.join(sids.withColumnRenamed("col", "group_col"), ["group_id", "group_col"]).join(kinds_a, ["a_table_name", "a_col"])
    left = left.groupBy("a_table_name", "group_id", "sid").agg(F.max(F.struct("col_pos", "a_col", "a_dtype")).alias("x"))
    right = kinds_b.join(sids.withColumnRenamed("col", "b_col"), ["group_id", "b_col"])
    return left.join(right, ["group_id", "sid"]).where("x.a_dtype = b_dtype").select("a_table_name", "b_table_name", F.col("x.a_col").alias("a_col"), "b_col")


def extend_mapping(known: DataFrame, a: DataFrame, b: DataFrame, *, to_group: DataFrame | None = None, index: DataFrame | None = None, least: float = THRESHOLD) -> DataFrame:
    """A partial mapping (a_table_name, b_table_name, a_col, b_col, sim) with what the columns that it leaves free map to.

    First through schema elements (linked_pairs(), where to_group and index are
    given), whatever their similarity, then by similarity of least or more.
    """
    pairs = column_pairs(a, b)
    on = ["a_table_name", "b_table_name"]
    known = known.select(*on, "a_col", "b_col", "sim")

    def free(x):
        return x.join(known.select(*on, "a_col"), [*on, "a_col"], "left_anti").join(known.select(*on, "b_col"), [*on, "b_col"], "left_anti")

    if to_group is not None and index is not None:
        linked = free(linked_pairs(a, b, to_group, index)).join(pairs.select(*on, "a_col", "b_col", "sim"), [*on, "a_col", "b_col"], "left").fillna(0.0, ["sim"])
        known = known.unionByName(greedy(linked, on, "a_col", "b_col", "sim"))
    return known.unionByName(greedy(free(pairs), on, "a_col", "b_col", "sim", least=least))


def mapping_by_schema(a: DataFrame, b: DataFrame, index: DataFrame) -> DataFrame:
    """Columns of two tables of one group that are one schema element (sid) of one dtype."""
    own = index.select("group_id", "col", "sid", F.col("dtype").alias("sid_dtype"))

    def keyed(df, side):
        return df.select("table_name", "group_id", "col", "dtype").distinct().join(own, ["group_id", "col"]).where("dtype = sid_dtype").select("group_id", "sid", "dtype", F.col("table_name").alias(f"{side}_table_name"), F.col("col").alias(f"{side}_col"))

    return keyed(a, "a").join(keyed(b, "b"), ["group_id", "sid", "dtype"])


def matching_groups(a: DataFrame, schema: DataFrame, *, least: float = THRESHOLD) -> DataFrame:
    """(a_table_name, b_group_id, best): groups with a column similar enough to one of the table's, whatever the columns' dtypes."""
    a, schema = (x.withColumn("dtype", F.lit("any")) for x in (a, schema))
    return column_pairs(a, schema, b_key="group_id").groupBy("a_table_name", "b_group_id").agg(F.max("sim").alias("best")).where(F.col("best") >= least)


def join_mapping(sketched: DataFrame, whole: DataFrame, *, least: float = THRESHOLD) -> DataFrame:
    """Mapping from two sets of column pairs (sketched and whole columns): a pair has its larger similarity."""
    on = ["a_table_name", "b_table_name"]
    both = sketched.unionByName(whole, allowMissingColumns=True).groupBy(*on, "a_col", "b_col").agg(F.max("sim").alias("sim"))
    return greedy(both, on, "a_col", "b_col", "sim", least=least)
