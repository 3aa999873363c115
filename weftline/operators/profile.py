"""Column profiles, sketches, the schema index, table sizes and content identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import present

SKETCH_COLUMNS, SKETCH_VALUES = 5, 1000


def column_profile(values: DataFrame) -> DataFrame:
    """(table_name, col, col_pos, dtype, n_rows, n_values, n_distinct, ratio) of each column."""
    return values.groupBy("table_name", "col", "col_pos", "dtype").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.count_distinct("value").alias("n_distinct")).withColumn("ratio", F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).otherwise(0.0))


def sketch_columns(profile: DataFrame, size: int = SKETCH_COLUMNS) -> DataFrame:
    """The columns that stand for a table: all if it has few, otherwise without index and float columns those with the most distinct values for their rows."""
    whole = Window.partitionBy("table_name")
    counted = profile.withColumn("n_cols", F.count("*").over(whole)).where((F.col("n_cols") <= size) | ((F.col("dtype") != "float64") & ~F.col("col").contains("index") & ~F.col("col").startswith("Unnamed")))
    return counted.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("ratio"), "col_pos"))).where(F.col("rank") <= size).drop("n_cols")


def sketch_values(values: DataFrame, keys: list[str], size: int = SKETCH_VALUES) -> DataFrame:
    """At most size distinct values of each column, those of the smallest md5: the same sample each time, and samples of equal columns are equal.

    The smallest of each of 64 parts of a column are found first, so that no task
    sorts a whole column.
    """
    own = present(values).select(*keys, "col", "dtype", "value").distinct().withColumn("_h", F.md5(F.col("value").cast("binary"))).withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(64)))
    column = [*keys, "col", "dtype"]
    for part in ([*column, "_part"], column):
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy("_h", "value"))).where(F.col("_n") <= size)
    return own.drop("_n", "_h", "_part")


def sketch(values: DataFrame, *, columns: int = SKETCH_COLUMNS, rows: int = SKETCH_VALUES) -> DataFrame:
    """(table_name, col, dtype, value): of the columns that stand for each table a sample of their values."""
    chosen = sketch_columns(column_profile(values), columns).select("table_name", "col")
    return sketch_values(values.join(chosen, ["table_name", "col"], "left_semi"), ["table_name"], rows)


def schema_index(values: DataFrame) -> DataFrame:
    """(group_id, col, sid, dtype, n_tables, n_distinct) of the columns of each group of tables; sid numbers columns by first position and name."""
    # each different value once, combined before the shuffle; the tables are counted without the values, which are then not read
    once = values.groupBy("group_id", "col", "value").agg(F.count("*"))
    own = once.groupBy("group_id", "col").agg(F.count("value").alias("n_distinct"))
    tables = values.select("group_id", "col", "table_name", "col_pos", "dtype").distinct()
    tables = tables.groupBy("group_id", "col").agg(F.count_distinct("table_name").alias("n_tables"), F.min(F.struct("table_name", "col_pos", "dtype")).alias("first"))
    both = own.join(tables, ["group_id", "col"]).withColumn("sid", F.row_number().over(Window.partitionBy("group_id").orderBy("first.table_name", "first.col_pos", "col")))
    return both.select("group_id", "col", F.col("first.dtype").alias("dtype"), "n_tables", "n_distinct", "sid")


def schema_values(values: DataFrame) -> DataFrame:
    """(group_id, col, dtype, value): the distinct values of the schema's columns."""
    return present(values).select("group_id", "col", "dtype", "value").distinct()


def table_sizes(values: DataFrame, *, distinct: bool = False) -> DataFrame:
    """(table_name, n_cols, n_cells, n_bytes): 4 bytes an integer or flag, 8 a float or time, a string's length; null is nothing. distinct: each value of a column once."""
    own = values.where(F.col("value").isNotNull()).select("table_name", "col", "dtype", "value")
    if distinct:
        own = own.distinct()
    width = F.when(F.col("dtype").isin("int64", "bool"), F.lit(4)).when(F.col("dtype") == "object", F.length("value")).otherwise(F.lit(8))
    return own.groupBy("table_name").agg(F.count_distinct("col").alias("n_cols"), F.count("*").alias("n_cells"), F.sum(width).cast("long").alias("n_bytes"))


def dtype_counts(values: DataFrame) -> DataFrame:
    return values.select("table_name", "col", "dtype").distinct().groupBy("table_name", "dtype").agg(F.count("*").alias("n"))


def size_summary(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.min("n_bytes").alias("min_bytes"), F.max("n_bytes").alias("max_bytes"), F.avg("n_bytes").alias("avg_bytes"), F.sum("n_bytes").alias("sum_bytes"), F.count(F.when(F.col("n_cells") == 0, 1)).alias("n_empty"))


def column_sizes(values: DataFrame) -> DataFrame:
    """(table_name, col, n) of each column. Of cells only col is asked for: of one field Spark makes no others."""
    return values.groupBy("table_name", "col").agg(F.count("*").alias("n"))


def alike(sizes: DataFrame) -> DataFrame:
    """(table_name) of the tables that another one may be equal to: it has columns of the same names, as long; sizes are column_sizes()."""
    shapes = sizes.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("col", "n"))).alias("shape"))
    shared = shapes.groupBy("shape").agg(F.count("*").alias("n")).where("n > 1")
    return shapes.join(shared, "shape").select("table_name")


def content_ids(values: DataFrame) -> DataFrame:
    """(table_name, same_as, digest): tables of equal columns and rows (in any row order) share the digest and the first table's name.

    A cell is hashed by itself; the hashes of a row's cells are summed (both halves
    of 64 bits), so that cells are combined before the shuffle and none is
    gathered. The hashes of the rows are summed in turn (128 bits as two sums).
    """
    cell = F.xxhash64("col", "dtype", F.col("value").isNull(), "value")
    halves = values.select("table_name", "row_id", cell.alias("c"))
    rows = halves.groupBy("table_name", "row_id").agg(F.sum(F.shiftrightunsigned("c", 32)).alias("hi"), F.sum(F.col("c").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")).select("table_name", F.xxhash64("hi", "lo").alias("h"))
    table = rows.groupBy("table_name").agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned("h", 1).cast("decimal(38,0)")).alias("s1"), F.sum(F.shiftrightunsigned(F.xxhash64("h"), 1).cast("decimal(38,0)")).alias("s2"))
    digest = F.sha2(F.concat_ws("|", "n", "s1", "s2"), 256)
    named = table.select("table_name", digest.alias("digest"))
    ids = named.groupBy("digest").agg(F.min("table_name").alias("first_table"))
    return named.join(ids, "digest").select("table_name", F.col("first_table").alias("same_as"), "digest")


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_same): rows of equal text share the smallest id; the text itself is not shuffled."""
    keyed = docs.select(id_col, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("h"), F.col(text_col).isNull().alias("nul"))
    first = keyed.groupBy("h", "nul").agg(F.min(id_col).alias("class_id"), F.count("*").alias("n_same"))
    return keyed.join(first, ["h", "nul"]).select(id_col, "class_id", "n_same")
