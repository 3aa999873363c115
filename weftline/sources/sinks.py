"""Writing tables, cells, metadata and graphs; what is there already is not written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_column_name, code_key
from ..model import SCHEMAS, Query


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def store_table(df: DataFrame, root: str, name: str) -> None:
    """A variable's table, replaced as a whole; column names lose ( ) blanks and %."""
    df.toDF(*(clean_column_name(c) for c in df.columns)).write.mode("overwrite").parquet(f"{root}/{name}")


def store_variable(df: DataFrame, lineage: DataFrame | None, root: str, name: str) -> None:
    """A variable's table, its lineage (rows of lineage, those of view name), and a mark in indexed that it is stored, in this order."""
    store_table(df, f"{root}/tables", name)
    if lineage is not None:
        store_lineage(lineage.where(F.col("view_id") == name), f"{root}/lineage")
    append_new(df.sparkSession.createDataFrame([(name,)], "table_name string"), f"{root}/indexed", ["table_name"])


def store_variables(tables: dict[str, DataFrame], lineage: DataFrame | None, root: str) -> dict[str, str]:
    """store_variable() of each; what went wrong with those that could not be stored."""
    failed = {}
    for name, df in tables.items():
        try:
            store_variable(df, lineage, root, name)
        except Exception as e:  # a table that can't be written must not stop the others
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return failed


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows whose keys aren't stored yet, each key once."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    try:
        stored = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        stored = None
    if stored is not None:
        new = new.join(stored, keys, "left_anti")
    new.write.mode("append").parquet(path)


def store_cells(cells: DataFrame, path: str, *, replace: bool = False) -> None:
    """Cells that aren't empty; appended where new, or the notebooks' cells replaced."""
    own = cells.where(F.trim("cell_code") != "")
    if replace:
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("nb_name").parquet(path)
    else:
        append_new(own, path, ["nb_name", "cell_id"])


def store_libraries(libraries: DataFrame, path: str) -> None:
    append_new(libraries.select("nb_name", "library"), path, ["nb_name", "library"])


def store_display_types(types: DataFrame, path: str) -> None:
    append_new(types.select("nb_name", "cell_id", "data_type"), path, ["nb_name", "cell_id", "data_type"])


def store_scalars(scalars: DataFrame, path: str) -> None:
    append_new(scalars.withColumn("contents", F.col("contents").cast("string")), path, ["nb_name", "cell_id", "var_name"])


def store_lineage(lineage: DataFrame, path: str) -> None:
    def as_json(column):  # JSON has text keys only
        return F.to_json(F.transform_keys(column, lambda k, _: k.cast("string"))).alias(column)

    append_new(lineage.select("view_id", as_json("dependency"), as_json("line2cid"), "last_line"), path, ["view_id"])


def cell_dictionary(cells: DataFrame) -> DataFrame:
    """(code, cell_id): each distinct code once, as base64, with the smallest cell that has it."""
    return cells.groupBy(code_key("cell_code").alias("code")).agg(F.min("cell_id").alias("cell_id"))


def store_version(df: DataFrame, root: str, name: str) -> bool:
    """Store a table as a new version only if its content differs from the stored one; whether it did."""
    from ..operators.columns import long_form
    from ..operators.profile import content_ids

    try:
        old = df.sparkSession.read.parquet(f"{root}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and old.columns == df.columns:
        ids = content_ids(long_form(old, "old", 0).unionByName(long_form(df, "new", 0)))
        if ids.select("digest").distinct().count() == 1:
            return False
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return True


def store_schema_index(index: DataFrame, values: DataFrame, root: str) -> None:
    index.write.mode("overwrite").parquet(f"{root}/schema_index")
    values.write.mode("overwrite").parquet(f"{root}/schema_values")


def load_schema_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/schema_index"), spark.read.parquet(f"{root}/schema_values")


def build_index(values: DataFrame, root: str, stars: DataFrame | None = None, *, columns: int = 5, rows: int = 1000) -> None:
    """Materialise what table search starts from: the schema index, sketches of the groups' and the tables' columns, and star graphs."""
    from ..operators import profile

    store_schema_index(profile.schema_index(values), profile.schema_values(values), root)
    profile.sketch(values, columns=columns, rows=rows).write.mode("overwrite").parquet(f"{root}/sketch")
    profile.sketch_values(values, ["group_id"], rows).write.mode("overwrite").parquet(f"{root}/schema_sketch")
    if stars is not None:
        stars.write.mode("overwrite").parquet(f"{root}/stars")


def store_similarities(pairs: DataFrame, path: str) -> None:
    """Lines of [q, d, sim]."""
    pairs.select(F.to_json(F.array("q", "d", F.col("sim").cast("string"))).alias("value")).write.mode("overwrite").text(path)


def store_ids(ids: dict[str, int], spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(v, k) for k, v in ids.items()], "data_id long, table_name string").write.mode("overwrite").parquet(path)


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """(data_id, table_name) as store_ids() wrote them."""
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_query(q: Query, path: str) -> None:
    with open(path, "w") as f:
        f.write(q.to_json())


def load_query(path: str) -> Query:
    with open(path) as f:
        return Query.from_json(f.read())
