"""Reading tables of any schema into the long form that table search runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.columns import long_form


def table_names(spark: SparkSession, database: str | None = None, contains: str = "", *, views: bool = False) -> list[str]:
    """Names of the catalog's tables, or of its views, that hold a text."""
    return sorted(t.name for t in spark.catalog.listTables(database) if contains in t.name and (t.tableType in ("VIEW", "TEMPORARY")) == views)


def long_tables(spark: SparkSession, tables: dict[str, tuple[DataFrame, int]], *, skip_index: bool = False) -> DataFrame:
    """cell_values of named (frame, group) tables, one union."""
    out = None
    for name, (df, group) in tables.items():
        one = long_form(df, name, group, skip_index=skip_index)
        out = one if out is None else out.unionByName(one)
    return out


def read_all(spark: SparkSession, paths: dict[str, tuple[str, int]], *, skip_index: bool = True) -> tuple[DataFrame | None, dict[str, str]]:
    """cell_values of Parquet tables by name, and why tables that can't be read were left out."""
    good, bad = {}, {}
    for name, (path, group) in paths.items():
        try:
            df = spark.read.parquet(path)
            if df.columns:
                good[name] = (df, group)
        except Exception as e:  # a table that can't be read must not stop the others
            bad[name] = type(e).__name__
    return (long_tables(spark, good, skip_index=skip_index) if good else None), bad


def one_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A stored variable's table by its name; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        return None


def query_table(spark: SparkSession, csv_text: str) -> DataFrame:
    """A query's table from CSV text with a header; types are inferred."""
    import csv
    import io

    rows = list(csv.reader(io.StringIO(csv_text)))
    raw = spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0])) if len(rows) > 1 else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in rows[0]))
    lines = [",".join('"' + v.replace('"', '""') + '"' if set(v) & set(',"\n') else v for v in r) for r in rows]
    return spark.read.csv(spark.sparkContext.parallelize(lines, 1), header=True, inferSchema=True) if len(rows) > 1 else raw
