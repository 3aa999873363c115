"""Reading notebook files: cells and recorded outputs, without running anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_notebook_name, output_kind

_TEXT = "array<string>"
_FORMAT = f"struct<metadata:struct<language_info:struct<name:string>>,cells:array<struct<cell_type:string,source:string,outputs:array<struct<output_type:string,data:map<string,string>>>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, nb_name, nb) of the .ipynb files below path; names with zip in them are skipped, other languages than Python are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ipynb").load(path)
    own = files.where(~F.col("path").contains("zip")).select("path", F.from_json(F.decode("content", "UTF-8"), _FORMAT).alias("nb"))
    language = F.lower(F.coalesce("nb.metadata.language_info.name", F.lit("python")))
    return own.where(language == "python").select("path", clean_notebook_name("path").alias("nb_name"), "nb")


def _joined(c):
    """Notebook text is one string or a list of lines."""
    return F.when(c.startswith("["), F.array_join(F.from_json(c, _TEXT), "")).otherwise(c)


def cells(notebooks: DataFrame) -> DataFrame:
    """(nb_name, cell_id, cell_code): cells are numbered from 1, all kinds; only code cells are rows."""
    own = notebooks.select("nb_name", F.posexplode("nb.cells").alias("pos", "c"))
    return own.where("c.cell_type = 'code'").select("nb_name", (F.col("pos") + 1).cast("int").alias("cell_id"), _joined(F.coalesce("c.source", F.lit(""))).alias("cell_code"))


def display_types(notebooks: DataFrame) -> DataFrame:
    """(nb_name, cell_id, data_type): the distinct kinds of output of each code cell."""
    own = notebooks.select("nb_name", F.posexplode("nb.cells").alias("pos", "c")).where("c.cell_type = 'code'").select("nb_name", (F.col("pos") + 1).cast("int").alias("cell_id"), F.explode("c.outputs").alias("o"))
    html = F.coalesce(_joined(F.col("o.data")["text/html"]), F.lit(""))
    return own.select("nb_name", "cell_id", output_kind(html, F.col("o.data")["image/png"].isNotNull(), F.col("o.output_type") == "display_data").alias("data_type")).distinct()


def workflow(cells_: DataFrame, variables: DataFrame, uses: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wf_nodes and wf_edges from cells, variables (nb_name, cell_id, var), uses (nb_name, cell_id, var) and outputs.

    A cell's successor is the next cell; a used variable is that of the latest
    earlier cell that defines it; outputs are named <cell>_<type>_<notebook>.
    """
    from pyspark.sql import Window

    from ..operators.provenance import previous_definition

    cell = F.concat(F.lit("cell_"), F.col("cell_id").cast("string"), F.lit("_"), F.col("nb_name"))
    var = F.concat_ws("_", F.col("cell_id").cast("string"), "var", "nb_name")
    out = F.concat_ws("_", F.col("cell_id").cast("string"), "data_type", "nb_name")
    none = F.lit(None).cast("string")
    nodes = (
        cells_.select("nb_name", cell.alias("node"), F.lit("Cell").alias("node_type"), F.col("cell_id").alias("real_cell_id"), none.alias("display_type"))
        .unionByName(variables.select("nb_name", var.alias("node"), F.lit("Var").alias("node_type"), F.col("cell_id").alias("real_cell_id"), none.alias("display_type")).distinct())
        .unionByName(outputs.select("nb_name", out.alias("node"), F.lit("Display_data").alias("node_type"), F.col("cell_id").alias("real_cell_id"), F.col("data_type").alias("display_type")))
    )
    order = Window.partitionBy("nb_name").orderBy("cell_id")
    after = cells_.select("nb_name", cell.alias("src"), F.lead(cell).over(order).alias("dst")).where("dst is not null")
    contains = variables.select("nb_name", cell.alias("src"), var.alias("dst")).distinct()
    used = previous_definition(uses, variables).where("def_cell is not null").select("nb_name", F.concat_ws("_", F.col("def_cell").cast("string"), "var", "nb_name").alias("src"), cell.alias("dst")).distinct()
    shown = outputs.select("nb_name", cell.alias("src"), out.alias("dst"))
    edges = None
    for rel, df in (("Successor", after), ("Contains", contains), ("Usedby", used), ("Display", shown)):
        one = df.withColumn("rel", F.lit(rel))
        edges = one if edges is None else edges.unionByName(one)
    return nodes, edges


def inverse(edges: DataFrame) -> DataFrame:
    """The inverse relations, by swapping ends."""
    names = F.create_map(*(F.lit(x) for p in (("Successor", "Parent"), ("Contains", "Containedby"), ("Usedby", "Uses"), ("Display", "Displayedby")) for x in p))
    return edges.select("nb_name", F.col("dst").alias("src"), F.col("src").alias("dst"), names[F.col("rel")].alias("rel"))
