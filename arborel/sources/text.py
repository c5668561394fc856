"""XYZ and TXT clouds: lines of numbers parted by single or repeated delimiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborel.scratch import materialize


def parse_line(line: Column, dims: int, delimiter: str = " ") -> Column:
    """The first `dims` numbers of a line as an array of doubles.

    Repeated delimiters count as one and further columns are ignored; a tab is no delimiter.
    Too few columns, and words that are no numbers, are errors.
    """
    if not 1 <= dims <= 12:
        raise ValueError("between 1 and 12 columns")
    words = F.filter(F.split(F.regexp_replace(line, "\r$", ""), F.lit("\\Q" + delimiter + "\\E")), lambda w: w != "")
    numbers = F.transform(F.slice(words, 1, dims), lambda w: w.try_cast("double"))
    bad = (F.size(numbers) < dims) | F.exists(numbers, lambda n: n.isNull())
    return F.when(bad, F.raise_error(F.concat(F.lit("line without its numbers: "), line)).cast("array<double>")).otherwise(numbers)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(plant_id, line, value) with line numbers from 0, of one scan over all files of path.

    Spark cuts large files at line ends. A block of a file is read in order by one task, so
    that a row's place in it is the distance from the block's first row; the rows of the blocks
    before, counted first, are added. Rows are not shuffled.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    window = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("n").over(window), F.lit(0)) - F.col("first")).alias("shift"))
    plant = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return rows.join(materialize(blocks, "text-blocks"), ["file", "start"]).select(plant.alias("plant_id"), (F.col("at") + F.col("shift")).alias("line"), "value")


def read_cloud(spark: SparkSession, path: str | list[str], dims: int = 3, delimiter: str = " ") -> DataFrame:
    """(plant_id, point_id, x, y, z) of text clouds; point_id is the line number."""
    rows = _lines(spark, path).withColumn("v", parse_line(F.col("value"), max(3, dims), delimiter))
    return rows.select("plant_id", F.col("line").cast("long").alias("point_id"), *[F.col("v")[i].alias(a) for i, a in enumerate("xyz")])


def read_labelled_cloud(spark: SparkSession, path: str | list[str], dims: int, semantic_column: int, instance_column: int, delimiter: str = " ") -> DataFrame:
    """A text cloud with two label columns, by 0-based index; values are cut to integers."""
    if not (0 <= semantic_column < dims and 0 <= instance_column < dims):
        raise ValueError("label columns must be among the columns")
    rows = _lines(spark, path).withColumn("v", parse_line(F.col("value"), dims, delimiter))
    labels = [F.col("v")[i].cast("int").alias(n) for i, n in ((semantic_column, "semantic"), (instance_column, "instance"))]
    return rows.select("plant_id", F.col("line").cast("long").alias("point_id"), *[F.col("v")[i].alias(a) for i, a in enumerate("xyz")], *labels)


def read_labels(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(plant_id, point_id, name): one integer a line."""
    rows = _lines(spark, path).withColumn("v", parse_line(F.col("value"), 1))
    return rows.select("plant_id", F.col("line").cast("long").alias("point_id"), F.col("v")[0].cast("int").alias(name))


def with_labels(points: DataFrame, semantic: DataFrame, instance: DataFrame) -> DataFrame:
    """points with labels joined by place; a plant whose counts differ is an error."""
    n = lambda df, c: df.groupBy("plant_id").agg(F.count(F.lit(1)).alias(c))
    counts = n(points, "p").join(n(semantic, "s"), "plant_id", "full").join(n(instance, "i"), "plant_id", "full")
    equal = F.coalesce((F.col("p") == F.col("s")) & (F.col("p") == F.col("i")), F.lit(False))
    checked = counts.select("plant_id", F.when(equal, 0).otherwise(F.raise_error(F.concat(F.lit("labels do not match points of "), F.col("plant_id"))).cast("int")).alias("ok"))
    out = points.join(semantic, ["plant_id", "point_id"]).join(instance, ["plant_id", "point_id"])
    return out.join(checked, "plant_id").where("ok = 0").drop("ok")


def load_cloud(spark: SparkSession, path: str) -> DataFrame:
    """A cloud by its suffix: .ply, .xyz or .txt; others are an error."""
    from arborel.sources import ply

    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "ply":
        return ply.read_cloud(spark, path)
    if suffix in ("xyz", "txt"):
        return read_cloud(spark, path)
    raise ValueError(f"unknown point cloud format: {path}")
