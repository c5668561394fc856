"""Folders of clouds and results: batch scans, pairs of prediction and truth, latest iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_files(files: DataFrame, folder: str, extension: str) -> DataFrame:
    """Of files(path), those directly in folder whose extension is exactly the given one, with plant_id."""
    inside = F.regexp_extract("path", r"^(.*)/[^/]*$", 1) == folder.rstrip("/")
    own = F.regexp_extract("path", r"(\.[^./]*)$", 1) == extension
    return files.where(inside & own).withColumn("plant_id", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))


def collect_evaluation(files: DataFrame) -> DataFrame:
    """(plant_id, role, path) of *_Result.ply and *_Input.ply anywhere; the plant is the file's folder."""
    role = F.regexp_extract("path", r"_(Result|Input)\.ply$", 1)
    return files.withColumn("role", role).where("role <> ''").select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("plant_id"), "role", "path")


def pair_results(files: DataFrame) -> DataFrame:
    """(plant_id, result, input) of every *_Result.ply; one without its *_Input.ply is an error."""
    name = F.regexp_extract("path", r"([^/]*)_(Result|Input)\.ply$", 1)
    role = F.regexp_extract("path", r"_(Result|Input)\.ply$", 1)
    named = files.select(name.alias("plant_id"), role.alias("role"), "path").where("role <> ''")
    one = named.groupBy("plant_id").agg(F.max(F.when(F.col("role") == "Result", F.col("path"))).alias("result"), F.max(F.when(F.col("role") == "Input", F.col("path"))).alias("input"))
    found = one.where("result is not null")
    return found.withColumn("input", F.when(F.col("input").isNull(), F.raise_error(F.concat(F.lit("no input file for "), F.col("plant_id")))).otherwise(F.col("input")))


def iteration_of(path: Column) -> Column:
    """The number of a snapshot cpts_<n>.ply; null for other names."""
    return F.regexp_extract(path, r"(?:^|/)cpts_(\d+)\.ply$", 1).try_cast("long")


def latest_iteration(files: DataFrame, by: str = "plant_id") -> DataFrame:
    """(by, iter, path) of each group's snapshot with the largest number."""
    numbered = files.withColumn("iter", iteration_of(F.col("path"))).where("iter is not null")
    return numbered.groupBy(by).agg(F.max("iter").alias("iter"), F.max_by("path", "iter").alias("path"))


def unique_result(files: DataFrame, by: str = "plant_id") -> DataFrame:
    """(by, path) of the only *_Result.ply of each group; none or several are an error."""
    counted = files.groupBy(by).agg(F.count_if(F.col("path").rlike(r"_Result\.ply$")).alias("n"), F.max(F.when(F.col("path").rlike(r"_Result\.ply$"), F.col("path"))).alias("path"))
    return counted.select(by, F.when(F.col("n") != 1, F.raise_error(F.concat(F.lit("not exactly one result in "), F.col(by).cast("string")))).otherwise(F.col("path")).alias("path"))
