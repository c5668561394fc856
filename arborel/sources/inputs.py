"""Clouds as a configuration names them: one file or a folder, with or without labels; and output folders."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.config import Config
from arborel.sources import ply, text


def _status(spark: SparkSession, path: str):
    """Hadoop's status of a path, or None: the path may be in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs, fs.getFileStatus(at)) if fs.exists(at) else None


def input_files(spark: SparkSession, config: Config) -> list[str]:
    """The configured file, or the files directly in the configured folder whose extension is exactly the configured one."""
    found = _status(spark, config.input)
    if found is None:
        raise ValueError(f"no input at {config.input!r}")
    fs, status = found
    if not status.isDirectory():
        if not config.input.lower().endswith((".ply", ".xyz", ".txt")):
            raise ValueError(f"unknown point cloud format: {config.input}")
        return [config.input]
    inside = [s.getPath().toString() for s in fs.listStatus(status.getPath()) if s.isFile()]
    inside = sorted(p for p in inside if p.endswith(config.extension))
    if not inside:
        raise ValueError(f"no {config.extension} file in {config.input!r}")
    return inside


def _named_labels(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """A PLY file whose vertices carry the configured label properties."""
    rows = ply.read_vertices(spark, path)
    missing = [n for n in (config.semantic_name, config.instance_name) if n not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no vertex property {' and no '.join(missing)}")
    labels = [F.col(f"`{name}`").cast("int").alias(to) for name, to in ((config.semantic_name, "semantic"), (config.instance_name, "instance"))]
    return rows.select("plant_id", "point_id", *[F.col(a).cast("float").cast("double").alias(a) for a in "xyz"], *labels)


def _label_file(spark: SparkSession, path: str, name: str, plants: DataFrame) -> DataFrame:
    """A label file's rows under the plant of the one cloud that it belongs to."""
    return text.read_labels(spark, path, name).drop("plant_id").crossJoin(plants)


def load(spark: SparkSession, config: Config) -> DataFrame:
    """(plant_id, point_id, x, y, z[, semantic, instance]) of all configured clouds.

    With labels, they come from the two label files where those are given (one cloud only),
    else from named properties of PLY files or from columns of text files. Labels that do not
    match the points in number are an error.
    """
    paths = input_files(spark, config.validate())
    folder = paths != [config.input]
    together = f"{config.input.rstrip('/')}/*{config.extension}" if folder else config.input  # one scan
    is_ply = paths[0].lower().endswith(".ply")
    if not config.with_labels:
        return ply.read_cloud(spark, together) if is_ply else text.read_cloud(spark, together)
    if config.semantic_file:
        if len(paths) != 1:
            raise ValueError("separate label files belong to one cloud")
        points = text.load_cloud(spark, paths[0])
        plants = points.select("plant_id").distinct()  # one row: the one file's name
        return text.with_labels(points, _label_file(spark, config.semantic_file, "semantic", plants), _label_file(spark, config.instance_file, "instance", plants))
    columns = config.total_columns, config.semantic_column, config.instance_column
    return _named_labels(spark, together, config) if is_ply else text.read_labelled_cloud(spark, together, *columns)


def prepare_folder(spark: SparkSession, folder: str, mode: str = "errorifexists") -> str:
    """The folder, made if need be. errorifexists: one that holds anything is an error; overwrite: files of the same names are replaced, others stay."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"mode must be errorifexists or overwrite, not {mode!r}")
    found = _status(spark, folder)
    if found and mode == "errorifexists" and len(found[0].listStatus(found[1].getPath())):
        raise ValueError(f"{folder} is not empty")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return folder


def fingerprint(spark: SparkSession, config: Config) -> str:
    """Name, length and time of change of every configured file, labels included, as one digest."""
    files = input_files(spark, config) + ([config.semantic_file, config.instance_file] if config.with_labels and config.semantic_file else [])
    said = []
    for path in files:
        found = _status(spark, path)
        if found is None:
            raise ValueError(f"no file at {path!r}")
        said.append([path, found[1].getLen(), found[1].getModificationTime()])
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file from any store that Spark reads; None where there is none."""
    found = _status(spark, path)
    if found is None:
        return None
    opened = found[0].open(found[1].getPath())
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def write_text(spark: SparkSession, path: str, content: str) -> str:
    """One small text file, such as a configuration, in any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return path
