"""Written tables in the folder that the driver and all executors share.

Iterative operators cut their lineage with a table written here instead of a local
checkpoint, so a lost executor costs a re-read and never the whole history.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary one only where none is set and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborel-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/arborel/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str, free_shuffles: bool = False, merged: bool = False) -> DataFrame:
    """Write df once and return a scan of what was written.

    merged is for tables that grow with the points: joins with them are merge joins, so that
    neither side goes to all executors by way of the driver while it is below a threshold.
    free_shuffles lets Spark's cleaner drop the shuffle files of the finished step now
    rather than at the driver's next collection; it matters for steps that move whole texts.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    if free_shuffles:
        del df
        for _ in range(2):  # the first round finds what Python held, the second what that referred to
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
    out = spark.read.schema(schema).parquet(path)
    out = out.hint("merge") if merged else out
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that a loop has finished with; what was derived from them must be written by now."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
