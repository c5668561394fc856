"""Clouds that arrive in a folder, as a stream of files.

Each micro-batch holds whole files, so a plant is processed once, when its file has come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from arborel.sources.ply import read_element, stem


def stream_clouds(spark: SparkSession, folder: str, pattern: str = "*.ply") -> DataFrame:
    """(plant_id, point_id, x, y, z) of PLY files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)

    def parse(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = read_element(raw, "vertex")
                n = len(columns["x"])
                coordinates = [pa.array(np.asarray(columns[a], dtype=np.float32).astype(np.float64)) for a in "xyz"]
                yield pa.RecordBatch.from_arrays([pa.array([stem(path)] * n, pa.string()), pa.array(np.arange(n)), *coordinates], ["plant_id", "point_id", "x", "y", "z"])

    return files.select("path", "content").mapInArrow(parse, "plant_id string, point_id long, x double, y double, z double")


def process(spark: SparkSession, folder: str, checkpoint: str, handle, pattern: str = "*.ply") -> StreamingQuery:
    """Call handle(points, batch number) for every batch of new files, each file once across restarts."""
    clouds = stream_clouds(spark, folder, pattern)
    return clouds.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
