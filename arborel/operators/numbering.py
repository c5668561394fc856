"""Row numbers within plants without one task for a plant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.scratch import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, ... in the order of each plant_id's rows, which should tell all rows apart.

    Rows are dealt out by ranges of plant and order; every range is numbered by itself and
    moved on by the counts of the plant's ranges before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(df.repartitionByRange(parts, F.col("plant_id"), *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy("plant_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("plant_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sums.select("plant_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inner = F.row_number().over(Window.partitionBy("plant_id", "_part").orderBy(*order))
    return spread.withColumn("_row", inner).join(ahead, ["plant_id", "_part"]).withColumn(name, (F.col("_row") + F.col("_ahead") - 1).cast("long")).drop("_part", "_row", "_ahead")
