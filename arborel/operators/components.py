"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.scratch import discard, materialize


def _is_forest_of_stars(edges: DataFrame, by: list[str]) -> bool:
    """True when every child has one parent and no parent is itself a child."""
    ends = edges.select(*by, F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(*by, F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    sums = ends.groupBy(*by, "node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return sums.where("child > 1 or (child = 1 and parent = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, by: list[str] | None = None, merged: bool = False) -> DataFrame:
    """(*by, id, component) for every vertex that has an edge; component is the smallest id reachable.

    by names columns, such as a plant's, within which ids are counted apart. Self loops and
    nulls are ignored; repeated and reversed edges count once; an empty edge table gives an
    empty result. Each round is two grouped minima joined back to the edges, so a hub's
    neighbours never meet in one place: the minima are pre-aggregated and the joins can be
    split by adaptive execution. Rounds end when the edges form stars. merged keeps the rounds'
    tables from the driver (see materialize).
    """
    by = by or []
    step = materialize(
        edges.where(F.col(src) != F.col(dst))
        .select(*by, F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v"))
        .distinct(),
        "components",
        merged=merged,
    )
    for _ in range(max_rounds):
        if _is_forest_of_stars(step, by):
            break
        both = step.unionByName(step.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*by, "u", F.least("u", "m").alias("m"))
        # dealt out again, so that the join meets two plain exchanges, of which Spark can split a hub's
        low = low.repartition(*by, "u")
        low = low.hint("merge") if merged else low
        large = both.where("v > u").join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "components", merged=merged)
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        before, step = step, materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "components", merged=merged)
        discard(before, large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    children = step.select(*by, F.col("u").alias("id"), F.col("v").alias("component"))
    return children.unionByName(step.select(*by, F.col("v").alias("id"), F.col("v").alias("component")).distinct())
