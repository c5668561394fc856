"""Down-sampling by spacing: no two kept points are near each other, and every other point is near a kept one.

At a spacing, points are gone through in a fixed mixed order and kept unless a kept point is
nearer. On Spark that is a maximal independent set by rounds: a point with no open neighbour
earlier in the order is kept and its neighbours go; rounds grow with the logarithm of the
points, as the order is a hash. Stretches of the order are settled one after the other, so that
pairs grow with the points and not with their square. The spacing is doubled and halved towards the number wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.operators.numbering import numbered
from arborel.operators.spatial import knn_join, radius_join
from arborel.scratch import discard, materialize

#: Points of a plant up to which its spacing is found in one task.
KERNEL = 2048
#: Spacings tried at most, and the share of a spacing, or of the first one, below which the search ends.
ROUNDS, FINE = 40, 1 / 1024
#: Places in the mixed order; the points of a plant's first stretch of them and how many times longer the stretches grow.
TURNS, FIRST, WIDER = 1 << 32, 4096, 4
#: Points of a plant's stretch up to which one task settles it.
STRETCH = 8192


def turn(point_id: Column) -> Column:
    """A point's place in the mixed order: 32 bits of a hash of its id; equal ones go by id."""
    return F.conv(F.substring(F.md5(point_id.cast("long").cast("string")), 1, 8), 16, 10).cast("long")


def _picked(points: DataFrame) -> DataFrame:
    return points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"])


def spaced_points(points: DataFrame, spacing: float | DataFrame, most: int | None = None, first: int | None = None) -> DataFrame:
    """(plant_id, point_id) of the points kept at a spacing above 0, or at each plant's of (plant_id, radius).

    No two kept points are nearer than the spacing, and each other point is nearer than it to
    a kept one that comes earlier in the order. The order is gone through in stretches, the
    first of some `first` points of a plant (FIRST), each WIDER times as long as all before: a stretch's
    points that are near a kept one go before pairs are listed, which leaves few neighbours to each
    of the rest whatever the spacing. Plants are left, and then unfinished, once more than `most`
    of their points are kept. No task holds a plant.
    """
    points = _picked(points)
    reach = spacing if isinstance(spacing, DataFrame) else points.select("plant_id").distinct().withColumn("radius", F.lit(float(spacing)))
    reach = materialize(reach.select("plant_id", F.col("radius").cast("double")), "spaced-reach")
    points = points.join(reach.select("plant_id"), "plant_id", "left_semi").withColumn("turn", turn(F.col("point_id")))
    points = materialize(points, "spaced-turned")
    largest = points.groupBy("plant_id").count().agg(F.max("count")).first()[0] or 0
    kept, low, share = None, 0, min(1.0, (first or FIRST) / max(1, largest))
    while True:
        high = TURNS if share >= 1 else int(share * TURNS)
        some = points.where((F.col("turn") >= low) & (F.col("turn") < high))
        if kept is not None:
            if most is not None:
                full = kept.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("plant_id")
                some = some.join(F.broadcast(materialize(full, "spaced-full")), "plant_id", "left_anti")
            near = radius_join(some, kept, reach).join(reach, "plant_id").where("d2 < radius * radius").select("plant_id", "point_id").distinct()
            some = some.join(near, ["plant_id", "point_id"], "left_anti")
        some = materialize(some, "spaced-stretch")
        new = materialize(_settled(some, reach), "spaced-new")
        kept = new if kept is None else kept.unionByName(new)
        if share >= 1:
            return kept.select("plant_id", "point_id")
        low, share = high, min(1.0, WIDER * share)


def _settled(points: DataFrame, reach: DataFrame) -> DataFrame:
    """The points of a stretch that are kept: in their order where plants have up to STRETCH points there, else in rounds."""
    if (points.groupBy("plant_id").count().agg(F.max("count")).first()[0] or 0) > STRETCH:
        return _in_rounds(points, reach)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "point_id"], kind="stable")
        p, radius = pdf[list("xyz")].to_numpy(float), float(pdf["radius"].iloc[0])
        free, kept = np.ones(len(p), dtype=bool), []
        for i in range(len(p)):
            if free[i]:
                kept.append(i)
                gap = p[i:] - p[i]
                free[i:] &= (gap[:, 0] ** 2 + gap[:, 1] ** 2) + gap[:, 2] ** 2 >= radius * radius
        return pdf.iloc[kept].drop(columns="radius")

    return points.join(reach, "plant_id").groupBy("plant_id").applyInPandas(greedy, points.schema)


def _in_rounds(points: DataFrame, reach: DataFrame) -> DataFrame:
    """A point with no open neighbour earlier in the order is kept, and its neighbours go."""
    near = radius_join(points, points, reach).join(reach, "plant_id").where("d2 < radius * radius")
    mine, other = F.struct(turn(F.col("point_id")), "point_id"), F.struct(turn(F.col("nbr_id")), "nbr_id")
    open_ = materialize(near.where(mine < other).select("plant_id", F.col("point_id").alias("first"), F.col("nbr_id").alias("after")), "spaced-pairs")
    gone = None
    while not open_.isEmpty():
        held_up = open_.select("plant_id", F.col("after").alias("first")).distinct()
        sure = open_.join(held_up, ["plant_id", "first"], "left_anti")
        drop = materialize(sure.select("plant_id", F.col("after").alias("point_id")).distinct(), "spaced-gone")
        gone = drop if gone is None else gone.unionByName(drop)
        left = open_
        for end in ("first", "after"):
            left = left.join(drop.withColumnRenamed("point_id", end), ["plant_id", end], "left_anti")
        before, open_ = open_, materialize(left.select("plant_id", "first", "after"), "spaced-pairs")
        discard(before)
    return points if gone is None else points.join(gone, ["plant_id", "point_id"], "left_anti")


def _kept(d2: np.ndarray, spacing: float) -> np.ndarray:
    """Whether each point, in its order, is kept."""
    near = d2 < spacing * spacing
    kept = np.zeros(len(d2), dtype=bool)
    free = np.ones(len(d2), dtype=bool)
    for i in range(len(d2)):
        if free[i]:
            kept[i] = True
            free &= ~near[i]
    return kept


def _small(points: DataFrame, starts: DataFrame, n: int, tolerance: float) -> DataFrame:
    """(plant_id, point_id) kept at the widest spacing tried that keeps enough, plant by plant; all points where none does."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "point_id"], kind="stable")
        p = pdf[list("xyz")].to_numpy(float)
        d2 = np.zeros((len(p), len(p)))
        for axis in range(3):
            gap = p[:, None, axis] - p[None, :, axis]
            d2 += gap * gap
        low, high, at, best = 0.0, None, float(pdf["start"].iloc[0]), np.ones(len(p), dtype=bool)
        for _ in range(ROUNDS):
            kept = _kept(d2, at)
            found = int(kept.sum())
            low, high, best = (at, high, kept) if found >= n else (low, at, best)
            if n <= found <= n * (1 + tolerance) or (high is not None and (high - low <= FINE * high or high <= FINE * float(pdf["start"].iloc[0]))):
                break
            at = 2 * at if high is None else (low + high) / 2
        return pdf.loc[best, ["plant_id", "point_id"]]

    kind = dict(points.dtypes)["plant_id"]
    given = points.join(starts, "plant_id").withColumn("turn", turn(F.col("point_id")))
    return given.groupBy("plant_id").applyInPandas(search, f"plant_id {kind}, point_id long")


def _large(points: DataFrame, starts: DataFrame, n: int, tolerance: float) -> DataFrame:
    """_small for plants of any size: all of them try a spacing each in a round."""
    state = starts.select("plant_id", "start", F.lit(0.0).alias("low"), F.lit(None).cast("double").alias("high"), F.col("start").alias("at"), F.lit(False).alias("done"))
    state = materialize(state, "spacing")
    limit = int(n * (1 + tolerance))  # more than that only says that the spacing is too narrow
    for _ in range(ROUNDS):
        tried = state.where("not done").select("plant_id", F.col("at").alias("radius"))
        if tried.isEmpty():
            break
        found = spaced_points(points, tried, limit).groupBy("plant_id").agg(F.count(F.lit(1)).alias("found"))
        step = state.join(found, "plant_id", "left")
        enough = F.col("found") >= n
        step = step.select(
            "plant_id", "start", "found", "done", "at",
            F.when(enough, F.col("at")).otherwise(F.col("low")).alias("low"), F.when(F.col("found") < n, F.col("at")).otherwise(F.col("high")).alias("high"),
        )
        fine = F.coalesce((F.col("high") - F.col("low") <= FINE * F.col("high")) | (F.col("high") <= FINE * F.col("start")), F.lit(False))
        done = F.col("done") | fine | F.coalesce((F.col("found") >= n) & (F.col("found") <= n * (1 + tolerance)), F.lit(False))
        at = F.when(F.col("high").isNull(), 2 * F.col("at")).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialize(step.select("plant_id", "start", "low", "high", at.alias("at"), done.alias("done")), "spacing")
    kept = spaced_points(points, state.where("low > 0").select("plant_id", F.col("low").alias("radius")))
    return kept.unionByName(points.join(state.where("low = 0"), "plant_id", "left_semi").select("plant_id", "point_id"))


def spaced_downsample(points: DataFrame, n: int, tolerance: float = 0.05, kernel: int | None = None) -> DataFrame:
    """Exactly n points of each plant, as far apart as a common spacing keeps them.

    The spacing starts near the mean distance to the nearest point, doubles while more than
    n points stay and is halved in from then on, until n to (1 + tolerance) n stay or the
    halves are finer than FINE. Of the points kept at the widest spacing that keeps n, those with the nearest
    neighbours go, larger ids first among equals. Equal points are kept only where there are
    fewer than n places. Plants with n points are unchanged; fewer are an error. Plants up to
    `kernel` points (KERNEL) are a task each.
    """
    sizes = materialize(points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")), "spaced-sizes")
    if sizes.where(F.col("n") < n).limit(1).count():
        raise ValueError(f"a plant has fewer than {n} points")
    more = sizes.where(F.col("n") > n)
    at = materialize(_picked(points).join(more.select("plant_id"), "plant_id", "left_semi"), "spaced-points")
    # a power of two, with the borders between them off those that regular clouds fall on
    mean = knn_join(at, at, 1, exclude_self=True).groupBy("plant_id").agg(F.avg(F.sqrt("d2")).alias("mean"))
    start = F.when(F.col("mean") > 0, F.pow(F.lit(2.0), F.floor(F.log2(F.lit(1.17) * F.col("mean"))))).otherwise(1.0)
    starts = materialize(mean.join(more, "plant_id").select("plant_id", start.alias("start"), "n"), "spaced-starts")
    limit = KERNEL if kernel is None else kernel
    few, many = (starts.where(test).select("plant_id", "start") for test in (F.col("n") <= limit, F.col("n") > limit))
    kept = _small(at, few, n, tolerance)
    if not many.isEmpty():
        kept = kept.unionByName(_large(at.join(many.select("plant_id"), "plant_id", "left_semi"), many, n, tolerance))
    kept = materialize(at.join(kept, ["plant_id", "point_id"], "left_semi"), "spaced-kept")
    near = knn_join(kept, kept, 1, exclude_self=True).select("plant_id", "point_id", "d2")
    ranked = numbered(kept.join(near, ["plant_id", "point_id"], "left").select("plant_id", "point_id", "d2"), [F.col("d2").desc_nulls_last(), F.col("point_id")], "place")
    ids = ranked.where(F.col("place") < n).select("plant_id", "point_id")
    same = sizes.where(F.col("n") == n).select("plant_id")
    return points.join(ids, ["plant_id", "point_id"], "left_semi").unionByName(points.join(same, "plant_id", "left_semi"))
