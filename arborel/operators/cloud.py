"""Operators on whole clouds: normalisation, outliers, covariance, sampling and tips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.geometry import dist2, xyz
from arborel.operators.numbering import numbered
from arborel.operators.spatial import knn_join
from arborel.scratch import discard, materialize


#: Halvings of the voxel size in one job.
LEVELS = 4
#: Points of a plant up to which farthest points are chosen in one task; beyond, points that a round picks from, and rounds between two tables of all picks.
KERNEL_POINTS, TOP, WRITE_EVERY = 65_536, 4096, 16


def normalize(points: DataFrame, length: float = 1.6) -> DataFrame:
    """points centred on their box and scaled so that the longest extent is `length`; adds cx, cy, cz, scale.

    A plant without extent keeps scale 1.
    """
    box = points.groupBy("plant_id").agg(*[((F.max(a) + F.min(a)) / 2).alias(f"c{a}") for a in "xyz"], F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("extent"))
    box = box.withColumn("scale", F.when(F.col("extent") > 0, F.lit(float(length)) / F.when(F.col("extent") > 0, F.col("extent"))).otherwise(1.0)).drop("extent")
    joined = points.join(box, "plant_id")
    return joined.withColumns({a: (F.col(a) - F.col(f"c{a}")) * F.col("scale") for a in "xyz"})


def unnormalize(points: DataFrame) -> DataFrame:
    """The inverse of normalize, by its columns."""
    back = points.withColumns({a: F.col(a) / F.col("scale") + F.col(f"c{a}") for a in "xyz"})
    return back.drop("cx", "cy", "cz", "scale")


def select_by_ids(points: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows of points in the order of picked(plant_id, pos, point_id), with pos."""
    return points.join(picked, ["plant_id", "point_id"])


def upper_outliers(df: DataFrame, value: str, by: list[str], sigmas: float = 3.0) -> DataFrame:
    """Rows whose value exceeds the group's mean by more than `sigmas` population standard deviations."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return df.join(stats, by).where(F.col(value) - F.col("_mean") > sigmas * F.col("_std")).drop("_mean", "_std")


def covariance(points: DataFrame) -> DataFrame:
    """Sample covariance of the coordinates of each plant: xx, yy, zz, xy, xz, yz."""
    cells = [F.covar_samp(a, b).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    return points.groupBy("plant_id").agg(*cells)


def lowest_point(points: DataFrame) -> DataFrame:
    """(plant_id, point_id, z) of the smallest z; ties go to the smaller id."""
    low = points.groupBy("plant_id").agg(F.min(F.struct("z", "point_id")).alias("low"))
    return low.select("plant_id", "low.point_id", "low.z")


def local_maxima(values: DataFrame, points: DataFrame, k: int = 30, near: DataFrame | None = None) -> DataFrame:
    """(plant_id, point_id) of points whose value exceeds those of all their k nearest neighbours; values(plant_id, point_id, value).

    near is a knn_join of the points with at least k neighbours, where one is at hand.
    """
    near = knn_join(points, points, k, exclude_self=True) if near is None else near.where(F.col("rank") <= k)
    theirs = values.select("plant_id", F.col("point_id").alias("nbr_id"), F.col("value").alias("their"))
    top = near.join(theirs, ["plant_id", "nbr_id"]).groupBy("plant_id", "point_id").agg(F.max("their").alias("top"))
    return values.join(top, ["plant_id", "point_id"]).where("value > top").select("plant_id", "point_id")


def tips(values: DataFrame, points: DataFrame, k: int = 30, near: DataFrame | None = None) -> DataFrame:
    """Local maxima of the distance from the lowest point, and the lowest point itself."""
    return local_maxima(values, points, k, near).unionByName(lowest_point(points).select("plant_id", "point_id")).distinct()


def tips_of_sample(values_of, points: DataFrame, n: int = 10_239, limit: int = 10_240, k: int = 30, least: int = 8, near_of=None) -> DataFrame:
    """Tips of plants above `limit` points, found on a down-sample that keeps the lowest point and mapped back to it.

    values_of(sample, near) gives the sample's (plant_id, point_id, value), near being a knn_join
    of the sample with at least `least` neighbours, or near_of(sample, k) where one is at hand. A
    tip is the smallest id of the points at its place.
    """
    near_of = near_of or (lambda p, k: knn_join(p, p, k, exclude_self=True))
    sizes = points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"))
    big = points.join(sizes.where(F.col("n") > limit).select("plant_id"), "plant_id", "left_semi")
    small = points.join(sizes.where(F.col("n") <= limit).select("plant_id"), "plant_id", "left_semi")
    low = big.join(lowest_point(big).select("plant_id", "point_id"), ["plant_id", "point_id"], "left_semi")
    rest = big.join(low, ["plant_id", "point_id"], "left_anti")
    sample = materialize(uniform_downsample(rest, n, near_of=near_of).unionByName(low).unionByName(small), "tip-sample")
    near = materialize(near_of(sample, max(k, least)), "tip-near", merged=True)
    found = materialize(tips(values_of(sample, near), sample, k, near), "tips")
    # a sample's points are points, so none is nearer than those at the same place
    place = ["plant_id", "x", "y", "z"]
    at = sample.join(found, ["plant_id", "point_id"], "left_semi").select(*place).distinct()
    return points.join(at, place).groupBy(*place).agg(F.min("point_id").alias("point_id")).select("plant_id", "point_id")


def fps_size(n: int, ratio: float) -> int:
    """round(ratio * n), halves away from zero."""
    return int(np.floor(ratio * n + 0.5))


def farthest_points(points: DataFrame, m: int | None = None, ratio: float | None = None) -> DataFrame:
    """(plant_id, pos, point_id, x, y, z): m points (or ratio of all) in the order of farthest-point sampling.

    The first is row 42 mod n by point_id; each next is farthest from those chosen, ties to
    the smaller id. m = n keeps the order of ids; n < m is an error. The choice is sequential:
    one task takes a plant of up to KERNEL_POINTS points, and larger ones advance in rounds that
    settle many picks each, with the same result.
    """
    sizes = materialize(points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")), "far-sizes")
    picked = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"])
    large = sizes.where(F.col("n") > KERNEL_POINTS)
    if large.isEmpty():
        return _far_in_one_task(picked, m, ratio)
    small = picked.join(large, "plant_id", "left_anti")
    return _far_in_rounds(picked.join(large, "plant_id"), m, ratio).unionByName(_far_in_one_task(small, m, ratio))


def _far_in_rounds(points: DataFrame, m: int | None, ratio: float | None) -> DataFrame:
    """farthest_points of points with n, their plant's number of points, above 42.

    A round settles many picks: of the TOP points that lie farthest from those chosen, a task
    goes on picking as long as the next lies no nearer than any point outside of them can,
    whose distances only fall. Then all points' distances take in the round's picks.
    """
    want = F.lit(m) if m is not None else F.floor(F.lit(ratio) * F.col("n") + 0.5)
    columns = ["plant_id", "pos", "point_id", "x", "y", "z"]
    points = materialize(points.withColumns({"want": want.cast("long"), "far": F.lit(float("inf"))}), "far-state")
    if points.where("want > n").limit(1).count():
        raise ValueError("a plant has fewer points than are wanted")
    whole = numbered(points.where("want = n"), [F.col("point_id")], "pos").select(*columns)
    state = points.where("want < n and want > 0")
    last = numbered(state, [F.col("point_id")], "pos").where("pos = 42").withColumn("pos", F.lit(0).cast("long")).select(*columns)
    last = materialize(last, "far-picked")
    found, tables = whole.unionByName(last), 0
    kind = dict(points.dtypes)["plant_id"]
    most = TOP

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["far", "point_id"], ascending=[False, True], kind="stable")
        ids, p, far = pdf["point_id"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float), pdf["far"].to_numpy(float).copy()
        # the best point outside: it and its like are picked next time
        edge = (far[most], ids[most]) if len(pdf) > most else (-np.inf, 0)
        far, order = far[:most], []
        p, left = p[:most], int(pdf["want"].iloc[0] - pdf["pos"].iloc[0] - 1)
        while len(order) < left:
            best = far.max()
            at = np.flatnonzero(far == best)
            at = int(at[ids[at].argmin()])
            if best < 0 or best < edge[0] or (best == edge[0] and ids[at] > edge[1]):
                break
            order.append(at)
            far = np.where(far < 0, far, np.minimum(far, ((p - p[at]) ** 2).sum(axis=1)))
            far[at] = -1.0
        out = pdf.iloc[order][["plant_id", "point_id", "x", "y", "z"]].copy()
        out.insert(1, "pos", int(pdf["pos"].iloc[0]) + 1 + np.arange(len(order)))
        return out

    while True:
        new = last.groupBy("plant_id").agg(F.collect_list(F.struct("point_id", "x", "y", "z")).alias("new"), F.max("pos").alias("pos"))
        away = F.array_min(F.transform("new", lambda s: dist2(xyz(), (s["x"], s["y"], s["z"]))))
        taken = F.exists("new", lambda s: s["point_id"] == F.col("point_id")) | (F.col("far") < 0)
        moved = state.drop("pos").join(new, "plant_id").where("pos + 1 < want").withColumn("far", F.when(taken, F.lit(-1.0)).otherwise(F.least("far", away)))
        before, state = state, materialize(moved.drop("new"), "far-state")
        discard(before)
        if state.isEmpty():
            return found
        rank = F.row_number().over(Window.partitionBy("plant_id").orderBy(F.col("far").desc(), "point_id"))
        top = state.withColumn("_rank", rank).where(F.col("_rank") <= most + 1).drop("_rank")
        last = top.groupBy("plant_id").applyInPandas(pick, f"plant_id {kind}, pos long, point_id long, x double, y double, z double")
        last = materialize(last, "far-picked")
        found, tables = found.unionByName(last), tables + 1
        if tables % WRITE_EVERY == 0:
            found = materialize(found, "far-found")


def _far_in_one_task(points: DataFrame, m: int | None, ratio: float | None) -> DataFrame:

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        n = len(pdf)
        want = m if m is not None else fps_size(n, ratio)
        if n < want:
            raise ValueError(f"plant {pdf.plant_id.iloc[0]} has {n} points, fewer than {want}")
        if n == want:
            order = np.arange(n)
        else:
            p = pdf[["x", "y", "z"]].to_numpy(float)
            order, far, at = np.empty(want, dtype=np.int64), np.full(n, np.inf), 42 % n
            for i in range(want):
                order[i] = at
                far = np.minimum(far, ((p - p[at]) ** 2).sum(axis=1))
                far[order[: i + 1]] = -1.0
                at = int(far.argmax())
        out = pdf.iloc[order][["plant_id", "point_id", "x", "y", "z"]].copy()
        out.insert(1, "pos", np.arange(want))
        return out

    kind = dict(points.dtypes)["plant_id"]
    return points.groupBy("plant_id").applyInPandas(pick, f"plant_id {kind}, pos long, point_id long, x double, y double, z double")


def uniform_downsample(points: DataFrame, n: int, tolerance: float = 0.05, max_rounds: int = 24, near_of=None) -> DataFrame:
    """Exactly n points of each plant, one per voxel of a size found by bisection, then trimmed.

    A voxel keeps the point nearest its points' mean. The size is narrowed until between n
    and (1 + tolerance) n points remain, or rounds run out; the surplus with the smallest
    spacing goes. Plants with n points are unchanged; fewer are an error. All plants advance
    together, and only open plants take part in a round. near_of(points, k) stands in for a knn_join.
    """
    sizes = points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("extent"))
    sizes = materialize(sizes, "down-sizes")
    if sizes.where(F.col("n") < n).limit(1).count():
        raise ValueError(f"a plant has fewer than {n} points")
    same = points.join(sizes.where(F.col("n") == n).select("plant_id"), "plant_id", "left_semi")
    state = sizes.where(F.col("n") > n).select("plant_id", F.lit(0.0).alias("low"), (F.col("extent") + 1e-12).alias("high"), F.lit(0.0).alias("best"))
    # a job counts all the sizes that LEVELS halvings may come to
    ends = 1 << LEVELS
    tried: dict = {0: F.col("low"), ends: F.col("high")}
    for width in (ends >> level for level in range(LEVELS)):
        tried |= {at + width // 2: (tried[at] + tried[at + width]) / 2 for at in range(0, ends, width)}
    for _ in range(max_rounds // LEVELS):
        step = state.withColumn("sizes", F.array(*[tried[i] for i in range(ends + 1)]))
        sizes_of = step.where("low < high").select("plant_id", F.explode(F.sequence(F.lit(1), F.lit(ends - 1))).alias("i"), "sizes").select("plant_id", "i", F.element_at("sizes", F.col("i") + 1).alias("size"))
        voxels = points.join(sizes_of, "plant_id").select("plant_id", "i", *[F.floor(F.col(a) / F.col("size")).alias(f"v{a}") for a in "xyz"]).distinct()
        counts = voxels.groupBy("plant_id", "i").agg(F.count(F.lit(1)).alias("kept")).groupBy("plant_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "kept"))).alias("kept"))
        step = step.join(counts, "plant_id", "left").withColumns({"a": F.lit(0), "b": F.when(F.col("kept").isNull(), 0).otherwise(ends), "m": F.lit(-1)})
        for _ in range(LEVELS):
            middle = ((F.col("a") + F.col("b")) / 2).cast("int")
            kept = F.coalesce(F.element_at("kept", middle), F.lit(0))
            enough, still = kept >= n, F.col("a") < F.col("b")
            step = step.withColumns({
                "a": F.when(still & enough, middle).otherwise(F.col("a")),
                "b": F.when(still & (~enough | (kept <= n * (1 + tolerance))), middle).otherwise(F.col("b")),
                "m": F.when(still & enough, middle).otherwise(F.col("m")),
            })
        size = lambda at: F.element_at("sizes", F.col(at) + 1)
        step = step.select("plant_id", *[F.when(F.col("kept").isNull(), F.col(c)).otherwise(size(at)).alias(c) for c, at in (("low", "a"), ("high", "b"))], F.when(F.col("m") >= 0, size("m")).otherwise(F.col("best")).alias("best"))
        state = materialize(step, "down-state")
        if state.where("low < high").limit(1).count() == 0:
            break
    chosen = points.join(state.select("plant_id", "best"), "plant_id")
    voxel = [F.when(F.col("best") > 0, F.floor(F.col(a) / F.when(F.col("best") > 0, F.col("best")))).otherwise(F.col("point_id")).alias(f"v{a}") for a in "xyz"]
    chosen = chosen.select("plant_id", "point_id", "x", "y", "z", *voxel)
    means = chosen.groupBy("plant_id", "vx", "vy", "vz").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    d2 = sum((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "xyz")
    best = chosen.join(means, ["plant_id", "vx", "vy", "vz"]).groupBy("plant_id", "vx", "vy", "vz").agg(F.min(F.struct(d2.alias("d2"), "point_id")).alias("b"))
    kept = materialize(points.join(best.select("plant_id", F.col("b.point_id").alias("point_id")), ["plant_id", "point_id"], "left_semi"), "down-kept")
    near = (knn_join(kept, kept, 1, exclude_self=True) if near_of is None else near_of(kept, 1)).select("plant_id", "point_id", "d2")
    final = numbered(kept.join(near, ["plant_id", "point_id"], "left"), [F.col("d2").desc_nulls_last(), F.col("point_id")], "_rank").where(F.col("_rank") < n)
    return final.select(*points.columns).unionByName(same)


def debug_sphere(sectors: int = 36, stacks: int = 18, radius: float = 1.0) -> DataFrame:
    """Vertices of a UV sphere: (stack, sector, x, y, z), (stacks + 1) * (sectors + 1) rows."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    grid = spark.range(stacks + 1).withColumnRenamed("id", "stack").select("stack", F.explode(F.sequence(F.lit(0), F.lit(sectors))).alias("sector"))
    grid = grid.withColumn("sector", F.col("sector").cast("long"))
    up, round_ = F.lit(np.pi / 2) - F.col("stack") * F.lit(np.pi / stacks), F.col("sector") * F.lit(2 * np.pi / sectors)
    return grid.select("stack", "sector", (radius * F.cos(up) * F.cos(round_)).alias("x"), (radius * F.cos(up) * F.sin(round_)).alias("y"), (radius * F.sin(up)).alias("z"))


def finite(points: DataFrame) -> DataFrame:
    from arborel.functions.geometry import is_finite

    return points.where(is_finite(xyz()))
