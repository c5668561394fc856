"""Neighbourhood joins of point tables (plant_id, point_id, x, y, z).

A radius join buckets both sides by a grid of the radius and joins equal cells, with one side
copied to the 27 cells around it. A nearest-neighbour join uses a k-d partition: a query's own
cell bounds its k-th distance, and it is compared with the cells whose boxes lie within that.
Plants up to BRUTE points are compared in full instead; sizes are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.geometry import dist2, xyz
from arborel.operators.cells import Cells, corner_d2
from arborel.scratch import materialize

#: Points of a plant, or pairs of its queries and points, up to which every pair is compared.
BRUTE, BRUTE_PAIRS = 1024, 1 << 22


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


def _around(df: DataFrame, prefix: str, size: Column) -> DataFrame:
    """df repeated for the 27 cells around each point."""
    for axis in "xyz":
        own = _cell(F.col(f"{prefix}{axis}"), size)
        df = df.withColumn(f"c{axis}", F.explode(F.array(own - 1, own, own + 1)))
    return df


def _named(df: DataFrame, prefix: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return df.select("plant_id", F.col("point_id").alias(f"{prefix}id"), *[F.col(a).cast("double").alias(f"{prefix}{a}") for a in "xyz"], *[F.col(c).alias(f"{prefix}{c}") for c in carry])


def radius_pairs(queries: DataFrame, points: DataFrame, radius: float | DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """radius_join with the coordinates p_x .. p_z of the query and n_x .. n_z of the neighbour, and its columns of carry as n_<name>.

    Pairs meet in as many partitions as a shuffle has: a cell's worth of work is far more than its bytes.
    """
    q, p = _named(queries, "q_"), _named(points, "p_", carry)
    if isinstance(radius, DataFrame):
        sizes = radius.select("plant_id", F.col("radius").cast("double").alias("reach"))
        q, p = q.join(sizes, "plant_id"), p.join(sizes.withColumnRenamed("reach", "_reach"), "plant_id")
    else:
        q, p = q.withColumn("reach", F.lit(float(radius))), p.withColumn("_reach", F.lit(float(radius)))
    q = _around(q, "q_", F.col("reach"))
    for axis in "xyz":
        p = p.withColumn(f"c{axis}", _cell(F.col(f"p_{axis}"), F.col("_reach")))
    d2 = dist2(xyz("q_"), xyz("p_"))
    cell = ["plant_id", "cx", "cy", "cz"]
    q = q.repartition(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    near = q.join(p, cell).where(d2 <= F.col("reach") * F.col("reach"))
    at = [F.col(f"{old}_{a}").alias(f"{new}_{a}") for old, new in (("q", "p"), ("p", "n")) for a in "xyz"] + [F.col(f"p_{c}").alias(f"n_{c}") for c in carry]
    return near.select("plant_id", F.col("q_id").alias("point_id"), F.col("p_id").alias("nbr_id"), d2.alias("d2"), *at)


def radius_join(queries: DataFrame, points: DataFrame, radius: float | DataFrame) -> DataFrame:
    """(plant_id, point_id, nbr_id, d2) of the points within radius (inclusive) of each query; a point finds itself.

    radius may be a table (plant_id, radius) with a radius above 0 for each plant.
    """
    return radius_pairs(queries, points, radius).select("plant_id", "point_id", "nbr_id", "d2")


def radius_links(points: DataFrame, radius: float) -> DataFrame:
    """(plant_id, src, dst), src < dst: links that join what the pairs within radius would; not all are such pairs.

    Points of a cell whose diagonal is below the radius are linked to its smallest id, and those
    of two cells that have a pair to each other, so links grow with the points.
    """
    named = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"])
    # a diagonal of 0.87 radii, past any rounding
    cells = lambda prefix: [_cell(F.col(f"{prefix}{a}"), F.lit(radius / 2)).alias(f"i{a}") for a in "xyz"]
    cell = ["plant_id", "ix", "iy", "iz"]
    first = named.groupBy("plant_id", *cells("")).agg(F.min("point_id").alias("first"))
    held = named.select("*", *cells("")).join(first, cell).select("plant_id", "point_id", "x", "y", "z", "first")
    inner = held.where("first <> point_id").select("plant_id", F.col("first").alias("src"), F.col("point_id").alias("dst"))
    met = radius_pairs(named, held, radius, ("first",)).select("plant_id", *cells("p_"), "n_first").distinct()
    between = met.join(first, cell).where("first < n_first").select("plant_id", F.col("first").alias("src"), F.col("n_first").alias("dst"))
    return inner.unionByName(between)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("plant_id", "q_id").orderBy("d2", "p_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _full(q: DataFrame, p: DataFrame, k: int, other: Column) -> DataFrame:
    """The k nearest of q in plants of p whose pairs are all compared."""
    d2 = dist2(xyz("q_"), xyz("p_")).alias("d2")
    return _top(q.join(p, "plant_id").where(other).select("plant_id", "q_id", "p_id", d2), k)


def _by_cells(q: DataFrame, p: DataFrame, k: int, other: Column) -> DataFrame:
    """The k nearest of q by a k-d partition of p: the own cell bounds the k-th distance, then all cells within it are compared."""
    # of equal points none but the k + 1 smallest ids can be among k neighbours
    rank = F.row_number().over(Window.partitionBy("plant_id", "p_x", "p_y", "p_z").orderBy("p_id"))
    first = p.withColumn("_same", rank).where(F.col("_same") <= k + 1)
    cells = Cells(first.select("plant_id", F.col("p_id").alias("point_id"), *[F.col(f"p_{a}").alias(a) for a in "xyz"]), max(8, 2 * (k + 1)))
    held = cells.filed.select("plant_id", "node", F.col("point_id").alias("p_id"), *[F.col(a).alias(f"p_{a}") for a in "xyz"])
    placed = cells.place(q.select("plant_id", "q_id", *[F.col(f"q_{a}").alias(a) for a in "xyz"]))
    placed = materialize(placed.select("plant_id", "q_id", "node", *[F.col(a).alias(f"q_{a}") for a in "xyz"]), "knn-placed", merged=True)
    d2 = dist2(xyz("q_"), xyz("p_"))
    own = placed.join(held, ["plant_id", "node"]).where(other).groupBy("plant_id", "q_id").agg(F.sort_array(F.collect_list(d2)).alias("own"))
    kth = F.when(F.size("own") >= k, F.get("own", F.lit(k - 1)))
    far = placed.join(cells.around(k + 1), ["plant_id", "node"], "left").join(own, ["plant_id", "q_id"], "left")
    bound = F.least(F.coalesce(kth, F.lit(float("inf"))), F.coalesce(corner_d2("q_"), F.lit(float("inf"))))
    # few bytes that much work follows from: the number of partitions is held
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks = far.select("plant_id", "q_id", "q_x", "q_y", "q_z", bound.alias("bound")).repartition(parts, "q_id")
    near = cells.visits(asks).repartition(parts, "plant_id", "node").join(held, ["plant_id", "node"]).where(other & (d2 <= F.col("bound")))
    return _top(near.select("plant_id", "q_id", "p_id", d2.alias("d2")), k)


def knn_join(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, brute: int | None = None) -> DataFrame:
    """(plant_id, point_id, nbr_id, d2, rank) of the k nearest points of each query in its plant; ties go to the smaller id.

    exclude_self leaves out the point with the query's id. Queries of plants with fewer
    points get all of them. Plants up to `brute` points (by default of up to BRUTE points or
    BRUTE_PAIRS pairs) are compared in full, larger ones by cells. Points without finite coordinates should be filtered first.
    """
    limit = BRUTE if brute is None else brute
    q, p = _named(queries, "q_"), _named(points, "p_")
    other = (F.col("q_id") != F.col("p_id")) if exclude_self else F.lit(True)
    stats = materialize(p.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")), "knn-stats")
    out = ["plant_id", F.col("q_id").alias("point_id"), F.col("p_id").alias("nbr_id"), "d2", "rank"]
    if brute is None:
        asked = q.groupBy("plant_id").agg(F.count(F.lit(1)).alias("asked"))
        stats = materialize(stats.join(asked, "plant_id").where((F.col("n") > limit) & (F.col("n") * F.col("asked") > BRUTE_PAIRS)), "knn-large")
    else:
        stats = stats.where(F.col("n") > limit)
    many = stats.select("plant_id")
    result = _full(q.join(many, "plant_id", "left_anti"), p, k, other).select(*out)
    if many.isEmpty():
        return result
    large = _by_cells(q.join(many, "plant_id", "left_semi"), p.join(many, "plant_id", "left_semi"), k, other)
    return result.unionByName(large.select(*out))


def nearest_join(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(plant_id, point_id, nbr_id, d2): the nearest point of each query."""
    return knn_join(queries, points, 1).drop("rank")


def with_fallback(neighbours: DataFrame, points: DataFrame, least: int = 3, k: int = 3) -> DataFrame:
    """Radius neighbours, but the k nearest others for points that have fewer than `least` (themselves included)."""
    counts = neighbours.groupBy("plant_id", "point_id").agg(F.count(F.lit(1)).alias("n"))
    poor = points.join(counts.where(F.col("n") >= least), ["plant_id", "point_id"], "left_anti")
    rest = neighbours.join(poor.select("plant_id", "point_id"), ["plant_id", "point_id"], "left_anti")
    return rest.unionByName(knn_join(poor, points, k, exclude_self=True).drop("rank"))


def mean_spacing(points: DataFrame, k: int = 8) -> DataFrame:
    """(plant_id, spacing): the mean distance to the k nearest neighbours."""
    near = knn_join(points, points, k, exclude_self=True)
    return near.groupBy("plant_id").agg(F.avg(F.sqrt("d2")).alias("spacing"))
