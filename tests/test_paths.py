"""Shortest paths by patches against a plain Dijkstra and the hop-by-hop rounds."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.operators import contraction, paths

POINTS = "plant_id string, point_id long, x double, y double, z double"
START = "plant_id string, point_id long"


def plain(edges, start):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if d > best[at]:
            continue
        for b, w in near.get(at, []):
            if d + w < best.get(b, np.inf):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return best


def test_long_lines_take_few_rounds(spark):
    line = spark.range(2001).select(F.lit("l").alias("plant_id"), F.col("id").alias("point_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    start = spark.createDataFrame([("l", 0)], START)
    # hop by hop these are 2000 rounds
    got = {r.point_id: r.value for r in paths.patch_distance(line, start, 2, patch=256, max_rounds=25).collect()}
    assert got == {i: float(i) for i in range(2001)}
    with pytest.raises(RuntimeError):
        paths.patch_distance(line, start, 2, patch=256, max_rounds=3)


def test_patches_give_the_values_of_hops(spark):
    rng = np.random.default_rng(5)
    rows = [(p, i, *map(float, xyz)) for p, n in (("a", 300), ("b", 40)) for i, xyz in enumerate(rng.random((n, 3)))]
    points = spark.createDataFrame(rows + [("c", 7, 1.0, 1.0, 1.0)], POINTS)
    start = spark.createDataFrame([("a", 3), ("a", 100), ("b", 0), ("b", 0), ("c", 7), ("c", 99), ("gone", 1)], START)
    want = {(r.plant_id, r.point_id): r.value for r in contraction.graph_distance(points, start.where("point_id < 99 or plant_id = 'a'").where("plant_id <> 'gone'").distinct(), k=4).collect()}
    got = {(r.plant_id, r.point_id): r.value for r in paths.patch_distance(points, start, k=4, patch=32).collect()}
    assert got == want and got[("c", 7)] == 0.0


def test_equal_points_parts_apart_and_repeated_edges(spark):
    # 60 equal points are more than a patch; 200 and 201 cannot be reached
    rows = [("e", i, 0.0, 0.0, 0.0) for i in range(60)] + [("e", 60 + i, 1.0 + i, 0.0, 0.0) for i in range(20)] + [("e", 200, 500.0, 0.0, 0.0), ("e", 201, 501.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, POINTS).withColumn("patch", F.lit(1)).withColumn("value", F.lit("clash"))
    sizes = [r["count"] for r in paths.patches(points, 16).groupBy("plant_id", "patch").count().collect()]
    assert sum(sizes) == 82 and len(sizes) > 5 and max(sizes) < 32
    edges = [(i, i + 1, 0.0) for i in range(59)] + [(i, i + 1, 1.0) for i in range(59, 79)] + [(79, 0, 100.0), (79, 0, 12.5), (5, 5, 1.0), (200, 201, 1.0)]
    table = spark.createDataFrame([("e", *e) for e in edges], "plant_id string, a long, b long, w double")
    start = spark.createDataFrame([("e", 30)], START)
    got = {r.point_id: r.value for r in paths.shortest_paths(points, table, start, patch=16).collect()}
    assert got == plain(edges, 30) and 200 not in got


def test_empty_tables(spark):
    none = spark.createDataFrame([], POINTS)
    edges = spark.createDataFrame([], "plant_id string, a long, b long, w double")
    start = spark.createDataFrame([("e", 0)], START)
    assert paths.shortest_paths(none, edges, start).count() == 0
    one = spark.createDataFrame([("e", 0, 0.0, 0.0, 0.0), ("e", 1, 1.0, 0.0, 0.0)], POINTS)
    assert [tuple(r) for r in paths.shortest_paths(one, edges, start).collect()] == [("e", 0, 0.0)]
    assert paths.shortest_paths(one, edges, start.limit(0)).count() == 0
