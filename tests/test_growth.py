"""What queries move as their clouds grow in one place: with the points, not with the pairs of them."""

import random

import pytest
from pyspark.sql import functions as F

from arborel.operators import contraction
from arborel.operators.spatial import radius_join
from arborel.plans import catalogue

POINTS = "plant_id string, point_id long, x double, y double, z double"


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def written(spark, folder, n, side=0.1):
    rng = random.Random(4)
    rows = [(i, [rng.random() * side for _ in range(3)], i % 2) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def moved(spark, tmp_path, name, n):
    folder = written(spark, tmp_path / str(n), n)
    before = shuffled(spark)
    catalogue.queries()[name](spark, folder).collect()
    return shuffled(spark) - before


@pytest.mark.parametrize("name", ["sigma_smooth", "spaced_points", "components_radius"])
def test_shuffles_grow_with_the_points(spark, tmp_path, name):
    assert moved(spark, tmp_path, name, 2000) < 3 * moved(spark, tmp_path, name, 1000)


def test_linearness_is_the_mean_over_pairs(spark):
    rng = random.Random(8)
    rows = [("a", i, rng.random(), rng.random() * 0.2, 0.0) for i in range(150)] + [("a", 200, 9.0, 9.0, 9.0), ("a", 201, 5.0, 0.0, 0.0), ("a", 202, 5.01, 0.0, 0.0)]
    rows += [("same", i, 1.0, 1.0, 1.0) for i in range(4)]
    points = spark.createDataFrame(rows, POINTS)
    near = radius_join(points, points, 0.1)
    want = contraction.smooth_sigma(contraction.sigma(points, 0.1, 0.9, near), near).collect()
    got = {(r.plant_id, r.point_id): (r.sigma, r.smooth_sigma) for r in contraction.linearness(points, 0.1).collect()}
    assert len(got) == len(want) == len(rows)
    for r in want:
        for a, b in zip(got[r.plant_id, r.point_id], (r.sigma, r.smooth_sigma), strict=True):
            assert a == b or abs(a - b) < 1e-12
