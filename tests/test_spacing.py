"""Down-sampling by spacing against the greedy order, and row numbers by ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from arborel.operators.numbering import numbered
from arborel.operators.spacing import spaced_downsample, spaced_points

SCHEMA = "plant_id string, point_id long, x double, y double, z double"


def clouds():
    rng = random.Random(6)
    rows = [("even", i * 3, rng.random(), rng.random(), rng.random()) for i in range(220)]
    rows += [("apart", i, rng.gauss(0, 1), rng.gauss(0, 0.1), 0.0) for i in range(180)] + [("apart", 500, 1e5, 0.0, 0.0)]
    rows += [("grid", i, float(i % 13), float(i // 13), 0.0) for i in range(169)]
    rows += [("equal", i, 1.0, 1.0, 1.0) for i in range(90)] + [("equal", 90 + i, float(i), 0.0, 1.0) for i in range(12)]
    return rows


def turn(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i


def d2(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[2:], q[2:]))


def greedy(rows, spacing):
    kept = []
    for p in sorted(rows, key=lambda r: turn(r[1])):
        if all(d2(p, q) >= spacing**2 for q in kept):
            kept.append(p)
    return kept


@pytest.mark.parametrize("spacing", [0.3])
def test_spacing_is_the_greedy_order(spark, spacing):
    rows = clouds()
    got = {tuple(r) for r in spaced_points(spark.createDataFrame(rows, SCHEMA).repartition(3), spacing).collect()}
    for plant in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == plant]
        kept = [r for r in mine if (plant, r[1]) in got]
        assert kept and sorted(kept) == sorted(greedy(mine, spacing))
        assert all(d2(p, q) >= spacing**2 for p in kept for q in kept if p is not q)
        assert all(min(d2(p, q) for q in kept) < spacing**2 for p in mine if p not in kept)


@pytest.mark.parametrize("n", [12, 40])
def test_exactly_n_in_one_task_and_in_rounds(spark, n):
    rows = clouds()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = sorted(map(tuple, spaced_downsample(df, n).collect()))
    assert {p: sum(r[0] == p for r in small) for p in ("even", "apart", "grid", "equal")} == dict.fromkeys(("even", "apart", "grid", "equal"), n)
    assert len(set(small)) == 4 * n and set(small) <= set(rows)
    if n == 40:
        two = df.where("plant_id in ('even', 'apart')")
        assert sorted(map(tuple, spaced_downsample(two, n, kernel=190).collect())) == [r for r in small if r[0] in ("even", "apart")]
        # no closer than a random choice's nearest, by far
        mine = [r for r in small if r[0] == "even"]
        least = min(d2(p, q) for p in mine for q in mine if p is not q)
        assert least > 0.15**2
    with pytest.raises(ValueError):
        spaced_downsample(df, 103)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spaced_downsample(df, 5).count() == 0 and spaced_points(df, 1.0).count() == 0


def test_numbers_by_ranges(spark):
    rng = random.Random(2)
    rows = [(p, rng.random(), i) for p, n in (("a", 300), ("b", 1), ("c", 57)) for i in range(n)]
    df = spark.createDataFrame(rows, "plant_id string, v double, i int").repartition(5)
    got = numbered(df, [F.col("v").desc()], "place").collect()
    assert len(got) == len(rows)
    for plant in "abc":
        mine = sorted((r for r in got if r.plant_id == plant), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)
