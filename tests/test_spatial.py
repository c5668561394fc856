import random

import pytest

from arborel.operators import cloud, spatial
from arborel.operators.components import connected_components

SCHEMA = "plant_id string, point_id long, x double, y double, z double"


def points(n, seed=0, plants=("a", "b"), duplicates=0):
    rng = random.Random(seed)
    rows = [(p, i, rng.gauss(0, 1), rng.gauss(0, 1), rng.random() * 0.1) for p in plants for i in range(n)]
    return rows + [(p, n + i, *rows[0][2:]) for p in plants for i in range(duplicates)]


def d2(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[2:], q[2:]))


@pytest.mark.parametrize("brute", [4096, 0])
def test_knn_both_ways(spark, brute):
    rows = points(120, duplicates=12)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.plant_id, r.point_id, r.rank): r.nbr_id for r in spatial.knn_join(df, df, 5, exclude_self=True, brute=brute).collect()}
    for p in rows:
        near = sorted((d2(p, q), q[1]) for q in rows if q[0] == p[0] and q[1] != p[1])[:5]
        assert [got[p[0], p[1], k + 1] for k in range(5)] == [i for _, i in near]


def test_knn_with_fewer_points_than_k(spark):
    df = spark.createDataFrame(points(3), SCHEMA)
    assert spatial.knn_join(df, df, 5, exclude_self=True, brute=0).count() == 12
    assert spatial.knn_join(df, df, 5, brute=0).count() == 18


def test_radius_join_is_brute_force(spark):
    rows = points(100, 3, duplicates=4)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.plant_id, r.point_id, r.nbr_id) for r in spatial.radius_join(df, df, 0.4).collect()}
    assert got == {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and d2(p, q) <= 0.4**2}


def test_fallback_gives_isolated_points_three_neighbours(spark):
    rows = points(40, 5, plants=("a",)) + [("a", 99, 50.0, 50.0, 50.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    near = spatial.with_fallback(spatial.radius_join(df, df, 0.5), df)
    assert near.where("point_id = 99 and nbr_id <> 99").count() == 3


def test_farthest_points(spark):
    rows = points(60, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for plant in "ab":
        mine = [r for r in rows if r[0] == plant]
        chosen = [42]
        while len(chosen) < 10:
            chosen.append(max((i for i in range(60) if i not in chosen), key=lambda i: (min(d2(mine[i], mine[j]) for j in chosen), -i)))
        got = cloud.farthest_points(df, m=10).where(f"plant_id = '{plant}'").orderBy("pos").collect()
        assert [r.point_id for r in got] == chosen
    assert [r.point_id for r in cloud.farthest_points(df, m=60).where("plant_id = 'a'").orderBy("pos").collect()] == list(range(60))
    with pytest.raises(Exception, match="fewer than"):
        cloud.farthest_points(df, m=61).collect()
    assert cloud.fps_size(5, 0.5) == 3


def test_downsample_gives_exactly_n(spark):
    df = spark.createDataFrame(points(200, 9, duplicates=30), SCHEMA)
    got = cloud.uniform_downsample(df, 40)
    assert {r["count"] for r in got.groupBy("plant_id").count().collect()} == {40}
    assert got.distinct().count() == 80
    with pytest.raises(ValueError):
        cloud.uniform_downsample(df, 1000)


def test_normalize_by_longest_extent(spark):
    rows = [("p", 0, 0.0, 0.0, 0.0), ("p", 1, 1.0, 2.0, 4.0)]
    out = cloud.normalize(spark.createDataFrame(rows, SCHEMA), 1.6).orderBy("point_id").collect()
    assert [round(out[1][a], 9) for a in "xyz"] == [0.2, 0.4, 0.8] and out[0].scale == pytest.approx(0.4)
    one = cloud.normalize(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert (one.x, one.scale) == (0.0, 1.0)


@pytest.mark.parametrize("options", [{"m": 12}, {"ratio": 0.2}])
def test_farthest_points_in_rounds(spark, monkeypatch, options):
    rng = random.Random(9)
    rows = [(p, i * 3, rng.random(), rng.random(), rng.random()) for p, n in (("a", 70), ("b", 55), ("c", 20)) for i in range(n)] + [("d", i, float(i % 2), 0.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, cloud.farthest_points(df, **options).collect()))
    monkeypatch.setattr(cloud, "KERNEL_POINTS", 50)
    monkeypatch.setattr(cloud, "WRITE_EVERY", 2)
    monkeypatch.setattr(cloud, "TOP", 9)
    assert sorted(map(tuple, cloud.farthest_points(df, **options).collect())) == want
    with pytest.raises(ValueError):
        cloud.farthest_points(df, m=58)


def test_many_picks_in_a_round(spark, monkeypatch):
    """Rows are the one-task kernel's, ties of a grid and equal points included, in fewer than m / 20 rounds."""
    rng = random.Random(12)
    rows = [("even", i, rng.random(), rng.random(), rng.random()) for i in range(2500)] + [("grid", i, float(i % 40), float(i // 40 % 30), 0.0) for i in range(1300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, cloud.farthest_points(df, m=400).collect()))
    monkeypatch.setattr(cloud, "KERNEL_POINTS", 50)
    monkeypatch.setattr(cloud, "TOP", 1000)
    written, materialize = [], cloud.materialize
    monkeypatch.setattr(cloud, "materialize", lambda df, label, **options: written.append(label) or materialize(df, label, **options))
    assert sorted(map(tuple, cloud.farthest_points(df, m=400).collect())) == want
    assert written.count("far-picked") < 400 / 20
    whole = cloud.farthest_points(df.where("plant_id = 'grid'"), m=1300)
    assert [r.point_id for r in whole.orderBy("pos").collect()] == list(range(1300))


def test_sphere(spark):
    rows = cloud.debug_sphere().collect()
    assert len(rows) == 19 * 37 and all(abs(r.x**2 + r.y**2 + r.z**2 - 1) < 1e-12 for r in rows)
    assert {(r["stack"], r.sector) for r in rows} == {(i, j) for i in range(19) for j in range(37)}


def test_finite(spark):
    nan = float("nan")
    assert cloud.finite(spark.createDataFrame([("p", 0, nan, 0.0, 0.0), ("p", 1, 1.0, float("inf"), 0.0), ("p", 2, None, 0.0, 0.0), ("p", 3, 1.0, 1.0, 1.0)], SCHEMA)).count() == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    rng.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: top(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
