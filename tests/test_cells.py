"""The k-d partition against brute force, on clouds that a grid cannot serve."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborel.operators import cells as C
from arborel.operators import spatial
from arborel.operators.cells import Cells

SCHEMA = "plant_id string, point_id long, x double, y double, z double"


def clouds():
    rng = random.Random(3)
    even = [("even", i, rng.random(), rng.random(), rng.random()) for i in range(700)]
    apart = [("apart", i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 0.01)) for i in range(692)] + [("apart", 692 + i, 1e6 * 3**i, -(1e5**1.0) * i, 1e7) for i in range(8)]
    equal = [("equal", i, 1.0, 2.0, 3.0) for i in range(400)] + [("equal", 400 + i, float(i % 3), 2.0, 3.0) for i in range(60)]
    flat = [("flat", i, float(i % 20), float(i // 20), 0.0) for i in range(400)]
    return even + apart + equal + flat


def d2(p, q):
    return sum((a - b) ** 2 for a, b in zip(p[2:], q[2:]))


def test_cells_hold_few_points_in_tight_boxes(spark):
    rows = [r for r in clouds() if r[0] != "equal"]
    cells = Cells(spark.createDataFrame(rows, SCHEMA).repartition(3), 16)
    held = cells.filed.groupBy("plant_id", "node").count().collect()
    assert sum(r["count"] for r in held) == len(rows) and max(r["count"] for r in held) <= 16
    assert len(held) < len(rows) / 4
    placed = cells.place(spark.createDataFrame(rows, SCHEMA))
    assert placed.join(cells.filed, ["plant_id", "point_id"]).where(placed.node != cells.filed.node).count() == 0
    roots = {r.plant_id: r.n for r in cells.boxes.where("parent = 0").collect()}
    assert roots == {p: sum(r[0] == p for r in rows) for p in ("even", "apart", "flat")}


def test_small_samples_take_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLE", 100)
    rows = [r for r in clouds() if r[0] in ("even", "apart")]
    cells = Cells(spark.createDataFrame(rows, SCHEMA), 10)
    assert len(cells.trees) > 1 and cells.leaves.where("n > 10").count() == 0
    assert cells.filed.count() == len(rows)


@pytest.mark.parametrize("k", [1, 5, 30])
def test_neighbours_on_uneven_clouds(spark, k):
    rows = clouds()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in spatial.knn_join(df, df, k, exclude_self=True, brute=0).collect():
        got.setdefault((r.plant_id, r.point_id), {})[r["rank"]] = r.nbr_id
    for p in rows[::7]:
        near = sorted((d2(p, q), q[1]) for q in rows if q[0] == p[0] and q[1] != p[1])[:k]
        assert [got[p[0], p[1]][i + 1] for i in range(k)] == [i for _, i in near]
    assert len(got) == len(rows)


def test_queries_of_their_own(spark):
    rows = clouds()
    asked = [(p, i, 40.0 * math.sin(i), 3.0 * i, -1.0 + i % 2) for p in ("even", "apart", "equal", "no points") for i in range(40)]
    got = {}
    for r in spatial.knn_join(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(rows, SCHEMA), 4, brute=0).collect():
        got.setdefault((r.plant_id, r.point_id), {})[r["rank"]] = r.nbr_id
    for p in asked:
        near = sorted((d2(p, q), q[1]) for q in rows if q[0] == p[0])[:4]
        assert [got.get((p[0], p[1]), {}).get(i + 1) for i in range(len(near))] == [i for _, i in near]


def test_pairs_stay_few_beside_points_apart(spark, monkeypatch):
    """4000 points, 8 of them far away: the pairs compared stay below a million of sixteen."""
    rng = random.Random(1)
    rows = [("p", i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(3992)] + [("p", 3992 + i, 1e4 * (i + 1), 1e4, -1e4 * i) for i in range(8)]
    looked = []
    visits = Cells.visits

    def counted(self, asks):
        out = visits(self, asks)
        looked.append(out.join(self.leaves.select("plant_id", "node", "n"), ["plant_id", "node"]).agg(F.sum("n")).first()[0])
        looked.append(asks.count() * self.most)
        return out

    monkeypatch.setattr(Cells, "visits", counted)
    df = spark.createDataFrame(rows, SCHEMA)
    assert spatial.knn_join(df, df, 8, exclude_self=True).count() == 32_000 and looked
    assert sum(looked) < 1_000_000


def test_radius_by_plant(spark):
    rows = [r for r in clouds() if r[0] in ("even", "flat")]
    df = spark.createDataFrame(rows, SCHEMA)
    reach = {"even": 0.1, "flat": 1.5}
    got = {(r.plant_id, r.point_id, r.nbr_id) for r in spatial.radius_join(df, df, spark.createDataFrame(list(reach.items()), "plant_id string, radius double")).collect()}
    assert got == {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and d2(p, q) <= reach[p[0]] ** 2}
