import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from arborel.operators import contraction, dissection, mesh


def _sheet(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.uniform(0, 1, n), rng.uniform(0, 1, n), 0.05 * rng.standard_normal(n)])


def _system(at, k, seed=0):
    """Entries of a positive definite matrix along the k nearest neighbours."""
    rng = np.random.default_rng(seed)
    d = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    a = np.zeros((len(at), len(at)))
    for i, near in enumerate(np.argsort(d, axis=1)[:, 1 : k + 1]):
        w = rng.uniform(0.5, 2, k)
        a[i, near] -= w
        a[near, i] -= w
    a += np.diag(-a.sum(axis=1) + 0.1)
    return a


def _tables(spark, plants):
    coo, rhs, places = [], [], []
    for name, (a, b, at) in plants.items():
        i, j = np.nonzero(a)
        coo += [(name, int(r), int(c), float(a[r, c])) for r, c in zip(i, j, strict=True)]
        rhs += [(name, r, *map(float, v)) for r, v in enumerate(b)]
        places += [(name, r, *map(float, p)) for r, p in enumerate(at)]
    return (
        spark.createDataFrame(coo, "plant_id string, row long, col long, val double"),
        spark.createDataFrame(rhs, "plant_id string, row long, u double, v double"),
        spark.createDataFrame(places, "plant_id string, row long, x double, y double, z double"),
    )


def test_dissection_is_the_dense_solve(spark):
    """Sheets, a hub that couples with everything, and many points at one place, in leaves of 16."""
    rng = np.random.default_rng(5)
    sheet, line = _sheet(700), np.column_stack([np.linspace(0, 1, 300), np.zeros(300), np.zeros(300)])
    hub = _system(sheet[:200], 4)
    hub[0, 1:] -= 0.01
    hub[1:, 0] -= 0.01
    hub += np.diag(np.full(200, 2.5))
    same = np.zeros((120, 3))
    plants = {
        "sheet": (_system(sheet, 6), rng.standard_normal((700, 2)), sheet),
        "line": (_system(line, 2), rng.standard_normal((300, 2)), line),
        "hub": (hub, rng.standard_normal((200, 2)), sheet[:200]),
        "same": (_system(rng.standard_normal((120, 3)), 3), rng.standard_normal((120, 2)), same),
        "one": (np.array([[4.0]]), np.array([[2.0, 8.0]]), np.zeros((1, 3))),
    }
    got = dissection.solve(*_tables(spark, plants), leaf=16)
    assert got.columns == ["plant_id", "row", "u", "v"]
    found = {(r.plant_id, r.row): (r.u, r.v) for r in got.collect()}
    assert len(found) == sum(len(a) for a, _, _ in plants.values())
    for name, (a, b, _) in plants.items():
        wanted = np.linalg.solve(a, b)
        assert np.allclose([found[name, r] for r in range(len(a))], wanted, atol=1e-8), name


def test_fronts_stay_small(spark):
    """No node's front holds more than a small part of a sheet of 4000 points."""
    side = 64
    grid = np.array([(x, y, 0.0) for x in range(side) for y in range(side)])
    coo = [("g", i, i, 4.5) for i in range(side * side)]
    for x in range(side):
        for y in range(side):
            for other in [(x + 1, y), (x, y + 1)]:
                if max(other) < side:
                    i, j = x * side + y, other[0] * side + other[1]
                    coo += [("g", i, j, -1.0), ("g", j, i, -1.0)]
    rhs = [("g", i, 1.0) for i in range(side * side)]
    sizes_seen = []
    plain = dissection.materialize

    def watched(df, label, **more):
        out = plain(df, label, **more)
        if label == "dissection-front":
            own = out.where("part < 0").groupBy("node").count().agg({"count": "max"}).first()[0] or 0
            rest = out.where("part >= 0").groupBy("part").count().agg({"count": "max"}).first()[0] or 0
            sizes_seen.append(own + rest)
        return out

    dissection.materialize = watched
    try:
        got = contraction.solve_spd(
            spark.createDataFrame(coo, "plant_id string, row long, col long, val double"),
            spark.createDataFrame(rhs, "plant_id string, row long, b double"),
            spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(grid)], "plant_id string, row long, x double, y double, z double"),
            one_task=1000,
        )
        x = np.array([r.x for r in got.orderBy("row").collect()])
    finally:
        dissection.materialize = plain
    left = 4.5 * x.reshape(side, side)
    for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
        moved = np.roll(x.reshape(side, side), step, axis)
        edge = (0 if step == 1 else side - 1)
        moved[(edge, slice(None)) if axis == 0 else (slice(None), edge)] = 0
        left = left - moved
    assert np.allclose(left, 1.0, atol=1e-8)
    assert len(sizes_seen) >= 2 and max(sizes_seen) < 700


def test_large_plants_contract_as_small_ones_do(spark):
    """Positions of a step are the same by one task and by dissection, and plants of both kinds go together."""
    rows = [(name, i, *map(float, p)) for name, n, seed in (("big", 400, 1), ("small", 40, 2)) for i, p in enumerate(_sheet(n, seed))]
    points = spark.createDataFrame(rows, "plant_id string, point_id long, x double, y double, z double")
    soup = dissection.materialize(mesh.local_triangles(points, 8), "soup")
    weights = contraction.initial_weights(points, points.where("point_id = 0"))
    parts = points, weights, mesh.laplacian(soup, points), contraction.distance_constraints(points, 0.05)
    wanted = {(r.plant_id, r.point_id): (r.x, r.y, r.z) for r in contraction.contract_once(*parts).collect()}
    got = {(r.plant_id, r.point_id): (r.x, r.y, r.z) for r in contraction.contract_once(*parts, one_task=100).collect()}
    assert wanted.keys() == got.keys()
    assert np.allclose([got[k] for k in wanted], [wanted[k] for k in wanted], atol=1e-5)


def test_unsolved_dissections_are_errors(spark):
    coo = [("p", 0, 0, 1.0), ("p", 0, 1, 2.0), ("p", 1, 0, 2.0), ("p", 1, 1, 1.0)]
    coo = spark.createDataFrame(coo, "plant_id string, row long, col long, val double")
    rhs = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 1.0)], "plant_id string, row long, b double")
    places = spark.createDataFrame([("p", 0, 0.0, 0.0, 0.0), ("p", 1, 1.0, 0.0, 0.0)], "plant_id string, row long, x double, y double, z double")
    with pytest.raises(Exception, match="not positive definite"):
        dissection.solve(coo, rhs, places)
    skew = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 0, 1, 0.9), ("p", 1, 1, 1.0)], "plant_id string, row long, col long, val double")
    with pytest.raises(Exception, match="not symmetric"):
        dissection.solve(skew, rhs, places, leaf=1)
    unit = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 1, 1, 1.0)], "plant_id string, row long, col long, val double")
    right, wrong = (spark.createDataFrame([("p", 0, [a]), ("p", 1, [b])], "plant_id string, row long, b array<double>") for a, b in ((1.0, 1.0), (1.0, 1.1)))
    dissection._check(unit, right, right.withColumnRenamed("b", "x"), 1, 1e-7)
    with pytest.raises(ArithmeticError, match="residual"):
        dissection._check(unit, right, wrong.withColumnRenamed("b", "x"), 1, 1e-7)


def test_nodes_that_only_hand_on_give_no_rows():
    """A node may have a border and nothing to eliminate: an empty frame that Arrow can still type."""
    rows = pd.DataFrame({"plant_id": [], "row": [], "vals": [], "b": []})
    border = pd.DataFrame({"plant": ["p"], "at": [4], "place": [7], "x": [np.array([1.0])]})
    got = dissection._put_in(1)(("p", 4), rows, border)
    assert len(got) == 0
    assert pa.Array.from_pandas(got["x"], type=pa.list_(pa.float64())).type == pa.list_(pa.float64())


def test_empty_systems(spark):
    coo, rhs, places = (df.limit(0) for df in _tables(spark, {"one": (np.array([[4.0]]), np.array([[2.0, 8.0]]), np.zeros((1, 3)))}))
    assert dissection.solve(coo, rhs, places).count() == 0
