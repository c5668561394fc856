import numpy as np
import pytest

from arborel.operators import contraction, dissection, mesh, schwarz


def _system(at, k, hold, seed=0):
    """Entries of a positive definite matrix along the k nearest neighbours, with `hold` on its diagonal."""
    rng = np.random.default_rng(seed)
    d = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    a = np.zeros((len(at), len(at)))
    for i, near in enumerate(np.argsort(d, axis=1)[:, 1 : k + 1]):
        w = rng.uniform(0.5, 2, k)
        a[i, near] -= w
        a[near, i] -= w
    return a + np.diag(-a.sum(axis=1) + hold)


def _solve(spark, plants, **options):
    coo = [(name, int(i), int(j), float(a[i, j])) for name, (a, _, _) in plants.items() for i, j in zip(*np.nonzero(a), strict=True)]
    rhs = [(name, r, *map(float, v)) for name, (_, b, _) in plants.items() for r, v in enumerate(b)]
    places = [(name, r, *map(float, p)) for name, (_, _, at) in plants.items() for r, p in enumerate(at)]
    return schwarz.solve(
        spark.createDataFrame(coo, "plant_id string, row long, col long, val double"),
        spark.createDataFrame(rhs, "plant_id string, row long, u double, v double"),
        spark.createDataFrame(places, "plant_id string, row long, x double, y double, z double"),
        **options,
    )


def test_patches_give_the_dense_solve(spark):
    """Clouds that fill a volume, a stiff part, equal places and a plant of one patch, a zero right-hand side among them."""
    rng = np.random.default_rng(3)
    box, same = rng.uniform(0, 1, (500, 3)), np.zeros((150, 3))
    stiff = _system(box, 5, 0.5)
    stiff[:20, :20] += 1e4 * np.eye(20) - 400
    stiff += np.diag(np.full(500, 1.0))
    plants = {
        "box": (stiff, rng.standard_normal((500, 2)), box),
        "same": (_system(rng.standard_normal((150, 3)), 3, 1.0), rng.standard_normal((150, 2)) * [1, 0], same),
        "one": (np.array([[4.0]]), np.array([[2.0, 8.0]]), np.zeros((1, 3))),
    }
    got = _solve(spark, plants, patch=128)
    assert got.columns == ["plant_id", "row", "u", "v"]
    found = {(r.plant_id, r.row): (r.u, r.v) for r in got.collect()}
    assert len(found) == 651
    for name, (a, b, _) in plants.items():
        x = np.array([found[name, i] for i in range(len(a))])
        assert np.allclose(x, np.linalg.solve(a, b), atol=1e-8)


def test_too_few_rounds_are_an_error(spark):
    box = np.random.default_rng(4).uniform(0, 1, (200, 3))
    with pytest.raises(ArithmeticError, match="not solved after 2 rounds"):
        _solve(spark, {"p": (_system(box, 4, 0.01), np.ones((200, 2)) * [1, 2] + box[:, :2], box)}, patch=16, most=2)


def test_a_step_of_a_large_plant_has_no_fronts(spark, monkeypatch):
    """Large plants need no dissection, and six digits are those of the dense solve, by one task too."""
    at = np.random.default_rng(6).uniform(0, 1, (600, 3))
    points = spark.createDataFrame([("p", i, *map(float, p)) for i, p in enumerate(at)], "plant_id string, point_id long, x double, y double, z double")
    soup = dissection.materialize(mesh.local_triangles(points, 8), "soup")
    parts = [dissection.materialize(df, "part") for df in (contraction.initial_weights(points, points.where("point_id = 0")), mesh.laplacian(soup, points), contraction.distance_constraints(points, 0.05))]
    a, b = contraction.stacked_system(points, *parts)
    dense, right = np.zeros((600, 600)), np.zeros((600, 3))
    for r in contraction.normal_matrix(a).collect():
        dense[r.row, r.col] = r.val
    for r in contraction.normal_rhs(a, b).collect():
        right[r.row] = r.bx, r.by, r.bz
    wanted = np.linalg.solve(dense, right)

    def fronts(*_):
        raise AssertionError("dissected")

    monkeypatch.setattr(dissection, "solve", fronts)
    monkeypatch.setattr(schwarz.solve, "__defaults__", (200, 1e-10, 200))
    for most in (100, 1000):
        moved = contraction.contract_once(points, *parts, one_task=most).orderBy("point_id").collect()
        assert np.abs(np.array([(r.x, r.y, r.z) for r in moved]) - wanted).max() < 1e-9
