"""The contraction loop and its parts against a plain numpy re-run of the same rules."""

import heapq
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.config import Config
from arborel.operators import cloud, contraction, mesh

POINTS = "plant_id string, point_id long, x double, y double, z double"


def noisy_y(seed, n, noise=0.05):
    rng = random.Random(seed)
    arms = [((0, 0, 0), (0, 0, 1)), ((0, 0, 1), (0.5, 0, 1.5)), ((0, 0, 1), (-0.5, 0, 1.5))]
    rows = []
    for i in range(n):
        a, b = arms[i % 3]
        t = rng.random()
        rows.append(tuple(p + t * (q - p) + rng.gauss(0, noise) for p, q in zip(a, b)))
    return np.array(rows)


def nearest(p, k):
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    return [np.lexsort((np.arange(len(p)), d2[i]))[:k] for i in range(len(p))]


def soup(p, k):
    return [(i, int(near[a]), int(near[b])) for i, near in enumerate(nearest(p, k)) for a, b in mesh.one_ring(p[i], p[near])]


def area(p, t):
    t = np.array(t)
    return np.sqrt((np.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]) ** 2).sum(axis=1)).sum() / 2 / len(p)


def edges_of(tris):
    return sorted({(min(a, b), max(a, b)) for t in tris for a, b in (t[:2], t[1:], (t[2], t[0]))})


def cotan(p, tris):
    lap = np.zeros((len(p), len(p)))
    for t in tris:
        for c in range(3):
            o, i, j = t[c], t[(c + 1) % 3], t[(c + 2) % 3]
            u, v = p[i] - p[o], p[j] - p[o]
            w = u @ v / np.linalg.norm(np.cross(u, v)) / 2
            lap[[i, j], [j, i]] += w
            lap[[i, j], [i, j]] -= w
    return lap


def cover_laplacian(p, tris):
    corners, sides = mesh.tufted_cover(np.array(tris), p)
    lap = np.zeros((len(p), len(p)))
    for t, s in zip(corners, sides):
        q = s.sum() / 2
        a = np.sqrt(q * (q - s[0]) * (q - s[1]) * (q - s[2]))
        for k in range(3):
            i, j = t[k], t[(k + 1) % 3]
            w = (s[(k + 1) % 3] ** 2 + s[(k + 2) % 3] ** 2 - s[k] ** 2) / (8 * a) / 2
            lap[i, j] += w
            lap[j, i] += w
            lap[i, i] -= w
            lap[j, j] -= w
    return lap


def cover_edges(p, tris):
    return [e for e in edges_of(mesh.tufted_cover(np.array(tris), p)[0].tolist()) if e[0] != e[1]]


def cover_area(p, tris):
    s = mesh.tufted_cover(np.array(tris), p)[1]
    q = s.sum(axis=1) / 2
    return np.sqrt(q * (q - s[:, 0]) * (q - s[:, 1]) * (q - s[:, 2])).sum() / 2 / len(p)


def smooth(p, r, tau):
    d = p[:, None] - p[None]
    near = (d**2).sum(axis=2) <= r * r
    sig = np.empty(len(p))
    for i in range(len(p)):
        x = d[i][near[i]]
        w = np.exp(-np.abs(x).sum(axis=1) ** 2 / (r / 4) ** 2)
        m = (x * w[:, None]).T @ x
        sig[i] = tau if near[i].sum() < 3 else np.linalg.eigvalsh(m)[-1] / np.trace(m)
    out = []
    for i in range(len(p)):
        others = [j for j in np.flatnonzero(near[i]) if j != i or near[i].sum() < 3]
        out.append((sig[i] + sig[others].sum()) / (len(others) + 1))
    return np.array(out)


def tips(p, k, k_tip):
    near = nearest(p, k)
    dist, low = np.full(len(p), np.inf), int(np.lexsort((np.arange(len(p)), p[:, 2]))[0])
    both = {(i, int(j)) for i in range(len(p)) for j in near[i]}
    around = [[] for _ in p]
    for i, j in both | {(j, i) for i, j in both}:
        around[i].append(j)
    dist[low], queue = 0, [(0.0, low)]
    while queue:
        d, i = heapq.heappop(queue)
        for j in around[i]:
            if d + np.linalg.norm(p[i] - p[j]) < dist[j]:
                dist[j] = d + np.linalg.norm(p[i] - p[j])
                heapq.heappush(queue, (dist[j], j))
    return [i for i, n in enumerate(nearest(p, k_tip)) if np.isfinite(dist[i]) and dist[i] > max(dist[j] for j in n if np.isfinite(dist[j]))] + [low]


def twin(p, c):
    """(points, ratios, steps kept) by dense algebra."""
    n, span = len(p), c.normalize_length
    wl, wh = np.ones(n), np.ones(n)
    wh[tips(p, 8, c.tip_neighbours)] = 9
    tris = soup(p, c.knn)
    lengths = np.array([np.linalg.norm(p[i] - p[j]) for i, j in edges_of(tris)])
    long_ = lengths[lengths - lengths.mean() > 3 * lengths.std()]
    cut = long_.min() if len(long_) else np.inf
    measure = cover_area if c.intrinsic else area
    base, ratios, kept = measure(p, soup(p, c.area_knn)), [], [p]
    for step in range(1, c.max_iterations + 1):
        if step > 1:
            s = smooth(p, c.sigma_radius * span, c.sigma_threshold)
            for i in range(n):
                if wh[i] not in (9, 3):
                    if s[i] >= c.sigma_threshold:
                        wl[i], wh[i] = 0, 3
                    elif s[i] < c.sigma_threshold - 0.10:
                        wl[i] = min(3 * wl[i], 9)
            tris = soup(p, min(c.knn + (step - 1) * c.knn_step, c.knn_most))
            tris = [t for t in tris if max(np.linalg.norm(p[t[a]] - p[t[b]]) for a, b in ((0, 1), (1, 2), (2, 0))) < cut]
            used, near = {i for t in tris for i in t}, nearest(p, 2)
            tris += [(i, *map(int, near[i])) for i in range(n) if i not in used]
        lap, e = (cover_laplacian(p, tris), cover_edges(p, soup(p, 4))) if c.intrinsic else (cotan(p, tris), edges_of(soup(p, 4)))
        h, want = np.zeros((len(e), n)), np.zeros((len(e), 3))
        for row, (i, j) in enumerate(e):
            d = p[i] - p[j]
            h[row, [i, j]] = 1, -1
            want[row] = d * min(1, c.max_distance * span / np.linalg.norm(d))
        a = np.concatenate([wl[:, None] * lap, np.diag(wh), 9 * h])
        new = np.linalg.lstsq(a, np.concatenate([np.zeros((n, 3)), wh[:, None] * p, 9 * want]), rcond=None)[0]
        ratios.append(measure(new, soup(new, c.area_knn)) / base)
        if step > 1 and ratios[-2] - ratios[-1] <= c.epsilon:
            break
        p = new
        kept.append(p)
    return p, ratios, kept


CONFIG = Config(max_iterations=3, knn=8, knn_step=2, knn_most=12, area_knn=10, sigma_radius=0.1, max_distance=0.03, tip_neighbours=12, geodesic="graph")


def test_cover_of_a_manifold_mesh_changes_nothing():
    """A regular octahedron is Delaunay: the cover's halved Laplacian is the plain one."""
    p = np.concatenate([np.eye(3), -np.eye(3)])
    tris = [(i, j, k) for i in (0, 3) for j in (1, 4) for k in (2, 5)]
    corners, sides = mesh.tufted_cover(np.array(tris), p, mollify=0.0)
    assert len(corners) == 16 and np.allclose(sides, np.sqrt(2))
    assert np.allclose(cover_laplacian(p, tris), cotan(p, tris)) and cover_area(p, tris) == pytest.approx(area(p, tris))


@pytest.mark.parametrize("k", [4, 8, 16])
def test_cover_of_a_soup_is_delaunay(k):
    p = noisy_y(7, 120)
    tris = soup(p, k)
    corners, sides = mesh.tufted_cover(np.array(tris), p, mollify=0.0)
    assert len(corners) == 2 * len(tris) and cover_area(p, tris) == pytest.approx(area(p, tris), rel=1e-3)
    plain = np.sqrt(np.maximum((sides.sum(axis=1) / 2) * np.prod(sides.sum(axis=1, keepdims=True) / 2 - sides, axis=1), 0)).sum() / 2 / len(p)
    assert plain == pytest.approx(area(p, tris), rel=1e-6)  # flips keep the surface
    lap = cover_laplacian(p, tris)
    assert np.allclose(lap.sum(axis=1), 0, atol=1e-6) and (lap - np.diag(np.diag(lap))).min() > -1e-6
    assert mesh.tufted_cover(np.empty((0, 3), dtype=np.int64), p)[0].shape == (0, 3)


def test_mollified_edges_keep_thin_triangles():
    p = np.array([[0.0, 0, 0], [1, 0, 0], [0.5, 0, 0], [0.5, 1e-13, 0]])
    corners, sides = mesh.tufted_cover(np.array([[0, 1, 2], [0, 1, 3], [2, 2, 3]]), p)
    assert len(corners) == 4 and (sides.sum(axis=1) - 2 * sides.max(axis=1) > 1e-6).all()


@pytest.mark.parametrize("intrinsic", [False, True])
def test_the_loop_against_its_twin(spark, intrinsic):
    config = replace(CONFIG, intrinsic=intrinsic)
    clouds = {"a": noisy_y(1, 150), "b": noisy_y(2, 120, 0.08)}
    rows = [(name, 10 + i, *map(float, r)) for name, p in clouds.items() for i, r in enumerate(p)]
    points, log, snapshots = contraction.contract(spark.createDataFrame(rows, POINTS), config)
    out, log, shots = points.collect(), log.collect(), snapshots.groupBy("plant_id", "iter").count().collect()
    for name, p in clouds.items():
        want, ratios, kept = twin(p, config)
        mine = sorted((r for r in log if r.plant_id == name), key=lambda r: r.iter)
        assert [r.iter for r in mine] == list(range(len(ratios) + 1)) and [r.ratio for r in mine] == pytest.approx([1.0, *ratios], abs=1e-4)
        assert len(kept) > 2 and all(b < a for a, b in zip([1.0, *ratios], ratios[: len(kept) - 1]))
        assert [r.done for r in mine] == [i >= len(kept) for i in range(len(mine))]
        got = np.array([[r.x, r.y, r.z] for r in sorted((r for r in out if r.plant_id == name), key=lambda r: r.point_id)])
        assert np.abs(got - want).max() < 1e-4
        assert sorted((r.iter, r["count"]) for r in shots if r.plant_id == name) == [(i, len(p)) for i in range(len(kept))]


def test_stacked_system_gives_the_step(spark):
    """The normal equations of the three blocks, solved densely, are what a step returns."""
    p = noisy_y(3, 60)
    points = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(p)], POINTS)
    tips_ = spark.createDataFrame([("a", 0), ("a", 7)], "plant_id string, point_id long")
    weights = contraction.initial_weights(points, tips_).withColumn("wl", F.lit(2.0))
    lap = mesh.laplacian(mesh.local_triangles(points, 8), points).cache()
    con = contraction.distance_constraints(points, 0.05).cache()
    a, b = contraction.stacked_system(points, weights, lap, con)
    assert {r.block for r in a.select("block").distinct().collect()} == {0, 1, 2}
    m, v = np.zeros((60, 60)), np.zeros((60, 3))
    for r in contraction.normal_matrix(a).collect():
        m[r.row, r.col] = r.val
    for r in contraction.normal_rhs(a, b).collect():
        v[r.row] = r.bx, r.by, r.bz
    got = np.array([[r.x, r.y, r.z] for r in contraction.contract_once(points, weights, lap, con).orderBy("point_id").collect()])
    assert np.allclose(got, np.linalg.solve(m, v), atol=1e-5)
    size = contraction.mean_row_size(lap.where("row < 30"), points).first().mean_row_size
    assert size == pytest.approx(lap.where("row < 30").count() / 60)


def test_heat_distances_grow_along_a_sheet(spark):
    side = np.arange(15) / 10
    grid = [("s", 15 * i + j, float(x), float(y), float(0.02 * np.sin(9 * x))) for i, x in enumerate(side) for j, y in enumerate(side)]
    far = [("s", 900 + i, 50.0 + i % 3, 50.0 + i // 3, float(i % 2)) for i in range(9)]
    points = spark.createDataFrame(grid + far, POINTS)
    start = spark.createDataFrame([("s", 0)], "plant_id string, point_id long")
    got = {r.point_id: r.value for r in contraction.heat_distance(points, start).collect()}
    assert set(got) == {r[1] for r in grid} and got[0] == 0
    error = [abs(got[r[1]] - np.hypot(r[2], r[3])) for r in grid]
    assert np.mean(error) < 0.06 and np.corrcoef([got[r[1]] for r in grid], [np.hypot(r[2], r[3]) for r in grid])[0, 1] > 0.98


def test_unfinished_distances_are_an_error(spark):
    line = spark.createDataFrame([("l", i, float(i), 0.0, 0.0) for i in range(12)], POINTS)
    start = spark.createDataFrame([("l", 0)], "plant_id string, point_id long")
    got = {r.point_id: r.value for r in contraction.graph_distance(line, start, k=2).collect()}
    assert got == {i: float(i) for i in range(12)}
    with pytest.raises(RuntimeError):
        contraction.graph_distance(line, start, k=2, max_rounds=3)


def test_unused_orphans_and_long_triangles(spark):
    p = spark.createDataFrame([("a", i, float(i % 3), float(i // 3), 0.0) for i in range(9)] + [("a", 20, 30.0, 0.0, 0.0)], POINTS)
    tris = spark.createDataFrame([("a", 0, 1, 3), ("a", 1, 4, 3), ("a", 1, 2, 20)], "plant_id string, a long, b long, c long")
    cut = spark.createDataFrame([("a", 5.0)], "plant_id string, threshold double")
    short = mesh.drop_long_triangles(tris, p, cut)
    assert sorted((r.a, r.b, r.c) for r in short.collect()) == [(0, 1, 3), (1, 4, 3)]
    whole = {r.a: (r.b, r.c) for r in mesh.attach_orphans(short, p).collect()}
    assert set(whole) == {0, 1, 2, 5, 6, 7, 8, 20} and whole[2] == (1, 5)
    assert cloud.lowest_point(p).first().point_id == 0


def test_unfinished_solves_are_errors(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 60))
    a = a @ a.T + 1e-9 * np.eye(60)
    b = rng.normal(size=(60, 1))
    with pytest.raises(ArithmeticError, match="not solved"):
        contraction.conjugate_gradients(lambda v: a @ v, b, np.zeros((60, 1)), np.diag(a), 1e-12, most=5)
    with pytest.raises(ArithmeticError, match="not solved"):
        contraction.conjugate_gradients(lambda v: a @ v, b * np.nan, np.zeros((60, 1)), np.diag(a))
    n = contraction.DENSE + 10
    coo = [("p", i, j, 1.0 if i == j else 2.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    rhs = [("p", i, float(i % 7) - 3) for i in range(n)]
    broken = contraction.solve_spd(spark.createDataFrame(coo, "plant_id string, row long, col long, val double"), spark.createDataFrame(rhs, "plant_id string, row long, b double"))
    with pytest.raises(Exception, match="not solved"):
        broken.collect()
