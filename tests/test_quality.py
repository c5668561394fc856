import math
import random

import numpy as np
import pytest

from arborel.config import Config
from arborel.operators import contraction, evaluate, mesh
from arborel.plans.stages import Run

POINTS = "plant_id string, point_id long, x double, y double, z double"


def test_greedy_takes_the_lower_id_at_half(spark):
    rows = spark.createDataFrame([("p", 1, 0, 5, 0.5), ("p", 1, 1, 5, 0.5), ("p", 1, 2, 6, 0.4), ("p", 1, 3, 7, 0.6), ("p", 1, 3, 8, 0.6)], "plant_id string, class int, pred int, gt int, iou double")
    assert sorted((r.pred, r["gt"]) for r in evaluate.greedy_matches(rows).collect()) == [(0, 5), (3, 7)]


def test_stem_rule_and_zero_rows(spark):
    rows = [("p", i, 0, -1, 0, -1) for i in range(4)] + [("p", 4 + i, 1, 0, 1, 0) for i in range(4)] + [("q", 0, 0, -1, 0, -1)]
    seg = spark.createDataFrame(rows, "plant_id string, point_id long, pred_sem int, pred_inst int, gt_sem int, gt_inst int")
    pr = {(r.plant_id, r["class"]): (r.precision, r.recall) for r in evaluate.instance_pr(seg).collect()}
    assert pr == {("p", 0): (0.0, 0.0), ("p", 1): (1.0, 1.0), ("q", 0): (0.0, 0.0), ("q", 1): (0.0, 0.0)}
    assert evaluate.instance_pr(seg, leaf_only=True).count() == 2
    overall = {r.metric: (r.mean, r.std) for r in evaluate.semantic_overall(seg.where("plant_id = 'p'")).collect()}
    assert overall["f1"] == (1.0, 0.0)


def test_skeleton_distance_of_a_known_line(spark):
    v = spark.createDataFrame([("p", 0, 0.0, 0.0, 0.0), ("p", 1, 6.0, 0.0, 0.0)], "plant_id string, vertex_id long, x double, y double, z double")
    e = spark.createDataFrame([("p", 0, 1)], "plant_id string, src long, dst long")
    cloud = spark.createDataFrame([("p", i, float(i % 7), 1.0, 0.0) for i in range(14)], POINTS)
    assert [r.x for r in evaluate.edge_samples(v, e).orderBy("s").collect()] == [float(i) for i in range(7)]
    m = evaluate.skeleton_metrics(cloud, v, e).first()
    assert (m.forward_mean, m.forward_90th, m.reverse_mean, m.chamfer) == (1.0, 1.0, 1.0, 1.0)


def test_index_percentile_with_ties(spark):
    rng = random.Random(3)
    rows = [(p, float(rng.randrange(k))) for p, n, k in (("a", 500, 7), ("b", 1, 3), ("c", 333, 10_000), ("d", 90, 1)) for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "plant_id string, v double").repartition(3)
    for share in (0.0, 0.5, 0.9):
        want = {p: sorted(v for q, v in rows if q == p and v is not None)[int(share * sum(q == p and v is not None for q, v in rows))] for p in "abcd"}
        assert {r.plant_id: r.p for r in evaluate.index_percentile(df, "v", share).collect()} == want


def test_one_ring_is_delaunay():
    rng = np.random.default_rng(4)
    for _ in range(30):
        flat = rng.normal(size=(12, 2))
        around = np.concatenate([flat, np.zeros((12, 1))], axis=1)
        got = {tuple(sorted(t)) for t in mesh.one_ring(np.zeros(3), around)}
        want = set()
        for a in range(12):
            for b in range(a + 1, 12):
                m = 2 * flat[[a, b]]
                if abs(np.linalg.det(m)) > 1e-12:
                    centre = np.linalg.solve(m, (flat[[a, b]] ** 2).sum(axis=1))
                    if all(((flat[c] - centre) ** 2).sum() > (centre**2).sum() for c in range(12) if c not in (a, b)):
                        want.add((a, b))
        assert got == want


def test_laplacian_rows_vanish_and_sphere_area(spark):
    n = 400
    k = np.arange(n) + 0.5
    phi, theta = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    xyz = np.stack([np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)], axis=1)
    p = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(xyz)], POINTS)
    soup = mesh.local_triangles(p, 12).cache()
    sums = mesh.laplacian(soup, p).groupBy("plant_id", "row").sum("val").collect()
    assert len(sums) == n and all(abs(r["sum(val)"]) < 1e-9 for r in sums)
    area = mesh.vertex_areas(soup, p).groupBy("plant_id").sum("area").first()[1]
    assert area / 3 == pytest.approx(4 * math.pi, rel=0.03)


def test_sigma_of_a_line_and_isolated_points(spark):
    rows = [("l", i, 0.0, 0.0, i * 0.01) for i in range(20)] + [("l", 50, 5.0, 5.0, 5.0), ("l", 60, 9.0, 9.0, 9.0), ("l", 61, 9.0, 9.0, 9.0), ("l", 62, 9.0, 9.0, 9.0)]
    got = {r.point_id: r.sigma for r in contraction.sigma(spark.createDataFrame(rows, POINTS), 0.05).collect()}
    assert all(got[i] == pytest.approx(1.0) for i in range(20)) and got[50] == 0.9 and got[60] is None


def test_solver(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 30))
    a, b = m @ m.T + np.eye(30), rng.normal(size=30)
    coo = spark.createDataFrame([("p", i, j, float(a[i, j])) for i in range(30) for j in range(30)], "plant_id string, row long, col long, val double")
    rhs = spark.createDataFrame([("p", i, float(b[i])) for i in range(30)], "plant_id string, row long, b double")
    x = np.array([r.x for r in contraction.solve_spd(coo, rhs).orderBy("row").collect()])
    assert np.allclose(a @ x, b, atol=1e-6)


def test_a_whole_run(spark, tmp_path):
    rng = random.Random(2)
    rows, arms = [], [((0, 0, 0), (0, 0, 1)), ((0, 0, 1), (0.5, 0, 1.5)), ((0, 0, 1), (-0.5, 0, 1.5))]
    for i in range(240):
        a, b = arms[i % 3]
        t = rng.random()
        rows.append(("y", i, *(p + t * (q - p) + rng.gauss(0, 0.01) for p, q in zip(a, b))))
    config = Config(down_sample=180, max_iterations=2, fps_ratio=0.25, knn=6, knn_most=10, area_knn=8, sigma_radius=0.05, max_distance=0.05, lop_ratio=0.08, prune_ratio=0.03, tip_neighbours=12)
    run = Run(spark.createDataFrame(rows, POINTS), config).until("result")
    assert run.tables["tree"].count() == 44 and run.tables["sampled"].count() == 45
    result = run.tables["result"]
    assert result.count() == 180 and result.where("`pred-semantic` not in (0, 1)").count() == 0
    assert run.stage_metrics().count() == 9
    log = run.tables["contracted"][1].orderBy("iter").collect()
    assert [(r.iter, r.done) for r in log[:2]] == [(0, False), (1, False)] and log[0].ratio == 1.0
    assert run.tables["contracted"][2].groupBy("iter").count().count() == sum(not r.done for r in log)
    assert run.write(str(tmp_path)).first().n == 180 and (tmp_path / "y_Result.ply").exists()
    assert Config.load((tmp_path / "config.json").read_text()) == config and run.normalization().count() == 1
    assert all((tmp_path / name / "y.ply").exists() for name in ("1_Input", "2_Sampled", "3_Calibrated", "4_Graph", "5_Tree", "6_Pruned", "7_Segmented"))
    kept = sum(not r.done for r in log)
    assert sorted(p.name for p in (tmp_path / "iterations").iterdir()) == [str(i) for i in range(kept)] and (tmp_path / "iterations" / "1" / "y_cpts_1.ply").exists()
    assert spark.read.parquet(str(tmp_path / "tables" / "tree")).count() == 44
    with pytest.raises(ValueError, match="not empty"):
        run.write(str(tmp_path))
