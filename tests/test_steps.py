"""What the queries on soups, covers and paths do once, and what their rounds look at."""

import random

import pytest
from pyspark.sql import functions as F

from arborel.operators import contraction, flips, mesh, paths, spatial
from arborel.plans import surfaces

POINTS = "plant_id string, point_id long, x double, y double, z double"


def folder(spark, path, n, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.random() for _ in range(3)], i % 2) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["stacked_rhs", "contraction_step"])
def test_a_step_joins_neighbours_once(spark, tmp_path, monkeypatch, name):
    d, calls, full = folder(spark, tmp_path, 80), [], spatial._full
    monkeypatch.setattr(spatial, "_full", lambda *a: calls.append(1) or full(*a))
    assert surfaces.__dict__[name](spark, d).count() == 80
    assert len(calls) == 1


def test_shared_neighbours_give_the_same_step(spark, tmp_path):
    d = folder(spark, tmp_path, 120)
    p, weights, lap, kept = surfaces._step(spark, d)
    soup = mesh.attach_orphans(mesh.local_triangles(p, 8), p)
    own = mesh.laplacian(soup, p), contraction.distance_constraints(p, 0.05)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in own[1].select(*kept.columns).collect()}
    round6 = lambda df: {tuple(r) for r in df.select("plant_id", "row", "col", F.round("val", 6) + F.lit(0.0)).collect()}
    assert round6(lap) == round6(own[0])


def test_rounds_of_flips_write_what_they_changed(spark, monkeypatch):
    rng = random.Random(3)
    p = spark.createDataFrame([(q, i, *(rng.random() for _ in range(3))) for q in "ab" for i in range(150)], POINTS)
    soup = mesh.local_triangles(p, 8)
    labels, write = [], flips.materialize
    monkeypatch.setattr(flips, "materialize", lambda df, label, **k: labels.append(label) or write(df, label, **k))
    faces = flips.delaunay_cover(soup, p)
    assert labels.count("flip-faces") == 1 and labels.count("flip-changed") > 1
    assert faces.count() == 2 * soup.count()
    assert mesh.intrinsic_laplacian(faces).where("row <> col and val < -1e-6").count() == 0


def test_geodesics_take_rounds_of_patches(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [i / 100.0, rng.random() / 1000, 0.0], i % 2) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    p = surfaces._plants(spark, str(tmp_path))
    want = {(r.plant_id, r.point_id): round(r.value, 6) for r in contraction.graph_distance(p, surfaces.C.lowest_point(p)).collect()}
    labels = []
    for module in (contraction, paths):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, write=write, **k: labels.append(label) or write(df, label, **k))
    got = {(r.plant_id, r.point_id): r.value for r in surfaces.geodesic_from_root(spark, str(tmp_path)).collect()}
    # hop by hop these are some 50 rounds
    assert got == want and len(got) == 400
    assert labels.count("path-settled") + labels.count("geodesic-front") < 5
