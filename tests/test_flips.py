"""Flips by tables against the kernel that takes a plant in one task."""

import numpy as np
import pytest

from arborel.operators import flips, mesh

POINTS = "plant_id string, point_id long, x double, y double, z double"
TRIS = "plant_id string, a long, b long, c long"


def soup(seed):
    """A random soup: triangles of near points, some of them repeated, some shared edges, two kinds of numbering."""
    rng = np.random.default_rng(seed)
    n = 12 + seed
    p = rng.random((n, 3)) * (1, 1, 0.2 + 0.1 * (seed % 3))
    tris = set()
    for i in range(n):
        near = np.argsort(((p - p[i]) ** 2).sum(axis=1))[1:7]
        tris |= {(i, int(near[a]), int(near[b])) for a, b in mesh.one_ring(p[i], p[near])}
    return p, sorted(tris)


def canonical(corners, lengths):
    """Faces from their least corner on, as sorted rows of corners and rounded lengths."""
    rows = []
    for t, s in zip(corners, lengths):
        turns = [tuple(int(t[(k + i) % 3]) for i in range(3)) + tuple(round(float(s[(k + i) % 3]), 7) + 0.0 for i in range(3)) for k in range(3)]
        rows.append(min(turns))
    return sorted(rows)


def test_twenty_random_soups_against_the_kernel(spark):
    soups = {f"s{seed}": soup(seed) for seed in range(20)}
    ids = {name: 5 + 3 * np.arange(len(p)) for name, (p, _) in soups.items()}
    points = spark.createDataFrame([(name, int(ids[name][i]), *map(float, r)) for name, (p, _) in soups.items() for i, r in enumerate(p)], POINTS)
    rows = [(name, *(int(ids[name][v]) for v in t)) for name, (_, tris) in soups.items() for t in tris]
    tris = spark.createDataFrame(rows + [("s0", 5, 5, 8)], TRIS)
    flipped = flips.delaunay_cover(tris, points).toPandas()
    moved = 0
    for name, (p, t) in soups.items():
        corners, lengths = mesh.tufted_cover(np.array(t), p)
        mine = flipped[flipped["plant_id"] == name]
        assert canonical(mine[["a", "b", "c"]].to_numpy(), mine[["ab", "bc", "ca"]].to_numpy()) == canonical(ids[name][corners], lengths)
        start = {frozenset(x) for x in t}
        moved += sum(frozenset(map(int, c)) not in start for c in corners)
    assert moved > 100


def test_large_plants_go_through_tables(spark):
    p, t = soup(9)
    points = spark.createDataFrame([(n, i, *map(float, r)) for n in ("a", "b") for i, r in enumerate(p if n == "a" else p[:3])], POINTS)
    tris = spark.createDataFrame([("a", *x) for x in t] + [("b", 0, 1, 2)], TRIS)
    both = mesh.intrinsic(tris, points, one_task=10).toPandas()
    plain = mesh.intrinsic(tris, points).toPandas()
    for name in ("a", "b"):
        x, y = (df[df["plant_id"] == name] for df in (both, plain))
        assert canonical(x[["a", "b", "c"]].to_numpy(), x[["ab", "bc", "ca"]].to_numpy()) == canonical(y[["a", "b", "c"]].to_numpy(), y[["ab", "bc", "ca"]].to_numpy())
    with pytest.raises(RuntimeError):
        flips.delaunay_cover(tris, points, max_rounds=1)
    assert flips.delaunay_cover(tris.limit(0), points).count() == 0
