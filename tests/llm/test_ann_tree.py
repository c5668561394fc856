"""Tree search against brute force."""

import math
import os
import random

import numpy as np
import pytest

from arborel.llm import ann_tree
from arborel.llm.ann_tree import Tree, _unit, cosine, search

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, leaf string, score int"


def brute(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            ids = np.array([i for i, _ in rows if i != q])
            pts = np.array([p for i, p in rows if i != q], dtype=np.float64)
            score = cosine(pts, np.array(v, dtype=np.float64)) if len(pts) else np.array([])
            order = np.lexsort((ids, -score))[:k] if len(pts) else []
            out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_search_finds_neighbours_ties_and_skips_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK", 64)
    monkeypatch.setattr(ann_tree, "ASK_BLOCK", 8)
    monkeypatch.setattr(ann_tree, "CELLS", 5)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 12))
    good = [(i, np.float32(centers[i % 20] + 0.5 * rng.normal(size=12)).tolist()) for i in range(1500)]
    good += [(2000 + i, good[100][1]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    bad = [(5000, None), (5050, [0.0] * 12), (5100, [nan] + [1.0] * 11), (5150, [inf] + [1.0] * 11), (5200, [None] + [1.0] * 11), (5250, []), (5300, [1.0] * 7), (None, [1.0] * 12)]
    rows = [(i, v, "x", 1) for i, v in good + bad]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in search(df, lambda c: c % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(good, {i for i, _ in good if i % 50 == 0}, 5)
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1)) and len({v for _, v, _ in near}) == 5
        hits += len({v for _, v, _ in near} & {v for v, _ in want[q]})
    assert hits / (5 * len(want)) >= 0.9
    assert [(v, s) for _, v, s in got[100]] == want[100] and [v for v, _ in want[100]] == [2000, 2001, 2002, 2003, 2004]


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", 1), (1, [1.0, 1.0], "", 1), (50, [0.0, 2.0], "", 1)], SCHEMA)
    rows = sorted(map(tuple, search(df, lambda c: c % 50 == 0).collect()))
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert math.isclose(rows[0][3], math.sqrt(0.5))
    assert search(df.limit(0), lambda c: c % 50 == 0).count() == 0
    assert search(df.where("vec_id = 0"), lambda c: c % 50 == 0).count() == 0


@pytest.mark.parametrize("depth", [1, 3])
def test_the_tree_grows_with_the_table(spark, monkeypatch, depth):
    """Leaves beyond LEAF_MOST get trees of their own, level by level, and recall holds."""
    for name, value in (("LEAF_MOST", 100), ("SUB_SAMPLE", 200), ("BLOCK", 100), ("ASK_BLOCK", 7), ("DEPTH", depth)):
        monkeypatch.setattr(ann_tree, name, value)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 8))
    rows = [(i, np.float32(centers[i % 40] + 0.3 * rng.normal(size=8)).tolist(), "", 1) for i in range(6000)] + [(7000 + i, [1.0] * 8, "", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = ann_tree.Index(ann_tree.usable(df, "vec_id", "embedding"), ann_tree.fit_top(ann_tree.usable(df, "vec_id", "embedding"), 500)[0])
    assert 1 <= len(index.levels) <= depth and index.filed.count() == len(rows) and index.filed.select("vec_id").distinct().count() == len(rows)
    if depth > 1:
        assert index.sizes.where("n > 100").count() == 1  # equal vectors cannot be split
    got = {}
    for r in search(df, lambda c: c % 50 == 0, sample=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute([r[:2] for r in rows], {r[0] for r in rows if r[0] % 50 == 0}, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_recall_on_embeddings(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.select("vec_id", "embedding").collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = {}
    for r in ann_tree.op9_nearest_neighbours(spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9
    scores = {q: dict(w) for q, w in want.items()}
    assert all(math.isclose(s, scores[q][v], rel_tol=1e-12) for q in got for v, s in got[q] if v in scores[q])


def test_small_leaves_give_k(spark, monkeypatch):
    monkeypatch.setattr(ann_tree.Index, "calibrate", lambda self, *args: 1)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    rows = [(i, np.float32(centers[i % 12] + 0.01 * rng.normal(size=8)).tolist(), "", 1) for i in range(600)]
    rows += [(1000 + i, np.float32(np.eye(8)[i] * -9).tolist(), "", 1) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in search(df, lambda c: c >= 500).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {i for i, *_ in rows if i >= 500}
    assert all(len(near) == 5 and q not in near for q, near in got.items())


def test_sample_is_cut_by_hash(spark, monkeypatch):
    seen = []

    class Seen(Tree):
        def __init__(self, points):
            seen.extend(np.arctan2(points[:, 1], points[:, 0]) * 2000)
            super().__init__(points)

    monkeypatch.setattr(ann_tree, "Tree", Seen)
    df = spark.createDataFrame([(i, [math.cos(i / 2000), math.sin(i / 2000)], "", 1) for i in range(2000)], "vec_id long, vector array<double>, leaf string, score int")
    ann_tree.fit_top(df, sample=500)
    assert len(seen) == 500 and sum(i > 1899.5 for i in seen) >= 10


def test_visits_widen_with_the_target(spark):
    points = _unit(np.random.default_rng(0).normal(size=(4000, 16)))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, vector array<double>")
    tree, _, queries, n = ann_tree.fit_top(df)
    index = ann_tree.Index(df, tree)
    assert n == 4000 and index.calibrate(queries, 5, 0.5) < index.calibrate(queries, 5, 0.95) <= tree.n_leaves
    assert sorted(leaf for _, leaf in tree.visit(points[0], tree.n_leaves)) == list(range(tree.n_leaves))
    assert Tree(np.repeat(points[:1], 500, axis=0)).n_leaves == 1


def test_recall_beyond_the_first_look(spark, monkeypatch):
    """Where true neighbours lie beyond the leaves looked at first, calibration looks on."""
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist(), "", 1) for i, v in enumerate(np.float32(rng.normal(size=(1200, 24))))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([r[:2] for r in rows], {i for i in range(0, 1200, 50)}, 5)
    used = ann_tree.usable(df, "vec_id", "embedding")
    top, _, queries, _ = ann_tree.fit_top(used)
    index = ann_tree.Index(used, top)
    full = index.calibrate(queries, 5, 0.97)
    assert full > 8
    monkeypatch.setattr(ann_tree, "FIRST_LOOK", 2)
    assert index.calibrate(queries, 5, 0.97) == full and index.recall >= 0.97
    got = {}
    for r in search(df, lambda c: c % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0], "", 1), (50, [0.0, 1.0], "", 1), (1, [0.1, 1.0], "", 1), (1, [0.0, 2.0], "", 1), (2, [1.0, 0.1], "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.rank, r.vec_id, round(r.score, 6)) for r in search(df, lambda c: c % 50 == 0).collect())
    assert got == [(1, 1, 1.0), (2, 1, round(1 / math.sqrt(1.01), 6)), (3, 2, round(0.1 / math.sqrt(1.01), 6))]
