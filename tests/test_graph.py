import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arborel.operators import graph as G
from arborel.operators.cells import Cells

V, E = "plant_id string, vertex_id long, x double, y double, z double", "plant_id string, src long, dst long"


def random_tree(n, rng):
    return [(rng.randrange(max(0, i - 4), i), i) for i in range(1, n)]


def frames(spark, trees):
    rng = random.Random(1)
    vertices = [(p, i, rng.random(), rng.random(), rng.random()) for p, (n, _) in trees.items() for i in range(n)]
    edges = [(p, a, b) for p, (_, es) in trees.items() for a, b in es]
    return vertices, spark.createDataFrame(vertices, V), spark.createDataFrame(edges, E)


def links(es):
    out = defaultdict(set)
    for a, b in es:
        out[a].add(b)
        out[b].add(a)
    return out


def walk(near, tip):
    """From a tip over vertices of degree up to 2: the path, and whether it met a junction."""
    path, at = [tip], tip
    while True:
        step = [v for v in near[at] if v not in path]
        if not step:
            return path, False
        if len(near[step[0]]) > 2:
            return path, True
        at = step[0]
        path.append(at)


TREES = {f"t{k}": (n, random_tree(n, random.Random(k))) for k, n in enumerate((2, 7, 25, 40, 60))} | {"line": (12, [(i, i + 1) for i in range(11)]), "y": (9, [(0, 1), (1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (6, 7), (7, 8)])}


def test_prune_by_chain_size(spark):
    _, v, e = frames(spark, TREES)
    for ratio in (0.05, 0.15):
        got = defaultdict(set)
        for r in G.kept_after_pruning(v, e, ratio).collect():
            got[r.plant_id].add(r.vertex_id)
        for p, (n, es) in TREES.items():
            near, most = links(es), math.ceil(ratio * n)
            gone = {x for t in range(n) if len(near[t]) == 1 for path in [walk(near, t)[0]] if len(path) <= most for x in path}
            assert got[p] == set(range(n)) - gone
    kept, edges = G.prune(v, e, 0.15)
    ids = {r.plant_id: r.m for r in kept.groupBy("plant_id").agg({"vertex_id": "max"}).withColumnRenamed("max(vertex_id)", "m").collect()}
    assert all(r.dst <= ids[r.plant_id] for r in edges.collect())


def test_labels_paths_and_edges(spark):
    rows, v, e = frames(spark, TREES)
    z = {(r[0], r[1]): r[4] for r in rows}
    labels = {(r.plant_id, r.vertex_id): (r.semantic, r.instance) for r in G.vertex_labels(v, e).collect()}
    paths = defaultdict(dict)
    for r in G.leaf_paths(v, e).collect():
        paths[r.plant_id, r.branch_id][r.pos] = r.vertex_id
    for p, (n, es) in TREES.items():
        near, low = links(es), min(range(n), key=lambda i: (z[p, i], i))
        want, k = {i: (0, -1) for i in range(n)}, 0
        for tip in range(n):
            path, met = walk(near, tip) if len(near[tip]) == 1 else ([], False)
            if met and tip != low:
                assert [paths[p, k][i] for i in range(len(path))] == path
                want |= {x: (1, k) for x in path}
                k += 1
        assert {i: labels[p, i] for i in range(n)} == want
    out = {(r.plant_id, r.src, r.dst): (r.semantic, r.instance) for r in G.edge_labels(e, G.vertex_labels(v, e)).collect()}
    for (p, a, b), (semantic, instance) in out.items():
        assert instance == max(labels[p, a][1], labels[p, b][1]) and semantic == (instance >= 0)


def test_two_leaves_on_one_edge_are_an_error(spark):
    labels = spark.createDataFrame([("p", 0, 0), ("p", 1, 1)], "plant_id string, vertex_id long, instance int")
    with pytest.raises(Exception, match="two leaves"):
        G.edge_labels(spark.createDataFrame([("p", 0, 1)], E), labels).collect()


def test_boruvka_is_kruskal(spark):
    rng = random.Random(8)
    rows = [(p, a, b, rng.choice([1.0, 2.0, rng.random()])) for p in "pq" for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.3]
    want = set()
    for p in "pq":
        root = list(range(30))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for w, a, b in sorted((w, a, b) for q, a, b, w in rows if q == p):
            if top(a) != top(b):
                root[top(a)] = top(b)
                want.add((p, a, b, w))
    got = {tuple(r) for r in G.minimum_spanning_tree(spark.createDataFrame(rows, E + ", weight double")).collect()}
    assert got == want


def test_euclidean_tree_is_prims(spark):
    rng = random.Random(5)
    rows = [(p, i, rng.gauss(0, s), rng.gauss(0, s), rng.gauss(0, 1)) for p, n, s in (("a", 60, 1), ("b", 25, 0.01), ("c", 2, 1), ("d", 1, 1)) for i in range(n)]
    rows += [("e", i, float(i % 5), float(i // 5), 0.0) for i in range(20)] + [("f", i, 0.0, 0.0, 0.0) for i in range(3)] + [("g", i, 1.0 * i if i < 9 else 500.0, 0.0, 0.0) for i in range(10)]
    p = spark.createDataFrame(rows, "plant_id string, point_id long, x double, y double, z double")
    want = {tuple(r) for r in G.point_spanning_tree(p).collect()}
    assert len(want) == 59 + 24 + 1 + 19 + 2 + 9
    for kernel in (0, 1000):
        assert {tuple(r) for r in G.euclidean_tree(p, kernel=kernel).collect()} == want
    assert G.euclidean_tree(p.limit(0)).count() == 0


def shapes(n, rng):
    """Even, clustered and outlying clouds, and parallel needles, whose nearest points are many alike."""
    even = [(rng.random(), rng.random(), rng.random()) for _ in range(n)]
    balls = [(9.0 * (i % 3) + rng.gauss(0, 0.05), 4.0 * (i % 5) + rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for i in range(n)]
    apart = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n - 1)] + [(3e4, 3e4, 3e4)]
    needles = [(9.0 * (i % 3) + rng.gauss(0, 0.01), 4.0 * (i % 5) + rng.gauss(0, 0.01), rng.gauss(0, 1)) for i in range(n)]
    return {"even": even, "balls": balls, "apart": apart, "needles": needles}


def test_pairs_looked_at_stay_few(spark, monkeypatch):
    """Below 100 a point on all shapes, candidates and searches of all rounds together."""
    n = 1000
    rows = [(p, i, *xyz) for p, cloud in shapes(n, random.Random(4)).items() for i, xyz in enumerate(cloud)]
    df = spark.createDataFrame(rows, "plant_id string, point_id long, x double, y double, z double")
    looked = {p: 0 for p in shapes(2, random.Random(0))}

    def count(visits, leaves):
        for r in visits.join(leaves.select("plant_id", "node", "n"), ["plant_id", "node"]).groupBy("plant_id").agg(F.sum("n").alias("n")).collect():
            looked[r.plant_id] += r.n

    visits, discard = Cells.visits, G.discard

    def counted(self, asks):
        out = visits(self, asks)
        count(asks.join(self.filed.select("plant_id", F.col("point_id").alias("q_id"), "node"), ["plant_id", "q_id"]), self.leaves)  # own cells
        count(out, self.leaves)
        leaves.append(self.leaves)
        return out

    def watched(*tables):
        for t in tables:
            # the last front of a round names the leaves searched
            if len(tables) > 2 and "tree-front" in getattr(t, "_scratch_path", ""):
                count(t.withColumnRenamed("parent", "node"), leaves[0])
        discard(*tables)

    leaves = []
    monkeypatch.setattr(Cells, "visits", counted)
    monkeypatch.setattr(G, "discard", watched)
    got = {tuple(r) for r in G.euclidean_tree(df, kernel=0).collect()}
    print({p: v / n for p, v in looked.items()})
    assert all(v < 100 * n for v in looked.values())
    monkeypatch.undo()
    assert got == {tuple(r) for r in G.point_spanning_tree(df).collect()} and len(got) == 4 * (n - 1)


def test_components_and_projection(spark):
    v = spark.createDataFrame([("p", i, float(i), 0.0, 0.0) for i in range(6)], V)
    e = spark.createDataFrame([("p", 0, 1), ("p", 1, 2), ("p", 4, 5)], E)
    assert {r.vertex_id: r.component for r in G.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    points = spark.createDataFrame([("p", 0, 0.6, 0.0, 0.0), ("p", 1, 4.4, 1.0, 0.0)], "plant_id string, point_id long, x double, y double, z double")
    labels = spark.createDataFrame([("p", i, i - 1) for i in range(6)], "plant_id string, vertex_id long, instance int")
    got = {r.point_id: (r.instance, r.semantic) for r in G.project_labels(points, v, labels).collect()}
    assert got == {0: (0, 1), 1: (3, 1)}
    edges = e.selectExpr("*", "cast(dst - 2 as int) as instance")
    assert {r.point_id: r.instance for r in G.project_labels_by_edge(points, v, edges).collect()} == {0: -1, 1: 3}
