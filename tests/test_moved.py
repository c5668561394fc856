"""What trees and partitions send: no pairs of a graph, no long trees of small cells, no tables that grow through the driver."""

import random

from pyspark.sql import functions as F

from arborel.operators import graph as G
from arborel.operators.cells import LEVELS, Cells
from arborel.plans import trees
from arborel.scratch import materialize

POINTS = "plant_id string, point_id long, x double, y double, z double"


def cloud(spark, n, plants=("a", "b")):
    rng = random.Random(6)
    return spark.createDataFrame([(p, i, rng.random(), rng.random(), rng.random()) for p in plants for i in range(n)], POINTS)


def test_trees_of_small_cells_are_short(spark, monkeypatch):
    monkeypatch.setattr("arborel.operators.cells.SAMPLE", 100)
    cells = Cells(cloud(spark, 600), 8)
    assert len(cells.trees) > 1 and cells.leaves.where("n > 8").count() == 0
    assert cells.trees[-1].agg(F.max(F.size("axes"))).first()[0] < 1 << (LEVELS - 4)


def test_boruvka_lists_no_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(3)], i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = G.minimum_spanning_tree(trees._graph(spark, str(tmp_path))).select("plant_id", "src", "dst", F.round("weight", 6))
    want = {tuple(r) for r in want.collect()}

    def none(*_):
        raise AssertionError("pairs were listed")

    monkeypatch.setattr(G, "radius_join", none)
    assert {tuple(r) for r in trees.mst_boruvka(spark, str(tmp_path)).collect()} == want and len(want) == 58


def test_patches_tell_the_tree_and_what_it_joins(spark, monkeypatch):
    monkeypatch.setattr(G, "PATCH", 64)
    monkeypatch.setattr(G, "AROUND", 256)
    p = cloud(spark, 400, ("a",))
    sure, comps = G._sure_edges(p)
    tree = {(r.src, r.dst) for r in G.point_spanning_tree(p).collect()}
    told = {(r.e.src, r.e.dst) for r in sure.collect()}
    of = {r.point_id: r.comp for r in comps.collect()}
    assert told <= tree and len(told) > 300 and len(of) == 400
    assert all(of[a] == of[b] for a, b in told) and len(set(of.values())) == 400 - len(told)


def test_tables_that_grow_are_merged(spark):
    left, right = (materialize(spark.range(100).withColumn(c, F.col("id")), "moved", merged=True) for c in "ab")
    joined = left.select("id", "a").join(right.groupBy("id").agg(F.max("b").alias("b")), "id")
    assert joined.count() == 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
