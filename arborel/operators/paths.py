"""Shortest paths over neighbour graphs, a patch of points at a time instead of a hop."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.operators.cells import Cells
from arborel.operators.spatial import knn_join
from arborel.scratch import discard, materialize

#: Points of a patch: a task's unit of work, some 0.5 MB with 8 neighbours each.
PATCH = 4096


def _settle(value: np.ndarray, front: list[tuple[float, int]], a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """value lowered from the front (new value, item) along the edges; the items that fell."""
    order = np.argsort(a, kind="stable")
    begin = np.searchsorted(a[order], np.arange(len(value) + 1)).tolist()
    b, w = b[order].tolist(), w[order].tolist()
    best, fell, heap = value.tolist(), set(), []
    for new, at in front:
        if new < best[at]:
            best[at] = new
            fell.add(at)
            heap.append((new, at))
    heapq.heapify(heap)
    while heap:
        new, at = heapq.heappop(heap)
        if new > best[at]:
            continue
        for e in range(begin[at], begin[at + 1]):
            far = new + w[e]
            if far < best[b[e]]:
                best[b[e]] = far
                fell.add(b[e])
                heapq.heappush(heap, (far, b[e]))
    value[:] = best
    return np.array(sorted(fell), dtype=np.int64)


def patches(points: DataFrame, most: int = PATCH) -> DataFrame:
    """(plant_id, patch, point_id): the cells of a k-d partition; cells of more equal points are dealt out by id."""
    cells = Cells(points, most)
    parts = F.ceil(F.col("n") / F.lit(most))
    sized = cells.filed.join(cells.leaves.select("plant_id", "node", "n"), ["plant_id", "node"])
    return sized.select("plant_id", F.concat_ws(":", "node", F.pmod(F.xxhash64("point_id"), parts)).alias("patch"), "point_id")


def shortest_paths(points: DataFrame, edges: DataFrame, start: DataFrame, patch: int = PATCH, max_rounds: int = 1000) -> DataFrame:
    """(plant_id, point_id, value): shortest paths from start(plant_id, point_id) along edges(plant_id, a, b, w), both ways.

    Points of all plants are dealt into patches of at most `patch` points. A round sends what fell
    at the borders of patches across the edges between them, and every patch reached settles all
    its own points at once, so that rounds count the borders a path crosses, not its hops. A task
    holds one patch with the edges inside it, which should be few a point on average. A path of equal
    hops is summed in the same order as hop by hop, so values are those of graph_distance. Points
    that cannot be reached are left out, starts that are no points are ignored, no weight may be
    negative; unfinished distances after max_rounds are an error.
    """
    spark = points.sparkSession
    kind = dict(points.dtypes)["plant_id"]
    owner = materialize(patches(points, patch), "path-patches")
    both = edges.select("plant_id", "a", "b", "w").unionByName(edges.select("plant_id", F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> b")
    both = both.groupBy("plant_id", "a", "b").agg(F.min("w").alias("w"))
    for end in "ab":
        both = both.join(owner.select("plant_id", F.col("point_id").alias(end), F.col("patch").alias(f"{end}_patch")), ["plant_id", end])
    both = materialize(both, "path-edges")
    crossing = both.where("a_patch <> b_patch")
    key = ["plant_id", "patch"]
    inner = both.where("a_patch = b_patch").groupBy("plant_id", F.col("a_patch").alias("patch")).agg(F.collect_list(F.struct("a", "b", "w")).alias("e"))
    border = crossing.groupBy("plant_id", F.col("a_patch").alias("patch")).agg(F.collect_set("a").alias("border"))
    packed = owner.groupBy(*key).agg(F.sort_array(F.collect_list("point_id")).alias("ids")).join(inner, key, "left").join(border, key, "left")
    packed = materialize(packed.select(*key, "ids", F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.w").alias("w"), "border"), "path-packed")

    def run(batches):
        for pdf in batches:
            rows = []
            for plant, name, ids, a, b, w, border, known, news in pdf.itertuples(index=False, name=None):
                ids = np.asarray(ids)
                a, b, w = (np.empty(0, dtype=t) if v is None else np.asarray(v) for v, t in ((a, int), (b, int), (w, float)))
                value = np.full(len(ids), np.inf) if known is None else np.array(known, dtype=float)
                front = [(r["value"], int(np.searchsorted(ids, r["point_id"]))) for r in news]
                fell = _settle(value, front, np.searchsorted(ids, a), np.searchsorted(ids, b), w)
                fell = fell[np.isin(ids[fell], [] if border is None else border)]
                rows.append((plant, name, value, ids[fell], value[fell]))
            yield pd.DataFrame(rows, columns=["plant_id", "patch", "known", "out_id", "out_value"])

    news = start.select("plant_id", F.col("point_id").cast("long")).distinct().join(owner, ["plant_id", "point_id"])
    news = materialize(news.select(*key, "point_id", F.lit(0.0).alias("value")), "path-news")
    state = spark.createDataFrame([], f"plant_id {kind}, patch string, known array<double>")
    for _ in range(max_rounds):
        if news.isEmpty():
            done = packed.join(state, key).select("plant_id", F.explode(F.arrays_zip("ids", "known")).alias("p"))
            return done.select("plant_id", F.col("p.ids").alias("point_id"), F.col("p.known").alias("value")).where("value < double('Infinity')")
        asked = news.groupBy(*key).agg(F.collect_list(F.struct("point_id", "value")).alias("news"))
        active = packed.join(asked, key).join(state, key, "left").select(*key, "ids", "a", "b", "w", "border", "known", "news")
        settled = materialize(active.mapInPandas(run, f"plant_id {kind}, patch string, known array<double>, out_id array<long>, out_value array<double>"), "path-settled")
        moved = settled.select("plant_id", F.explode(F.arrays_zip("out_id", "out_value")).alias("o")).select("plant_id", F.col("o.out_id").alias("a"), F.col("o.out_value").alias("value"))
        sent = moved.join(crossing, ["plant_id", "a"]).groupBy("plant_id", F.col("b_patch").alias("patch"), F.col("b").alias("point_id")).agg(F.min(F.col("value") + F.col("w")).alias("value"))
        before = (news, state)
        news = materialize(sent, "path-news")
        state = materialize(state.join(settled, key, "left_anti").unionByName(settled.select(*key, "known")), "path-state")
        discard(settled, *before)
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")


def patch_distance(points: DataFrame, start: DataFrame, k: int = 8, patch: int = PATCH, max_rounds: int = 1000, near: DataFrame | None = None) -> DataFrame:
    """(plant_id, point_id, value): graph_distance in rounds of patches, see shortest_paths.

    near is a knn_join of the points with at least k neighbours, where one is at hand.
    """
    near = materialize(knn_join(points, points, k, exclude_self=True), "path-near", merged=True) if near is None else near.where(F.col("rank") <= k)
    return shortest_paths(points, near.select("plant_id", F.col("point_id").alias("a"), F.col("nbr_id").alias("b"), F.sqrt("d2").alias("w")), start, patch, max_rounds)
