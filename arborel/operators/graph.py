"""Skeleton graphs: spanning trees, the initial graph, pruning, branches and labels.

Vertices are (plant_id, vertex_id, x, y, z), edges (plant_id, src, dst[, weight]) with
src < dst. Edges are ordered by (weight, src, dst), which makes every tree unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.geometry import dist2, segment_distance, xyz
from arborel.operators.cells import STEP, Cells, box_d2, corner_d2
from arborel.operators.components import connected_components
from arborel.operators.numbering import numbered
from arborel.operators.spatial import knn_join, nearest_join, radius_join
from arborel.scratch import discard, materialize


#: Pointer jumps between two written tables: pointers reach 2**JUMPS times as far.
JUMPS = 3
#: Points of a plant up to which its tree is made in one task.
KERNEL = 8192
#: Points of a patch whose own edges are told in one task, and of it with what lies around.
PATCH, AROUND = 1024, 4096


def _jump(parent: DataFrame, label: str) -> DataFrame:
    """Follow parent(plant_id, node, up) to its roots by pointer jumping."""
    while True:
        far = parent
        for _ in range(JUMPS):
            above = far.select("plant_id", F.col("node").alias("up"), F.col("up").alias("top"))
            far = far.join(above, ["plant_id", "up"]).select("plant_id", "node", F.col("top").alias("up"))
        jumped = materialize(far, label, merged=True)
        discard(parent)
        parent = jumped
        roots = parent.select("plant_id", F.col("node").alias("up"), F.col("up").alias("top"))
        if parent.join(roots, ["plant_id", "up"]).where("top <> up").limit(1).count() == 0:
            return parent


def _merge(picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen edges (plant_id, e) and roots (plant_id, node, up) of picked(plant_id, own, e, to): each component's least edge and where it leads."""
    # an edge that both its components chose joins the two: the smaller is the root
    both = picked.select("plant_id", "e", F.struct("own", "to").alias("p")).groupBy("plant_id", "e").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    node = F.explode(F.array_distinct(F.array("low", "high"))).alias("p")
    up = F.when((F.col("low") != F.col("high")) & (F.col("p") == F.col("low")), F.col("p.own")).otherwise(F.col("p.to"))
    ups = materialize(both.select("plant_id", "e", "low", "high", node).select("plant_id", "e", F.col("p.own").alias("node"), up.alias("up")), "mst-up", merged=True)
    return ups.select("plant_id", "e").distinct(), _jump(ups.select("plant_id", "node", "up"), "mst-jump")


def minimum_spanning_tree(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Boruvka's algorithm on weighted edges: the forest's (plant_id, src, dst, weight).

    Each round every component takes its least edge and follows it to a root by pointer
    jumping, so rounds grow with the logarithm of the vertices, for all plants together.
    Between components that are joined by many edges only the least goes on to the next round.
    """
    least = F.min(F.struct("weight", "src", "dst")).alias("e")
    between = edges.where("src <> dst").select("plant_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    between = between.withColumns({"ca": F.col("src"), "cb": F.col("dst")}).groupBy("plant_id", "ca", "cb").agg(least)
    between = first = materialize(between, "mst-edges", merged=True)
    tree = None
    for _ in range(max_rounds):
        if between.limit(1).count() == 0:
            break
        sides = F.explode(F.array(F.struct(F.col("ca").alias("own"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("own"), F.col("ca").alias("to")))).alias("s")
        picked = between.select("plant_id", sides, "e").groupBy("plant_id", "s.own").agg(F.min_by(F.struct("e", "s.to"), "e").alias("m"))
        chosen, roots = _merge(picked.select("plant_id", "own", "m.e", "m.to"))
        chosen = chosen.select("plant_id", "e.src", "e.dst", "e.weight")
        tree = chosen if tree is None else tree.unionByName(chosen)
        for end in ("ca", "cb"):
            between = between.join(roots.select("plant_id", F.col("node").alias(end), F.col("up").alias(f"new_{end}")), ["plant_id", end]).drop(end).withColumnRenamed(f"new_{end}", end)
        low, high = F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")
        between = materialize(between.where("ca <> cb").select("plant_id", low, high, "e").groupBy("plant_id", "ca", "cb").agg(F.min("e").alias("e")), "mst-edges", merged=True)
        discard(roots)
    else:
        raise RuntimeError(f"the tree is not finished after {max_rounds} rounds")
    if tree is None:
        return first.select("plant_id", "e.src", "e.dst", "e.weight").limit(0)
    return tree.distinct()


def euclidean_tree(points: DataFrame, k: int = 3, kernel: int | None = None) -> DataFrame:
    """The tree of all pairs of each plant's points: (plant_id, src, dst, weight); ties by (distance, src, dst).

    Plants up to `kernel` points (KERNEL) are a task each; larger ones go through foreign_tree, where no
    task holds a plant. Points without finite coordinates should be filtered first.
    """
    most = KERNEL if kernel is None else kernel
    points = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"])
    sizes = materialize(points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
    large = sizes.where(F.col("n") > most).select("plant_id")
    if large.isEmpty():
        return point_spanning_tree(points)
    small = points.join(large, "plant_id", "left_anti")
    return foreign_tree(points.join(large, "plant_id", "left_semi"), k).unionByName(point_spanning_tree(small))


def foreign_tree(points: DataFrame, k: int = 3, max_rounds: int = 60) -> DataFrame:
    """euclidean_tree by Boruvka's rounds on a k-d partition, without listing pairs of a plant.

    In a round every component needs the nearest pair to a point of another. The k nearest
    neighbours of each point give candidates. Only points all of whose neighbours are of their own
    component, and nearer than the component's candidate, are searched for: they walk down the
    partition's boxes, past boxes that hold nothing but their own component and those beyond
    the bound, which falls at every level to the nearest far corner of a box with a foreign point.
    Equal points are chained by id first and stand for each other through the smallest. The
    rounds begin with the components of the edges that patches of points are sure of.
    """
    points = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"])
    same = ["plant_id", "x", "y", "z"]
    marked = points.join(points.groupBy(*same).agg(F.min("point_id").alias("first")).hint("merge"), same)
    marked = materialize(marked.select("plant_id", "point_id", "first", "x", "y", "z"), "tree-points", merged=True)
    # of equal points the edges of least ids are those to the smallest
    chain = marked.where("point_id <> first").select("plant_id", F.struct(F.lit(0.0).alias("d2"), F.col("first").alias("src"), F.col("point_id").alias("dst")).alias("e"))
    single = marked.where("point_id = first").drop("first")
    cells = Cells(single, max(8, 2 * (k + 1)))
    near = knn_join(single, single, k, exclude_self=True, brute=0)
    near = materialize(near.select("plant_id", "point_id", "nbr_id", "d2"), "tree-near", merged=True)
    sure, comps = _sure_edges(single)
    state = cells.filed.drop("depth").join(comps, ["plant_id", "point_id"], "left").withColumn("comp", F.coalesce("comp", "point_id"))
    state = materialize(state, "tree-state", merged=True)
    levels = materialize(_ancestors(cells), "tree-levels", merged=True)
    tree = chain.unionByName(sure)
    for _ in range(max_rounds):
        picked = _nearest_foreign(cells, levels, state, near)
        if picked is None:
            out = tree.select("plant_id", "e.src", "e.dst", F.sqrt("e.d2").alias("weight"))
            return out
        chosen, roots = _merge(picked)
        tree = tree.unionByName(materialize(chosen, "tree-edges", merged=True))
        moved = state.join(roots.select("plant_id", F.col("node").alias("comp"), "up"), ["plant_id", "comp"])
        before, state = state, materialize(moved.withColumn("comp", F.col("up")).drop("up"), "tree-state", merged=True)
        discard(before, roots, picked)
    raise RuntimeError(f"the tree is not finished after {max_rounds} rounds")


def _sure_edges(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plant_id, e): edges (d2, src, dst) of the tree of distinct points that a patch with what lies around it can tell; (plant_id, point_id, comp) of what they join.

    A patch is a leaf of a k-d partition with the points in its box grown by a share of its
    longest side, the largest share that brings no more than AROUND points. Gone through by
    length, an edge of the patch's own tree is the least that leaves either side; it is the
    whole tree's where it is shorter than one side's way out of the grown box. A patch tells
    what its edges join as well, so that rounds of components are over patches and not hops.
    """
    cells = Cells(points, PATCH)
    side = F.greatest(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in "xyz"])
    shares = (0.0, 0.1, 0.25)
    grown = cells.leaves.withColumn("share", F.explode(F.array(*[F.lit(v) for v in shares]))).withColumn("by", side * F.col("share"))
    ends = [(F.col(f"low_{a}") - F.col("by")).alias(f"from_{a}") for a in "xyz"] + [(F.col(f"high_{a}") + F.col("by")).alias(f"to_{a}") for a in "xyz"]
    grown = materialize(grown.select("plant_id", F.col("node").alias("patch"), "share", *ends), "tree-patches")
    # the leaves that a patch's widest box meets, by a walk down the boxes
    front = grown.where(F.col("share") == shares[-1]).drop("share").withColumn("parent", F.lit(0).cast("long"))
    columns = [c for c in front.columns if c != "parent"]
    meets = " and ".join(f"low_{a} <= to_{a} and high_{a} >= from_{a}" for a in "xyz")
    for _ in range(cells.steps):
        front = front.join(cells.boxes, ["plant_id", "parent"]).where(meets).select(*columns, F.col("node").alias("parent"))
    inside = " and ".join(f"{a} >= from_{a} and {a} <= to_{a}" for a in "xyz")
    near = front.withColumnRenamed("parent", "node").join(cells.filed, ["plant_id", "node"]).where(inside)
    near = materialize(near.select("plant_id", "patch", "point_id", "x", "y", "z"), "tree-around", merged=True)
    counts = near.join(grown, ["plant_id", "patch"]).where(inside).groupBy("plant_id", "patch", "share").agg(F.count(F.lit(1)).alias("n"))
    share = F.max(F.when(F.col("n") <= AROUND, F.col("share")))
    chosen = counts.groupBy("plant_id", "patch").agg(F.coalesce(share, F.lit(0.0)).alias("share"))
    chosen = materialize(grown.join(chosen, ["plant_id", "patch", "share"]), "tree-patches")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = near.join(chosen, ["plant_id", "patch"]).where(inside).repartition(parts, "patch", "plant_id")

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        ids, p = pdf["point_id"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float)
        gaps = [p - pdf[[f"from_{a}" for a in "xyz"]].to_numpy(float), pdf[[f"to_{a}" for a in "xyz"]].to_numpy(float) - p]
        clear = (np.minimum(*gaps).min(axis=1) ** 2).tolist()
        a, b, d2 = _prim(ids, p)
        up, first, out = list(range(len(ids))), list(range(len(ids))), []

        def top(up: list, v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for i in np.lexsort((b, a, d2)):
            u, v = top(up, int(a[i])), top(up, int(b[i]))
            if d2[i] < max(clear[u], clear[v]):
                out.append(i)
                low, high = sorted((top(first, int(a[i])), top(first, int(b[i]))))
                first[high] = low
            up[v] = u
            clear[u] = min(clear[u], clear[v])
        # a row for each point, and the edges beside the first of them
        lone = np.arange(len(ids)) >= len(out)
        rows = np.pad(np.array(out, dtype=np.int64), (0, len(ids) - len(out)))
        edge = {"d2": (d2, None), "src": (a, ids), "dst": (b, ids)}
        told = {"plant_id": pdf["plant_id"].iloc[0], "point_id": ids, "first": ids[[top(first, v) for v in range(len(ids))]]}
        for name, (of, by) in edge.items():
            values = (of if by is None else by[of])[rows] if len(of) else np.zeros(len(ids), dtype=of.dtype)
            told[name] = pd.array(values, dtype="Float64" if name == "d2" else "Int64")
            told[name][lone] = pd.NA
        return pd.DataFrame(told)

    kind = dict(points.dtypes)["plant_id"]
    told = held.groupBy("plant_id", "patch").applyInPandas(tell, f"plant_id {kind}, point_id long, first long, d2 double, src long, dst long")
    told = materialize(told, "tree-told", merged=True)
    sure = materialize(told.where("src is not null").select("plant_id", F.struct("d2", "src", "dst").alias("e")).distinct(), "tree-sure", merged=True)
    # a point that patches join to several firsts links those; elsewhere its first is the component
    low = materialize(told.groupBy("plant_id", "point_id").agg(F.min("first").alias("low")), "tree-first", merged=True)
    links = told.join(low, ["plant_id", "point_id"]).where("low <> first").select("plant_id", F.col("low").alias("src"), F.col("first").alias("dst"))
    joined = connected_components(links, by=["plant_id"], merged=True).withColumnsRenamed({"id": "low", "component": "comp"}).hint("merge")
    comps = low.join(joined, ["plant_id", "low"], "left").select("plant_id", "point_id", F.coalesce("comp", "low").alias("comp"))
    return sure, comps


def _ancestors(cells: Cells) -> DataFrame:
    """(plant_id, node, above): the nodes of cells.boxes that hold each leaf, itself included."""
    kept = cells.leaves.select("plant_id", "node", "depth", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("depth"), F.lit(STEP)), F.array("depth")))).alias("level"))
    return kept.select("plant_id", "node", F.expr("shiftright(node, depth - level)").alias("above"))


def _nearest_foreign(cells: Cells, levels: DataFrame, state: DataFrame, near: DataFrame) -> DataFrame | None:
    """(plant_id, own, e, to): each component's nearest pair (d2, src, dst) and the component it leads to; None when plants are whole."""
    span = state.groupBy("plant_id", "node").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    span = span.join(levels, ["plant_id", "node"]).groupBy("plant_id", F.col("above").alias("node")).agg(F.min("low").alias("c_low"), F.max("high").alias("c_high"))
    boxes = materialize(cells.boxes.join(span, ["plant_id", "node"]), "tree-boxes", merged=True)
    open_ = boxes.where("parent = 0 and c_low <> c_high").select("plant_id")
    if open_.isEmpty():
        return None
    state = state.join(open_, "plant_id", "left_semi")
    of = state.select("plant_id", "point_id", "comp")
    theirs = of.select("plant_id", F.col("point_id").alias("nbr_id"), F.col("comp").alias("to"))
    lists = near.join(of, ["plant_id", "point_id"]).join(theirs, ["plant_id", "nbr_id"])
    edge = F.struct("d2", F.least("point_id", "nbr_id").alias("src"), F.greatest("point_id", "nbr_id").alias("dst"))
    first = F.min(F.when(F.col("to") != F.col("comp"), F.struct(edge.alias("e"), "to"))).alias("best")
    seen = materialize(lists.groupBy("plant_id", "point_id", "comp").agg(first, F.max("d2").alias("reach")), "tree-seen", merged=True)
    best = materialize(seen.where("best is not null").groupBy("plant_id", "comp").agg(F.min("best").alias("best")), "tree-best", merged=True)
    # a list without a foreign point says that those are no nearer than its last
    asks = seen.where("best is null").drop("best").join(best, ["plant_id", "comp"], "left").withColumn("bound", F.coalesce("best.e.d2", F.lit(float("inf"))))
    asks = asks.where("reach <= bound").select("plant_id", "point_id", "comp", "bound")
    at = state.select("plant_id", "point_id", *[F.col(a).alias(f"q_{a}") for a in "xyz"])
    front = materialize(asks.join(at, ["plant_id", "point_id"]).withColumn("parent", F.lit(0).cast("long")), "tree-front", merged=True)
    columns = ["plant_id", "point_id", "comp", "q_x", "q_y", "q_z", "bound"]
    foreign = (F.col("c_low") != F.col("comp")) | (F.col("c_high") != F.col("comp"))
    for _ in range(cells.steps):
        met = front.join(boxes, ["plant_id", "parent"]).where(foreign & (box_d2("q_") <= F.col("bound")))
        met = materialize(met.select(*columns, "node", box_d2("q_").alias("least"), corner_d2("q_").alias("most")), "tree-front", merged=True)
        tight = met.groupBy("plant_id", "comp").agg(F.min("most").alias("tight"))
        low = F.least("bound", "tight")
        before = front
        front = met.join(tight, ["plant_id", "comp"]).where(F.col("least") <= low).select(*columns[:-1], low.alias("bound"), F.col("node").alias("parent"), "least", "most")
        front = materialize(front, "tree-front", merged=True)
        discard(before, met)
    held = state.select("plant_id", F.col("node").alias("parent"), F.col("point_id").alias("nbr_id"), F.col("comp").alias("to"), *[F.col(a).alias(f"p_{a}") for a in "xyz"])
    d2 = dist2(xyz("q_"), xyz("p_"))
    # two leaves of each component, the nearest and the one surely near, bring its bound close to the answer
    visit = F.struct("q_x", "q_y", "q_z", "parent")
    probes = front.groupBy("plant_id", "comp").agg(F.array(F.min_by(visit, "least"), F.min_by(visit, "most")).alias("two"))
    probes = probes.select("plant_id", "comp", F.explode(F.array_distinct("two")).alias("v")).select("plant_id", "comp", "v.*")
    probed = probes.join(held, ["plant_id", "parent"]).where(F.col("to") != F.col("comp")).groupBy("plant_id", "comp").agg(F.min(d2).alias("tight"))
    low = F.least("bound", "tight")
    before = front
    front = materialize(front.join(probed, ["plant_id", "comp"], "left").where(F.col("least") <= low).select(*columns[:-1], low.alias("bound"), "parent"), "tree-front", merged=True)
    discard(before)
    pairs = front.join(held, ["plant_id", "parent"]).where((F.col("to") != F.col("comp")) & (d2 <= F.col("bound"))).withColumn("d2", d2)
    found = pairs.groupBy("plant_id", "comp").agg(F.min(F.struct(edge.alias("e"), "to")).alias("best"))
    least = best.unionByName(found).groupBy("plant_id", F.col("comp").alias("own")).agg(F.min("best").alias("b"))
    picked = materialize(least.select("plant_id", "own", "b.e", "b.to"), "tree-picked", merged=True)
    discard(front, seen, best, boxes)
    return picked


def _prim(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d2): the tree's edges, from place a to b > a of points in the order of their ids, by (d2, a, b)."""
    n = len(ids)
    best, link = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    free, places, axes = np.ones(n, dtype=bool), np.arange(n), p.T.copy()
    a, b, out = np.empty(max(0, n - 1), dtype=np.int64), np.empty(max(0, n - 1), dtype=np.int64), np.empty(max(0, n - 1))
    at = 0
    for step in range(n - 1):
        free[at] = False
        d2 = (axes[0] - axes[0, at]) ** 2 + (axes[1] - axes[1, at]) ** 2 + (axes[2] - axes[2, at]) ** 2
        nearer = free & (d2 < best)
        # equal distances: the edge with the smaller ids
        same = np.flatnonzero(free & (d2 == best))
        if len(same):
            low, high = np.minimum(same, at), np.maximum(same, at)
            old_low, old_high = np.minimum(same, link[same]), np.maximum(same, link[same])
            nearer[same[(low < old_low) | ((low == old_low) & (high < old_high))]] = True
        best[nearer], link[nearer] = d2[nearer], at
        open_ = np.where(free, best, np.inf)
        rows = places[free & (open_ == open_.min())]
        ends = np.minimum(rows, link[rows]), np.maximum(rows, link[rows])
        i = int(np.lexsort((ends[1], ends[0]))[0])
        at = int(rows[i])
        a[step], b[step], out[step] = ends[0][i], ends[1][i], best[at]
    return a, b, out


def point_spanning_tree(points: DataFrame) -> DataFrame:
    """The tree of all pairs of each plant's points, without listing pairs: Prim's algorithm, one plant a task.

    Memory is linear in a plant's points, time quadratic: for many plants of few points. Larger
    ones are for euclidean_tree.
    """

    def prim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        ids = pdf["point_id"].to_numpy()
        a, b, d2 = _prim(ids, pdf[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({"plant_id": pdf.plant_id.iloc[0], "src": ids[a], "dst": ids[b], "weight": np.sqrt(d2)})

    kind = dict(points.dtypes)["plant_id"]
    picked = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"])
    return picked.groupBy("plant_id").applyInPandas(prim, f"plant_id {kind}, src long, dst long, weight double")


def initial_graph(points: DataFrame, tree: DataFrame, step: float) -> DataFrame:
    """All pairs within the first multiple of `step` that connects a plant: the least one not below its tree's longest edge.

    Each plant is joined by its own reach; a plant of equal points has a reach of one step.
    """
    reach = tree.groupBy("plant_id").agg((F.greatest(F.ceil(F.round(F.max("weight") / step, 9)), F.lit(1)) * step + step * 1e-9).alias("radius"))
    near = radius_join(points, points, materialize(reach, "graph-reach")).where("point_id < nbr_id")
    return near.select("plant_id", F.col("point_id").alias("src"), F.col("nbr_id").alias("dst"), F.sqrt("d2").alias("weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(plant_id, vertex_id, degree), 0 for isolated vertices."""
    ends = edges.select("plant_id", F.explode(F.array("src", "dst")).alias("vertex_id"))
    counts = ends.groupBy("plant_id", "vertex_id").agg(F.count(F.lit(1)).alias("degree")).hint("merge")
    return vertices.select("plant_id", "vertex_id").join(counts, ["plant_id", "vertex_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(plant_id, vertex_id, component): the smallest vertex reachable, each plant by itself."""
    found = connected_components(edges, by=["plant_id"], merged=True).withColumnRenamed("id", "vertex_id")
    joined = vertices.select("plant_id", "vertex_id").join(found.hint("merge"), ["plant_id", "vertex_id"], "left")
    return joined.select("plant_id", "vertex_id", F.coalesce("component", "vertex_id").alias("component"))


def _chains(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(plant_id, vertex_id, degree, chain) of vertices of degree up to 2; a chain is a component among them."""
    degree = materialize(degrees(vertices, edges), "chain-degree", merged=True)
    thin = degree.where("degree <= 2")
    inner = edges
    for end in ("src", "dst"):
        inner = inner.join(thin.select("plant_id", F.col("vertex_id").alias(end)), ["plant_id", end], "left_semi")
    return thin.join(components(thin, inner).hint("merge"), ["plant_id", "vertex_id"]).withColumnRenamed("component", "chain")


def renumber(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices numbered 0, 1, ... in the order of their ids, and edges to match; edges to missing vertices go."""
    mapped = materialize(numbered(vertices, [F.col("vertex_id")], "new"), "renumber", merged=True)
    for end in ("src", "dst"):
        edges = edges.join(mapped.select("plant_id", F.col("vertex_id").alias(end), F.col("new").alias(f"new_{end}")), ["plant_id", end])
    edges = edges.drop("src", "dst").withColumnsRenamed({"new_src": "src", "new_dst": "dst"})
    return mapped.drop("vertex_id").withColumnRenamed("new", "vertex_id"), edges


def kept_after_pruning(vertices: DataFrame, edges: DataFrame, ratio: float) -> DataFrame:
    """(plant_id, vertex_id) left when chains with a tip and at most ceil(ratio * n) vertices go, in one pass."""
    size = vertices.groupBy("plant_id").agg(F.ceil(F.count(F.lit(1)) * F.lit(float(ratio))).alias("most"))
    chain = materialize(_chains(vertices, edges), "prune-chains", merged=True)
    short = chain.groupBy("plant_id", "chain").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("degree") == 1).cast("int")).alias("tip"))
    short = short.join(size, "plant_id").where("tip = 1 and n <= most").select("plant_id", "chain")
    gone = chain.join(short, ["plant_id", "chain"], "left_semi").select("plant_id", "vertex_id").hint("merge")
    return vertices.select("plant_id", "vertex_id").join(gone, ["plant_id", "vertex_id"], "left_anti")


def prune(vertices: DataFrame, edges: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """The graph without short branches, renumbered."""
    keep = materialize(kept_after_pruning(vertices, edges, ratio), "prune-kept", merged=True)
    return renumber(vertices.join(keep, ["plant_id", "vertex_id"], "left_semi"), edges)


def root(vertices: DataFrame) -> DataFrame:
    """(plant_id, vertex_id) of the lowest z, the smaller id on ties."""
    low = vertices.groupBy("plant_id").agg(F.min(F.struct("z", "vertex_id")).alias("low"))
    return low.select("plant_id", "low.vertex_id")


def vertex_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(plant_id, vertex_id, semantic, instance): leaves are chains with a tip other than the root.

    Leaves count up from 0 by tip id, semantic 1; all else is the stem, semantic 0, instance
    -1. A plant without any junction is all stem.
    """
    chain = materialize(_chains(vertices, edges), "leaf-chains", merged=True)
    forked = degrees(vertices, edges).where("degree > 2").select("plant_id").distinct()
    tip = chain.where("degree = 1").join(root(vertices), ["plant_id", "vertex_id"], "left_anti").join(forked, "plant_id", "left_semi")
    tip = tip.groupBy("plant_id", "chain").agg(F.min("vertex_id").alias("tip"))
    leaf = tip.withColumn("instance", F.row_number().over(Window.partitionBy("plant_id").orderBy("tip")) - 1)
    named = chain.join(leaf, ["plant_id", "chain"]).select("plant_id", "vertex_id", "instance").hint("merge")
    out = vertices.select("plant_id", "vertex_id").join(named, ["plant_id", "vertex_id"], "left")
    return out.select("plant_id", "vertex_id", F.when(F.col("instance").isNull(), 0).otherwise(1).alias("semantic"), F.coalesce("instance", F.lit(-1)).cast("int").alias("instance"))


def leaf_paths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(plant_id, branch_id, pos, vertex_id): each leaf from its tip (pos 0) towards its junction.

    A chain is a path: the step from a vertex to a neighbour has one next step, and every step
    is told where its walk ends and how far that is by pointer doubling, so that rounds grow
    with the logarithm of the longest leaf. Walks that end at the tip give the places.
    """
    labels = materialize(vertex_labels(vertices, edges).where("instance >= 0"), "leaf-labels", merged=True)
    tips = degrees(vertices, edges).where("degree = 1").join(root(vertices), ["plant_id", "vertex_id"], "left_anti").join(labels, ["plant_id", "vertex_id"])
    tips = tips.groupBy("plant_id", "instance").agg(F.min("vertex_id").alias("tip"))
    at = lambda end: labels.select("plant_id", F.col("vertex_id").alias(end), F.col("instance").alias(f"of_{end}"))
    inner = edges.join(at("src"), ["plant_id", "src"]).join(at("dst"), ["plant_id", "dst"]).where("of_src = of_dst")
    both = inner.select("plant_id", F.col("src").alias("a"), F.col("dst").alias("b")).union(inner.select("plant_id", "dst", "src"))
    both = materialize(both, "leaf-steps", merged=True)
    next_ = both.select("plant_id", F.col("a").alias("b"), F.col("b").alias("c"))
    step = both.join(next_, ["plant_id", "b"], "left").where("c is null or c <> a")
    # a step a -> b leads on to b -> c; the last one of a walk leads to itself
    last = both.join(step.where("c is not null").select("plant_id", "a", "b"), ["plant_id", "a", "b"], "left_anti")
    walk = step.where("c is not null").select("plant_id", "a", "b", F.col("b").alias("to_a"), F.col("c").alias("to_b"), F.lit(1).alias("far"))
    walk = materialize(walk.unionByName(last.select("plant_id", "a", "b", F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.lit(0).alias("far"))), "leaf-walk", merged=True)
    while True:
        more = walk.select("plant_id", F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("to_a").alias("end_a"), F.col("to_b").alias("end_b"), F.col("far").alias("rest"))
        longer = walk.join(more, ["plant_id", "to_a", "to_b"]).select("plant_id", "a", "b", F.col("end_a").alias("to_a"), F.col("end_b").alias("to_b"), (F.col("far") + F.col("rest")).alias("far"), (F.col("rest") > 0).alias("moved"))
        before, walk = walk, materialize(longer, "leaf-walk", merged=True)
        discard(before)
        if walk.where("moved").limit(1).count() == 0:
            break
    placed = walk.select("plant_id", F.col("a").alias("vertex_id"), F.col("to_b").alias("tip"), (F.col("far") + 1).alias("pos")).join(tips, ["plant_id", "tip"])
    own = tips.select("plant_id", F.col("instance").alias("branch_id"), F.lit(0).alias("pos"), F.col("tip").alias("vertex_id"))
    return own.unionByName(placed.select("plant_id", F.col("instance").alias("branch_id"), "pos", "vertex_id"))


def edge_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with semantic and instance: equal ends give theirs, stem and leaf the leaf's; two leaves are an error."""
    for end in ("src", "dst"):
        edges = edges.join(labels.select("plant_id", F.col("vertex_id").alias(end), F.col("instance").alias(f"i_{end}")), ["plant_id", end])
    clash = (F.col("i_src") != F.col("i_dst")) & (F.col("i_src") >= 0) & (F.col("i_dst") >= 0)
    instance = F.when(clash, F.raise_error(F.lit("an edge joins two leaves")).cast("int")).otherwise(F.greatest("i_src", "i_dst"))
    out = edges.withColumn("instance", instance).drop("i_src", "i_dst")
    return out.withColumn("semantic", semantic_of("instance"))


def semantic_of(instance: str):
    return F.when(F.col(instance) == -1, 0).otherwise(1)


def project_labels(points: DataFrame, vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """points with instance and semantic of the nearest labelled vertex."""
    at = vertices.withColumnRenamed("vertex_id", "point_id")
    near = nearest_join(points, at).select("plant_id", "point_id", F.col("nbr_id").alias("vertex_id"))
    named = near.join(labels.select("plant_id", "vertex_id", "instance"), ["plant_id", "vertex_id"]).drop("vertex_id")
    return points.join(named, ["plant_id", "point_id"]).withColumn("semantic", semantic_of("instance"))


def project_labels_by_edge(points: DataFrame, vertices: DataFrame, edges: DataFrame, candidates: int = 5) -> DataFrame:
    """points with the label of the nearest labelled edge among those at the nearest vertices."""
    at = vertices.withColumnRenamed("vertex_id", "point_id")
    near = knn_join(points, at, candidates).select("plant_id", "point_id", F.col("nbr_id").alias("vertex_id"))
    ends = edges.select("plant_id", "src", "dst", "instance", F.explode(F.array("src", "dst")).alias("vertex_id"))
    pairs = near.join(ends, ["plant_id", "vertex_id"]).drop("vertex_id").distinct().join(points.select("plant_id", "point_id", "x", "y", "z"), ["plant_id", "point_id"])
    for end in ("src", "dst"):
        pairs = pairs.join(vertices.select("plant_id", F.col("vertex_id").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in "xyz"]), ["plant_id", end])
    d = segment_distance(xyz(), xyz("src_"), xyz("dst_"))
    best = pairs.groupBy("plant_id", "point_id").agg(F.min(F.struct(d.alias("d"), "src", "dst", "instance")).alias("b"))
    return points.join(best.select("plant_id", "point_id", "b.instance"), ["plant_id", "point_id"]).withColumn("semantic", semantic_of("instance"))
