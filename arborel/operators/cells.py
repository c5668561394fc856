"""A k-d partition of point tables into cells of bounded size, and descents through its boxes.

Cuts come from samples: a task fits a tree of LEVELS halvings to a bounded sample of a cell's
points, and cells that are still too large get trees of their own in the next round, for all
plants together. Every cut separates points, so cells follow the density whatever the extent
of a plant: points that lie apart, or dense clusters, only add levels. Cells are numbered like
a heap (1 is a plant, 2 c and 2 c + 1 are the halves of c). A query walks down STEP levels in
a join and goes on only into boxes that lie within its bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.scratch import materialize

#: Points that a tree is fitted on, halvings of one tree, levels that a query walks down in one join.
SAMPLE, LEVELS, STEP = 8192, 10, 4
#: Points in the cells whose trees one call fits, on average.
BATCH = 1 << 15
AXES = ("x", "y", "z")


def _cut(p: np.ndarray) -> tuple[int, float] | None:
    """The axis and value that part points: of the longest axis that parts off a quarter, else of the longest.

    The value is a median, or the end of a gap among the middle half that is a tenth of the extent and four times the mean gap.
    """
    fallback = None
    for axis in np.argsort(-np.ptp(p, axis=0), kind="stable"):
        values = np.sort(p[:, axis])
        n, low = len(values), values[0]
        if values[-1] == low:
            continue
        gaps = np.diff(values[(n - 1) // 4 : 3 * n // 4 + 1])
        if len(gaps) and gaps.max() >= max(0.1, 4 / n) * (values[-1] - low):
            cut = values[(n - 1) // 4 + int(gaps.argmax()) + 1]
        else:
            cut = values[n // 2]
        if cut == low:
            cut = values[np.searchsorted(values, low, side="right")]
        left = int(np.searchsorted(values, cut))
        if 4 * min(left, n - left) >= n:
            return int(axis), float(cut)
        fallback = fallback or (int(axis), float(cut))
    return fallback


def _fit(p: np.ndarray, total: float, most: int) -> tuple[list, list]:
    """Axes (1 to 3, 0 at leaves) and cuts of a heap of up to LEVELS halvings, as long as its cuts go; item 0 is unused."""
    axes, cuts = [0] * (1 << LEVELS), [0.0] * (1 << LEVELS)
    work, weight, last = [(1, p)], total / len(p), 0
    while work:
        at, inside = work.pop()
        if len(inside) * weight <= most or (weight > 1 and len(inside) < 16):
            continue
        found = _cut(inside)
        if found is None:
            continue
        axes[at], cuts[at], last = found[0] + 1, found[1], max(last, at)
        right = inside[:, found[0]] >= found[1]
        if 2 * at < 1 << LEVELS:
            work += [(2 * at, inside[~right]), (2 * at + 1, inside[right])]
    return axes[: last + 1], cuts[: last + 1]


def box_d2(prefix: str = "", at: str = "") -> Column:
    """Squared distance of the point (prefix x, ...) from the box (at low_x, at high_x, ...)."""
    out = None
    for a in AXES:
        p = F.col(f"{prefix}{a}")
        gap = F.greatest(F.col(f"{at}low_{a}") - p, p - F.col(f"{at}high_{a}"), F.lit(0.0))
        out = gap * gap if out is None else out + gap * gap
    return out


def corner_d2(prefix: str = "", at: str = "") -> Column:
    """Squared distance of the point from the farthest corner of the box."""
    out = None
    for a in AXES:
        p = F.col(f"{prefix}{a}")
        far = F.greatest(F.abs(F.col(f"{at}low_{a}") - p), F.abs(F.col(f"{at}high_{a}") - p))
        out = far * far if out is None else out + far * far
    return out


BOX = [f"{side}_{a}" for a in AXES for side in ("low", "high")]


class Cells:
    """filed: (plant_id, node, point_id, x, y, z); boxes: (plant_id, parent, node, leaf, n, low_x .. high_z).

    A cell holds at most `most` points, or more where they are equal. boxes has a row for each
    node at a multiple of STEP levels and each leaf, below its parent there; leaves are their
    own children too, so that walks of `steps` joins end at leaves. Points need finite
    coordinates and ids that are unique in a plant.
    """

    def __init__(self, points: DataFrame, most: int):
        self.most, self.trees = most, []
        filed = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in AXES])
        self.filed = materialize(filed.withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0)}), "cells", merged=True)
        while True:
            sizes = self._sizes()
            wide = F.greatest(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in AXES]) > 0
            over = sizes.where((F.col("n") > most) & wide).select("plant_id", "node", "n")
            if over.isEmpty():
                break
            trees = materialize(self._fitted(over), "cell-trees", merged=True)
            self.trees.append(trees)
            self.filed = materialize(self._moved(self.filed, trees), "cells", merged=True)
        self.leaves = sizes
        self.boxes = materialize(self._boxes(sizes), "cell-boxes", merged=True)
        deepest = sizes.agg(F.max("depth")).first()[0] or 0
        self.steps = 1 + -(-deepest // STEP)

    def _sizes(self) -> DataFrame:
        ends = [f(a).alias(f"{side}_{a}") for a in AXES for side, f in (("low", F.min), ("high", F.max))]
        return materialize(self.filed.groupBy("plant_id", "node", "depth").agg(F.count(F.lit(1)).alias("n"), *ends), "cell-sizes", merged=True)

    def _fitted(self, over: DataFrame) -> DataFrame:
        most = self.most

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            # cells are many and small in the last round: one call fits those of a batch
            cell = pdf.groupby(["plant_id", "node"], sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            p, n = pdf[list(AXES)].to_numpy(float), pdf["n"].to_numpy(float)
            trees = [_fit(p[rows], n[rows[0]], most) for rows in np.split(order, starts[1:])]
            first = pdf.iloc[order[starts]]
            return pd.DataFrame({"plant_id": first["plant_id"].to_numpy(), "node": first["node"].to_numpy(), "axes": [t[0] for t in trees], "cuts": [t[1] for t in trees]})

        kind = dict(self.filed.dtypes)["plant_id"]
        coin = F.pmod(F.xxhash64("point_id", F.lit("cells")), F.lit(1 << 30))
        sample = self.filed.join(over, ["plant_id", "node"]).where(coin < F.lit(float(1 << 30)) * SAMPLE / F.col("n"))
        held = over.agg(F.sum(F.least("n", F.lit(SAMPLE)))).first()[0]
        batches = -(-held // BATCH)
        # the number of partitions is held, or adaptive execution would join these few bytes into one task
        parts = min(batches, int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sample = sample.select("plant_id", "node", "n", *AXES, F.pmod(F.xxhash64("plant_id", "node"), F.lit(batches)).alias("batch")).repartition(parts, "batch")
        return sample.groupBy("batch").applyInPandas(fit, f"plant_id {kind}, node long, axes array<int>, cuts array<double>")

    @staticmethod
    def _moved(rows: DataFrame, trees: DataFrame) -> DataFrame:
        """rows with node and depth below the trees of their nodes."""

        def down(at: Column, _: Column) -> Column:
            axis, cut = F.get("axes", at), F.get("cuts", at)
            value = F.when(axis == 1, F.col("x")).when(axis == 2, F.col("y")).otherwise(F.col("z"))
            # a leaf's number stands below the heap's size only at leaves: it goes on as its negative
            return F.when(at < 0, at).when(at >= 1 << LEVELS, -at).when(axis == 0, -at).otherwise(2 * at + F.when(value >= cut, 1).otherwise(0))

        local = F.abs(F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), down))
        local = F.when(F.col("axes").isNull(), 1).otherwise(local)
        moved = rows.join(trees, ["plant_id", "node"], "left").withColumn("_local", local)
        moved = moved.withColumn("_down", F.length(F.bin("_local")) - 1)
        node = F.expr("shiftleft(node, _down) + (_local - shiftleft(1, _down))")
        return moved.withColumns({"node": node, "depth": F.col("depth") + F.col("_down")}).drop("axes", "cuts", "_local", "_down")

    def _boxes(self, leaves: DataFrame) -> DataFrame:
        levels = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("depth"), F.lit(STEP)), F.array("depth")))
        above = leaves.withColumn("level", F.explode(levels))
        # the last level kept above this one
        up = F.when(F.col("level") == 0, -1).otherwise(F.floor((F.col("level") - 1) / STEP) * STEP).cast("int")
        above = above.withColumn("up", up)
        above = above.withColumns({"own": F.expr("shiftright(node, depth - level)"), "parent": F.expr("if(up < 0, 0L, shiftright(node, depth - up))"), "leaf": F.col("level") == F.col("depth")})
        ends = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in BOX]
        nodes = above.groupBy("plant_id", "parent", F.col("own").alias("node")).agg(F.max("leaf").alias("leaf"), F.sum("n").alias("n"), *ends)
        ends = leaves.select("plant_id", F.col("node").alias("parent"), "node", F.lit(True).alias("leaf"), "n", *BOX)
        return nodes.unionByName(ends)

    def place(self, queries: DataFrame) -> DataFrame:
        """queries(plant_id, x, y, z, ..) with node, the leaf of their place; plants without points are left out."""
        known = self.leaves.select("plant_id").distinct()
        placed = queries.join(known, "plant_id", "left_semi").withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0)})
        for trees in self.trees:
            placed = self._moved(placed, trees)
        return placed.drop("depth")

    def around(self, least: int) -> DataFrame:
        """(plant_id, node, low_x .. high_z): for each leaf the smallest box around it, of those kept, with at least that many points."""
        levels = F.sequence(F.lit(0), F.col("depth"), F.lit(STEP))
        above = self.leaves.select("plant_id", F.col("node").alias("at"), "depth", F.explode(levels).alias("level"))
        above = above.withColumn("node", F.expr("shiftright(at, depth - level)"))
        wide = self.boxes.where(F.col("parent") != F.col("node")).where(F.col("n") >= least).select("plant_id", "node", F.struct(*BOX).alias("box"))
        found = above.join(wide, ["plant_id", "node"]).groupBy("plant_id", "at").agg(F.max_by("box", "level").alias("box"))
        return found.select("plant_id", F.col("at").alias("node"), "box.*")

    def visits(self, asks: DataFrame) -> DataFrame:
        """asks(plant_id, q_x, q_y, q_z, bound, ..) with node: the leaves whose boxes lie within bound (squared) of each."""
        columns = asks.columns
        front = asks.withColumn("parent", F.lit(0).cast("long"))
        for _ in range(self.steps):
            met = front.join(self.boxes, ["plant_id", "parent"]).where(box_d2("q_") <= F.col("bound"))
            front = met.select(*columns, F.col("node").alias("parent"))
        return front.withColumnRenamed("parent", "node")
