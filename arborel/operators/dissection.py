"""Sparse positive definite systems of large plants, by nested dissection over a k-d partition.

Unknowns have places, and cells of the partition are the leaves of a tree with up to 2^FAN
branches at a node. Of two coupled unknowns that a node parts, one is eliminated at that node
or above it, so that all that an unknown is coupled with at its turn waits on the way from its
node to the root, whatever elimination has filled in. A level of the tree is one round: each node's task adds up its own entries and its children's updates in a full
matrix of its front (what it eliminates, and the border that couples with the rest), solves
for the former and hands the border's update to its parent. On the way down a level is a
round again, which puts the borders' values in. A front is as large as the cuts around its
node, not as the plant: a few times the square root of the points for surfaces, far fewer for
stems. The answer is direct, and its residual is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.operators.cells import Cells
from arborel.scratch import discard, materialize

#: Unknowns of a leaf, halvings between a node and its children.
LEAF, FAN = 256, 2


def _depth(node: Column) -> Column:
    return F.length(F.bin(node)) - 1


def _kept(depth: Column) -> Column:
    """The depth of the deepest node of the tree at or above an inner place of the heap."""
    return (F.floor(depth / FAN) * FAN).cast("int")


def _leaves(places: DataFrame, leaf: int) -> DataFrame:
    """(plant_id, row, node, depth): the k-d cell of each unknown; cells that equal places overfill are dealt out by row."""
    filed = Cells(places.withColumnRenamed("row", "point_id"), leaf).filed
    sizes = filed.groupBy("plant_id", "node").agg(F.count(F.lit(1)).alias("n"))
    more = F.greatest(F.ceil(F.log2(F.col("n") / leaf)), F.lit(0)).cast("int")
    filed = filed.join(sizes.withColumn("more", more), ["plant_id", "node"])
    node = F.expr("shiftleft(node, more) + pmod(xxhash64(point_id), shiftleft(1L, more))")
    return filed.select("plant_id", F.col("point_id").alias("row"), node.alias("node")).withColumn("depth", _depth(F.col("node")))


def _eliminated(coo: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unknowns with the depth `at` of the node that eliminates them, entries of coo with both ends' leaves).

    Of two coupled unknowns in different leaves one has to wait for the node above both: the
    one with over 4 times the other's couplings, else the right one.
    """
    held = coo.groupBy("plant_id", "row").agg(F.count(F.lit(1)).alias("held"))
    leaves = materialize(leaves.join(held, ["plant_id", "row"], "left").fillna(0, ["held"]), "dissection-leaves")
    i = leaves.select("plant_id", "row", F.col("node").alias("i"), F.col("depth").alias("di"), F.col("held").alias("hi"))
    j = leaves.select("plant_id", F.col("row").alias("col"), F.col("node").alias("j"), F.col("depth").alias("dj"), F.col("held").alias("hj"))
    both = coo.join(i, ["plant_id", "row"]).join(j, ["plant_id", "col"]).withColumn("_low", F.least("di", "dj"))
    both = both.withColumns({"_i": F.expr("shiftright(i, di - _low)"), "_j": F.expr("shiftright(j, dj - _low)")})
    waits = (F.col("hi") > 4 * F.col("hj")) | ((F.col("hj") <= 4 * F.col("hi")) & (F.col("_i") > F.col("_j")))
    above = _kept(F.col("_low") - F.length(F.bin(F.expr("_i ^ _j"))))
    common = F.when((F.col("i") != F.col("j")) & waits, above).otherwise(F.col("di")).cast("int")
    both = both.withColumn("common", common).drop("_low", "_i", "_j", "hi", "hj")
    least = both.groupBy("plant_id", "row").agg(F.min("common").alias("common"))
    unknowns = leaves.join(least, ["plant_id", "row"], "left").withColumn("at", F.coalesce("common", "depth")).drop("common", "held")
    return unknowns, both.drop("common")


def _front(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(eliminated ids, border ids, full matrix, right-hand sides) of one node's rows; eliminated ids come first."""
    ids = pdf["row"].to_numpy()
    own = np.unique(ids[pdf["own"].to_numpy()])
    border = np.setdiff1d(ids, own)
    known = np.concatenate([own, border])
    order = np.argsort(known, kind="stable")

    def place(v: np.ndarray) -> np.ndarray:
        at = order[np.minimum(np.searchsorted(known[order], v), len(known) - 1)]
        if (known[at] != v).any():
            raise ArithmeticError("the system is not solved: its matrix is not symmetric")
        return at

    a, b = np.zeros((len(known), len(known))), np.zeros((len(known), width))
    given = pdf["b"].notna().to_numpy()
    if given.any():
        np.add.at(b, place(ids[given]), np.stack(pdf["b"][given].to_list()))
    single = pdf[pdf["cols"].notna()]
    if len(single):
        sizes = single["cols"].map(len).to_numpy()
        np.add.at(a, (place(np.repeat(single["row"].to_numpy(), sizes)), place(np.concatenate(single["cols"].to_list()))), np.concatenate(single["vals"].to_list()))
    for _, update in pdf[pdf["part"].notna()].groupby("part"):
        update = update.sort_values("row")
        at = place(update["row"].to_numpy())
        a[np.ix_(at, at)] += np.stack(update["vals"].to_list())
    return own, border, a, b


def _eliminate(width: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, border, a, b = _front(pdf, width)
        n, node = len(own), int(key[1])
        try:
            np.linalg.cholesky(a[:n, :n])
            found = np.linalg.solve(a[:n, :n], np.hstack([a[:n, n:], b[:n]])) if n else np.zeros((0, len(border) + width))
        except np.linalg.LinAlgError as e:
            raise ArithmeticError(f"the system of plant {key[0]!r} is not solved: it is not positive definite") from e
        w, g = found[:, : len(border)], found[:, len(border) :]
        left, rest = a[n:, n:] - a[n:, :n] @ w, b[n:] - a[n:, :n] @ g
        depth = node.bit_length() - 1
        parent = node >> (depth - (-(-depth // FAN) - 1) * FAN) if depth else 0
        return pd.DataFrame({
            "plant_id": [key[0]] * len(own) + [key[0]] * len(border),
            "node": np.repeat([node, parent], [n, len(border)]),
            "part": np.repeat([-1, node], [n, len(border)]),
            "row": np.concatenate([own, border]),
            "vals": [*w, *((left + left.T) / 2)],
            "b": [*g, *rest],
        })

    return run


def _put_in(width: int):
    def run(key: tuple, rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["b"].to_list()) if len(rows) else np.zeros((0, width))
        if len(border) and len(rows):
            x = x - np.stack(rows["vals"].to_list()) @ np.stack(border.sort_values("place")["x"].to_list())
        return pd.DataFrame({"plant_id": rows["plant_id"], "row": rows["row"], "x": pd.Series(list(x), rows.index, dtype=object)})

    return run


def solve(coo: DataFrame, rhs: DataFrame, places: DataFrame, leaf: int = LEAF, tolerance: float = 1e-7) -> DataFrame:
    """(plant_id, row, ..) of A X = B for A(plant_id, row, col, val), symmetric and positive definite.

    rhs(plant_id, row, ..) has a row for each unknown and a column for each right-hand side;
    the answer has the same columns. places(plant_id, row, x, y, z) says where unknowns lie:
    those coupled should lie near each other, or fronts grow. Entries of coo at one place add
    up; nulls count as 0. A matrix that is not symmetric or not positive definite, and a residual
    above tolerance times the right-hand side, are an ArithmeticError (the former two from a
    task). An empty rhs gives an empty table.
    """
    names = [c for c in rhs.columns if c not in ("plant_id", "row")]
    kind, width = dict(rhs.dtypes)["plant_id"], len(names)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    coo = materialize(coo.select("plant_id", F.col("row").cast("long"), F.col("col").cast("long"), value("val").alias("val")), "dissection-matrix")
    rhs = materialize(rhs.select("plant_id", F.col("row").cast("long"), F.array(*[value(c) for c in names]).alias("b")), "dissection-right")
    unknowns, both = _eliminated(coo, _leaves(places, leaf))
    unknowns = materialize(unknowns, "dissection-unknowns")
    where = unknowns.select("plant_id", "row", F.col("at").alias("ai")), unknowns.select("plant_id", F.col("row").alias("col"), F.col("at").alias("aj"))
    at = both.join(where[0], ["plant_id", "row"]).join(where[1], ["plant_id", "col"]).withColumn("at", F.greatest("ai", "aj"))
    at = at.withColumns({"node": F.expr("if(ai >= aj, shiftright(i, di - ai), shiftright(j, dj - aj))"), "level": F.ceil(F.col("at") / FAN).cast("int")})
    entries = at.groupBy("plant_id", "level", "node", "row").agg(F.collect_list(F.struct("col", "val")).alias("e"))
    none = lambda t: F.lit(None).cast(t)
    rows = entries.select("plant_id", "level", "node", none("long").alias("part"), "row", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"), none("array<double>").alias("b"), F.lit(False).alias("own"))
    own = unknowns.join(rhs, ["plant_id", "row"]).withColumns({"node": F.expr("shiftright(node, depth - at)"), "level": F.ceil(F.col("at") / FAN).cast("int")})
    own = own.select("plant_id", "level", "node", none("long").alias("part"), "row", none("array<long>").alias("cols"), none("array<double>").alias("vals"), "b", F.lit(True).alias("own"))
    rows = materialize(rows.unionByName(own), "dissection-rows")
    deepest = rows.agg(F.max("level")).first()[0]
    made, update = {}, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        front = rows.where(F.col("level") == level).drop("level")
        if update is not None:
            handed = update.where("part >= 0").select("plant_id", "node", "part", "row", none("array<long>").alias("cols"), "vals", "b", F.lit(False).alias("own"))
            front = front.unionByName(handed)
        out = front.groupBy("plant_id", "node").applyInPandas(_eliminate(width), f"plant_id {kind}, node long, part long, row long, vals array<double>, b array<double>")
        update = made[level] = materialize(out, "dissection-front")
    found = None
    for level in sorted(made):
        done = made[level].where("part < 0").select("plant_id", "node", "row", "vals", "b")
        if found is None:
            put = done.select("plant_id", "row", F.col("b").alias("x"))
        else:
            # names of their own, as both sides of the cogroup come from one table
            border = made[level].where("part >= 0").select(F.col("plant_id").alias("plant"), F.col("part").alias("at"), F.col("row").alias("place"))
            border = border.join(found.toDF("plant", "place", "x"), ["plant", "place"])
            put = done.groupBy("plant_id", "node").cogroup(border.groupBy("plant", "at")).applyInPandas(_put_in(width), f"plant_id {kind}, row long, x array<double>")
        put = materialize(put, "dissection-solved")
        found = put if found is None else found.unionByName(put)
    if found is None:
        return rhs.select("plant_id", "row", *[F.col("b")[i].alias(c) for i, c in enumerate(names)])
    discard(rows, *made.values())
    out = found.select("plant_id", "row", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    _check(coo, rhs, found, width, tolerance)
    return out


def _check(coo: DataFrame, rhs: DataFrame, found: DataFrame, width: int, tolerance: float) -> None:
    """An ArithmeticError if a plant's residual is above tolerance times its right-hand side."""
    product = coo.join(found.withColumnRenamed("row", "col"), ["plant_id", "col"]).groupBy("plant_id", "row")
    product = product.agg(*[F.sum(F.col("val") * F.col("x")[i]).alias(f"y{i}") for i in range(width)])
    sums = rhs.join(product, ["plant_id", "row"], "left").groupBy("plant_id")
    ends = [f(v).alias(f"{n}{i}") for i in range(width) for n, f, v in (("r", F.sum, (F.col("b")[i] - F.coalesce(f"y{i}", F.lit(0.0))) ** 2), ("b", F.sum, F.col("b")[i] ** 2))]
    parts = [F.sqrt(f"r{i}") / F.greatest(F.sqrt(f"b{i}"), F.lit(1e-300)) for i in range(width)]
    worst = sums.agg(*ends).select(F.greatest(*parts, F.lit(0.0)).alias("left")).agg(F.max("left")).first()[0]
    if worst is not None and not worst <= tolerance:
        raise ArithmeticError(f"the system is not solved: residual {worst:.3g} of the right-hand side, wanted {tolerance:.3g}")
