"""Triangle soups over point tables: local triangulation, repair, edges, areas and cotangent weights."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborel.functions.geometry import dist2, half_cotan, heron_area, triangle_area, xyz
from arborel.operators.spatial import knn_join
from arborel.scratch import materialize


#: Rounding of a float turn relative to the sum of its products' sizes (3 + 16 e) e with e = 2^-53, and where underflow may hide one.
TURN_ERROR, TINY = (3 + 16 * 2.0**-53) * 2.0**-53, 1e-290
#: The side of tangent planes that counts as the upper one, off the directions that grids have.
UPWARD = np.array([0.317, 0.414, 0.853])
#: Coordinates that one_rings takes at a time.
RING_CELLS = 1 << 18


def _two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b as a float and its exact error."""
    p = a * b
    parts = []
    for v in (a, b):
        big = v * 134217729.0
        high = big - (big - v)
        parts += [high, v - high]
    ah, al, bh, bl = parts
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def turns(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """-1, 0 or 1: the exact sign of the turn a, b, c of points (n, 2).

    A float value beyond its error bound stands. The others' products are taken exactly where
    the differences in them are exact, and in fractions where they are not.
    """
    u, v, s, t = b[:, 0] - a[:, 0], c[:, 1] - a[:, 1], b[:, 1] - a[:, 1], c[:, 0] - a[:, 0]
    left, right = u * v, s * t
    sign = np.sign(left - right).astype(int)
    near = np.flatnonzero(np.abs(left - right) <= TURN_ERROR * (np.abs(left) + np.abs(right)) + TINY)
    if not len(near):
        return sign
    sign[near] = 0
    near = near[~(((u[near] == 0) | (v[near] == 0)) & ((s[near] == 0) | (t[near] == 0)))]
    inexact = np.zeros(len(near), dtype=bool)
    for p, q, d in ((b[near, 0], a[near, 0], u[near]), (c[near, 1], a[near, 1], v[near]), (b[near, 1], a[near, 1], s[near]), (c[near, 0], a[near, 0], t[near])):
        bent = p - d  # p - q is exact if d and the part of q that it took add up to p and q
        inexact |= ((p - (d + bent)) + (bent - q)) != 0
    size = np.abs(left[near]) + np.abs(right[near])
    inexact |= (size < 1e-250) | (np.maximum.reduce([np.abs(e[near]) for e in (u, v, s, t)]) > 1e150)
    exact = near[~inexact]
    (l1, l0), (r1, r0) = _two_product(u[exact], v[exact]), _two_product(s[exact], t[exact])
    sign[exact] = np.where(l1 != r1, np.sign(l1 - r1), np.sign(l0 - r0)).astype(int)
    for i in near[inexact]:
        ax, ay, bx, by, cx, cy = (Fraction(float(e)) for e in (*a[i], *b[i], *c[i]))
        turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        sign[i] = (turn > 0) - (turn < 0)
    return sign


def _rings(centre: np.ndarray, around: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of the triangles of centre (n, 3) with neighbours i and j of around (n, m, 3); real (n, m) marks neighbours.

    Inversion at the centre turns its Delaunay neighbours into the convex hull of the images,
    which is wrapped for all rows at once, a corner in a step.
    """
    n, m = real.shape
    d = np.where(real[..., None], around - centre[:, None], 0.0)
    d = np.ldexp(d, -np.frexp(np.abs(d).max(axis=(1, 2), initial=0.0))[1][:, None, None])
    _, axes = np.linalg.eigh(d.transpose(0, 2, 1) @ d)
    # seen from the side of UPWARD, whatever signs the axes came with
    mirrored = (axes[:, :, 0] @ UPWARD) * np.linalg.det(axes) < 0
    flat = d @ axes[:, :, 1:]
    flat[mirrored, :, 1] *= -1
    size = (flat**2).sum(axis=2)
    real = real & (size > 1e-300)
    q = np.where(real[..., None], flat / np.where(real, size, 1.0)[..., None], np.inf)
    rows = np.flatnonzero(real.sum(axis=1) > 1)
    at = np.lexsort((q[rows, :, 1], q[rows, :, 0]), axis=1)[:, 0]
    begin, found = q[rows, at], []
    for _ in range(m):
        if not len(rows):
            break
        here, best = q[rows, at], np.full(len(rows), -1)
        for k in range(m):
            there = q[rows, k]
            use = np.flatnonzero(real[rows, k] & (there != here).any(axis=1))
            first = use[best[use] < 0]
            best[first] = k
            rest = use[best[use] != k]
            if not len(rest):
                continue
            now = q[rows[rest], best[rest]]
            turn = turns(here[rest], now, there[rest])
            # on one line from a corner the farther one is the hull's
            away = np.abs(there[rest] - here[rest]).max(axis=1) > np.abs(now - here[rest]).max(axis=1)
            best[rest[(turn < 0) | ((turn == 0) & away)]] = k
        some = best >= 0
        rows, at, best, begin, here = rows[some], at[some], best[some], begin[some], here[some]
        there = q[rows, best]
        found.append((rows, at, best, turns(np.zeros_like(here), here, there) > 0))
        more = (there != begin).any(axis=1)
        rows, at, begin = rows[more], best[more], begin[more]
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    row, i, j, seen = (np.concatenate([f[c] for f in found]) for c in range(4))
    return row[seen], i[seen], j[seen]


def one_rings(centre: np.ndarray, around: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j): around[i] and around[j] form a Delaunay triangle with centre[row] in its tangent plane.

    counts tells how many of the rows of around, in order, each centre has as neighbours. They
    are taken by their coordinates, so their order has no bearing. Of neighbours on one circle
    with the centre the first and last count, of equal ones one, and those equal to the centre
    none. Centres with like numbers of neighbours go together.
    """
    begin, order, out, at = np.cumsum(counts) - counts, np.argsort(counts, kind="stable"), [], 0
    sizes = counts[order]
    while at < len(order):
        end = int(np.searchsorted(sizes, 1.25 * sizes[at] + 4, side="right"))
        end = min(end, at + max(1, RING_CELLS // max(1, int(sizes[end - 1]))))
        some, m = order[at:end], int(sizes[end - 1])
        at = end
        if m < 2:
            continue
        real = np.arange(m) < counts[some, None]
        take = np.where(real, begin[some, None] + np.arange(m), 0)
        p = np.where(real[..., None], around[take], np.inf)
        by = np.lexsort((p[..., 2], p[..., 1], p[..., 0]), axis=1)
        take, p = np.take_along_axis(take, by, axis=1), np.take_along_axis(p, by[..., None], axis=1)
        row, i, j = _rings(centre[some], np.where(real[..., None], p, 0.0), real)
        out.append((some[row], take[row, i], take[row, j]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.empty(0, dtype=np.int64) for c in range(3))


def one_ring(centre: np.ndarray, around: np.ndarray) -> list[tuple[int, int]]:
    """one_rings of one point: pairs of indices into `around`."""
    around = np.asarray(around, dtype=float).reshape(-1, 3)
    _, i, j = one_rings(np.asarray(centre, dtype=float)[None], around, np.array([len(around)]))
    return list(zip(i.tolist(), j.tolist(), strict=True))


def nearest_of(near: DataFrame | None, k: int) -> DataFrame | None:
    """The k nearest of a knn_join with more of them, None where none is at hand."""
    return None if near is None else near.where(F.col("rank") <= k)


def local_triangles(points: DataFrame, k: int = 8, near: DataFrame | None = None) -> DataFrame:
    """(plant_id, a, b, c): the triangles at each point of its k nearest neighbours' Delaunay triangulation; a is the point.

    near(plant_id, point_id, nbr_id, d2) gives other neighbours instead, such as those within
    a radius. Neighbours are gathered for each point, so the kernel needs no whole plant; it
    triangulates a batch of points at once.
    """
    near = knn_join(points, points, k, exclude_self=True) if near is None else near.where("nbr_id <> point_id")
    theirs = points.select("plant_id", F.col("point_id").alias("nbr_id"), *[F.col(a).cast("double").alias(f"n{a}") for a in "xyz"])
    lists = near.join(theirs, ["plant_id", "nbr_id"]).groupBy("plant_id", "point_id").agg(F.sort_array(F.collect_list(F.struct("d2", "nbr_id", "nx", "ny", "nz"))).alias("nbrs"))
    rows = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"]).join(lists, ["plant_id", "point_id"])
    rows = rows.select("plant_id", "point_id", "x", "y", "z", *[F.col(f"nbrs.{c}").alias(c) for c in ("nbr_id", "nx", "ny", "nz")])
    kind = dict(points.dtypes)["plant_id"]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            around, ids = np.stack([np.concatenate(pdf[c].to_numpy()) for c in ("nx", "ny", "nz")], axis=1), np.concatenate(pdf["nbr_id"].to_numpy())
            row, i, j = one_rings(pdf[["x", "y", "z"]].to_numpy(float), around, pdf["nbr_id"].map(len).to_numpy())
            yield pd.DataFrame({"plant_id": pdf["plant_id"].to_numpy()[row], "a": pdf["point_id"].to_numpy()[row], "b": ids[i], "c": ids[j]})

    return rows.mapInPandas(run, f"plant_id {kind}, a long, b long, c long")


def with_corners(tris: DataFrame, points: DataFrame) -> DataFrame:
    """tris with the coordinates ax..cz of their corners."""
    for corner in "abc":
        at = points.select("plant_id", F.col("point_id").alias(corner), *[F.col(a).cast("double").alias(f"{corner}{a}") for a in "xyz"])
        tris = tris.join(at, ["plant_id", corner])
    return tris


def mesh_edges(tris: DataFrame, points: DataFrame) -> DataFrame:
    """(plant_id, src, dst, length) of the distinct edges, src < dst."""
    return edge_lengths(unique_edges(tris), points)


def unique_edges(tris: DataFrame) -> DataFrame:
    """(plant_id, src, dst) of the distinct edges, src < dst."""
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in ("ab", "bc", "ca")])).alias("e")
    return tris.select("plant_id", sides).select("plant_id", "e.src", "e.dst").distinct()


def edge_lengths(edges: DataFrame, points: DataFrame) -> DataFrame:
    for end, name in (("src", "s"), ("dst", "t")):
        edges = edges.join(points.select("plant_id", F.col("point_id").alias(end), *[F.col(a).cast("double").alias(f"{name}{a}") for a in "xyz"]), ["plant_id", end])
    return edges.select("plant_id", "src", "dst", F.sqrt(dist2(xyz("s"), xyz("t"))).alias("length"))


def edge_threshold(edges: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(plant_id, threshold): the smallest edge length that is an upper outlier; null (no cut) for plants without any."""
    from arborel.operators.cloud import upper_outliers

    low = upper_outliers(edges, "length", ["plant_id"], sigmas).groupBy("plant_id").agg(F.min("length").alias("threshold"))
    return edges.select("plant_id").distinct().join(low, "plant_id", "left")


def drop_long_triangles(tris: DataFrame, points: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Triangles all of whose edges are shorter than their plant's threshold; a null threshold keeps all."""
    sides = [dist2(xyz(p), xyz(q)) for p, q in ("ab", "bc", "ca")]
    whole = with_corners(tris, points).join(thresholds, "plant_id", "left")
    keep = F.sqrt(F.greatest(*sides)) < F.coalesce(F.col("threshold"), F.lit(float("inf")))
    return whole.where(keep).select("plant_id", "a", "b", "c")


def attach_orphans(tris: DataFrame, points: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """tris and, for each point in none of them, a triangle with its two nearest neighbours, those of the knn_join near where one is at hand."""
    used = tris.select("plant_id", F.explode(F.array("a", "b", "c")).alias("point_id")).distinct()
    lost = points.join(used, ["plant_id", "point_id"], "left_anti")
    two = knn_join(lost, points, 2, exclude_self=True) if near is None else nearest_of(near, 2).join(lost.select("plant_id", "point_id"), ["plant_id", "point_id"], "left_semi")
    two = two.groupBy("plant_id", "point_id").agg(
        F.min(F.when(F.col("rank") == 1, F.col("nbr_id"))).alias("b"), F.min(F.when(F.col("rank") == 2, F.col("nbr_id"))).alias("c")
    )
    return tris.unionByName(two.where("c is not null").select("plant_id", F.col("point_id").alias("a"), "b", "c"))


def vertex_areas(tris: DataFrame, points: DataFrame) -> DataFrame:
    """(plant_id, point_id, area): a third of the area of the triangles at each point; 0 without any."""
    faces = with_corners(tris, points).withColumn("area", triangle_area(xyz("a"), xyz("b"), xyz("c")) / 3)
    own = faces.select("plant_id", F.explode(F.array("a", "b", "c")).alias("point_id"), "area").groupBy("plant_id", "point_id").agg(F.sum("area").alias("area"))
    return points.select("plant_id", "point_id").join(own, ["plant_id", "point_id"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def mean_area(tris: DataFrame, points: DataFrame) -> DataFrame:
    return vertex_areas(tris, points).groupBy("plant_id").agg(F.avg("area").alias("mean_area"))


def laplacian(tris: DataFrame, points: DataFrame, scale: float = 1.0) -> DataFrame:
    """(plant_id, row, col, val): cotangent Laplacian of the soup; rows sum to zero, flat triangles weigh nothing."""
    faces = with_corners(tris, points).withColumn("area", triangle_area(xyz("a"), xyz("b"), xyz("c")))
    d2 = {p + q: dist2(xyz(p), xyz(q)) for p, q in ("ab", "bc", "ca")}
    sides = [("a", "b", d2["ab"], d2["bc"], d2["ca"]), ("b", "c", d2["bc"], d2["ca"], d2["ab"]), ("c", "a", d2["ca"], d2["ab"], d2["bc"])]
    return _laplacian_of(faces, sides, scale)


def _laplacian_of(faces: DataFrame, sides: list, scale: float) -> DataFrame:
    """Cotangent weights of the sides (from, to, their squared length, the others') of faces with area, summed up as a matrix."""
    weights = F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j"), half_cotan(o, m, n, F.col("area")).alias("w")) for p, q, o, m, n in sides])
    pairs = faces.select("plant_id", F.explode(weights).alias("e")).select("plant_id", "e.i", "e.j", "e.w").where("w is not null")
    cells = F.explode(F.array(*[F.struct(r.alias("row"), c.alias("col"), v.alias("val")) for r, c, v in (
        (F.col("i"), F.col("j"), F.col("w")), (F.col("j"), F.col("i"), F.col("w")), (F.col("i"), F.col("i"), -F.col("w")), (F.col("j"), F.col("j"), -F.col("w")))]))
    coo = pairs.select("plant_id", cells.alias("e")).groupBy("plant_id", "e.row", "e.col").agg((F.sum("e.val") * scale).alias("val"))
    return coo


#: Mollification, relative to the mean edge length, and the sum of cotangents below which an edge is flipped.
MOLLIFY, LEAST_COTAN = 1e-5, -1e-9
#: Points of a plant whose cover one task flips, some 100 MB.
COVER_TASK = 16_384


def tufted_cover(tris: np.ndarray, at: np.ndarray, mollify: float = MOLLIFY, most_rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(corners, lengths) of the intrinsic Delaunay triangulation of the tufted cover of triangles(n, 3) over positions.

    Every triangle has a front and a back; around an edge each front is glued to the back of
    the next triangle, so that edges of any soup have two sides. Edges first grow by what keeps
    all triangle inequalities. Then edges whose opposite angles add up to more than half a turn
    are flipped, many at once that share no face. lengths[:, i] lies between corners i and i + 1.
    Triangles that name a corner twice are left out; the others go by their corners, so that
    the order of rows has no bearing.
    """
    tris = tris[(tris[:, 0] != tris[:, 1]) & (tris[:, 1] != tris[:, 2]) & (tris[:, 2] != tris[:, 0])]
    tris = tris[np.lexsort((tris[:, 2], tris[:, 1], tris[:, 0]))]
    if not len(tris):
        return np.empty((0, 3), dtype=np.int64), np.empty((0, 3))
    faces = np.stack([tris, tris[:, [0, 2, 1]]], axis=1).reshape(-1, 3)
    n = 3 * len(faces)
    tail, half = faces.ravel().copy(), np.arange(n)
    follow = half - half % 3 + (half + 1) % 3
    face = half // 3
    head = tail[follow]
    # sides by edge: of each triangle one runs up and one runs down; an up side meets the down side of the next triangle
    order = np.lexsort((face // 2, tail > head, np.maximum(tail, head), np.minimum(tail, head)))
    up, down = order[(tail < head)[order]], order[(tail > head)[order]]
    key = np.stack([tail[up], head[up]])
    start = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(up)) - 1
    after = np.arange(len(up)) + 1
    after[last] = first
    twin = np.empty(n, dtype=np.int64)
    twin[up], twin[down[after]] = down[after], up
    length = np.sqrt(((at[tail] - at[head]) ** 2).sum(axis=1))
    short = length + mollify * length.mean() - length[follow] - length[follow[follow]]
    length = length + max(0.0, short.max())
    for _ in range(most_rounds):
        b, c = length[follow], length[follow[follow]]
        s = (length + b + c) / 2
        area = np.sqrt(np.maximum(s * (s - length) * (s - b) * (s - c), 1e-300))
        cotan = (b * b + c * c - length * length) / (4 * area)
        bad = np.flatnonzero((cotan + cotan[twin] < LEAST_COTAN) & (half < twin) & (face != face[twin]))
        if not len(bad):
            begin = np.unique(face, return_index=True)[1]
            around = np.stack([begin, follow[begin], follow[follow[begin]]], axis=1)
            return tail[around], length[around]
        worst = np.full(len(faces), np.iinfo(np.int64).max)
        rank = np.empty(len(bad), dtype=np.int64)
        rank[np.argsort((cotan + cotan[twin])[bad], kind="stable")] = np.arange(len(bad))
        for side in (bad, twin[bad]):
            np.minimum.at(worst, face[side], rank)
        h = bad[(worst[face[bad]] == rank) & (worst[face[twin[bad]]] == rank)]
        t = twin[h]
        v_w, w_u, u_x, x_v = follow[h], follow[follow[h]], follow[t], follow[follow[t]]
        # the angles at the tail of h, in both faces, by their cosines and sines
        uv, uw, ux = length[h], length[w_u], length[u_x]
        cos_f = (uv * uv + uw * uw - length[v_w] ** 2) / (2 * uv * uw)
        cos_g = (uv * uv + ux * ux - length[x_v] ** 2) / (2 * uv * ux)
        sin_f, sin_g = 2 * area[h] / (uv * uw), 2 * area[t] / (uv * ux)
        length[h] = length[t] = np.sqrt(np.maximum(uw * uw + ux * ux - 2 * uw * ux * (cos_f * cos_g - sin_f * sin_g), 1e-300))
        tail[h], tail[t] = tail[x_v], tail[w_u]
        follow[h], follow[w_u], follow[u_x] = w_u, u_x, h
        follow[t], follow[x_v], follow[v_w] = x_v, v_w, t
        face[u_x], face[v_w] = face[h], face[t]
    raise RuntimeError(f"edges are still to be flipped after {most_rounds} rounds")


def intrinsic(tris: DataFrame, points: DataFrame, one_task: int = COVER_TASK) -> DataFrame:
    """(plant_id, a, b, c, ab, bc, ca): tufted_cover of every plant's soup, with the lengths of its sides.

    A task takes the soup of one plant of up to one_task points, some hundred bytes a triangle;
    the covers of larger ones are tables, flipped in rounds.
    """
    from arborel.operators import flips

    large = points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_task).select("plant_id")
    large = materialize(large, "large-covers")
    if not large.isEmpty():
        covered = flips.delaunay_cover(*[materialize(df.join(large, "plant_id", "left_semi"), "large-soup") for df in (tris, points)])
        rest = [df.join(large, "plant_id", "left_anti") for df in (tris, points)]
        return intrinsic(*rest, one_task=one_task).unionByName(covered)
    kind = dict(points.dtypes)["plant_id"]

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_id")
        ids = p["point_id"].to_numpy()
        corners, lengths = tufted_cover(np.searchsorted(ids, t[["a", "b", "c"]].to_numpy()), p[["x", "y", "z"]].to_numpy(float))
        named = {c: ids[corners[:, i]] for i, c in enumerate("abc")} | {c: lengths[:, i] for i, c in enumerate(("ab", "bc", "ca"))}
        return pd.DataFrame({"plant_id": p["plant_id"].iloc[0] if len(p) else None, **named})

    own = points.select("plant_id", F.col("point_id").cast("long"), *[F.col(a).cast("double") for a in "xyz"]).groupBy("plant_id")
    return own.cogroup(tris.select("plant_id", "a", "b", "c").groupBy("plant_id")).applyInPandas(run, f"plant_id {kind}, a long, b long, c long, ab double, bc double, ca double")


def intrinsic_laplacian(faces: DataFrame, scale: float = 1.0) -> DataFrame:
    """(plant_id, row, col, val) of faces from intrinsic(); half of each weight, as the cover has every triangle twice."""
    area = heron_area(F.col("ab"), F.col("bc"), F.col("ca"))
    d2 = {s: F.col(s) * F.col(s) for s in ("ab", "bc", "ca")}
    sides = [("a", "b", d2["ab"], d2["bc"], d2["ca"]), ("b", "c", d2["bc"], d2["ca"], d2["ab"]), ("c", "a", d2["ca"], d2["ab"], d2["bc"])]
    return _laplacian_of(faces.withColumn("area", area), sides, scale / 2)


def intrinsic_mean_area(faces: DataFrame, points: DataFrame) -> DataFrame:
    """(plant_id, mean_area): the mean of a third of the faces' area at each point, halved as for the Laplacian."""
    sums = faces.groupBy("plant_id").agg((F.sum(heron_area(F.col("ab"), F.col("bc"), F.col("ca"))) / 2).alias("area"))
    sizes = points.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n")).join(sums, "plant_id", "left")
    return sizes.select("plant_id", (F.coalesce("area", F.lit(0.0)) / F.col("n")).alias("mean_area"))


def intrinsic_edges(faces: DataFrame) -> DataFrame:
    """(plant_id, src, dst), src < dst, of the distinct sides of faces from intrinsic()."""
    return unique_edges(faces).where("src <> dst")
