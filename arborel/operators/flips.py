"""Tufted covers and their intrinsic Delaunay flips as tables, for plants beyond one task.

A row is a face with arrays over its three sides: the corner a side starts at (t), its length
(l), its number (h) and the number of the side it is glued to (w). Sides keep their numbers
and partners through flips, so that a flip rewrites the two faces of a side and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.geometry import dist2, xyz
from arborel.operators.mesh import LEAST_COTAN, MOLLIFY
from arborel.operators.numbering import numbered
from arborel.scratch import discard, materialize

#: What a face's sides 0, 1, 2 are in terms of its triangle's edges ab, bc, ca: of the front and of the back, which runs a, c, b.
FRONT, BACK = (0, 1, 2), (2, 1, 0)


def _at(name: str, turn: Column | int, i: int) -> Column:
    """Item i of a face's array, counted from the side `turn`."""
    return F.element_at(name, F.pmod((F.lit(turn) if isinstance(turn, int) else turn) + i, F.lit(3)) + 1)


def _area(a: Column, b: Column, c: Column) -> Column:
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(1e-300)))


def tufted_faces(tris: DataFrame, points: DataFrame, mollify: float = MOLLIFY) -> DataFrame:
    """(plant_id, face, t, l, h, w): front and back of every triangle, around each edge a front glued to the next one's back.

    Edges grow by what keeps all triangle inequalities in their plant. Triangles that name a
    corner twice are left out. Windows run over the triangles at one edge.
    """
    whole = tris.where("a <> b and b <> c and c <> a").select("plant_id", *[F.col(c).cast("long").alias(c) for c in "abc"])
    named = materialize(numbered(whole, [F.col(c) for c in "abc"], "tri"), "flip-tris")
    front, back = 6 * F.col("tri"), 6 * F.col("tri") + 3
    sides = [F.struct(F.lit(e).alias("edge"), F.col(p).alias("p"), F.col(q).alias("q"), (front + FRONT.index(e)).alias("front"), (back + BACK.index(e)).alias("back")) for e, (p, q) in enumerate(("ab", "bc", "ca"))]
    edges = named.select("plant_id", "tri", F.explode(F.array(*sides)).alias("s")).select("plant_id", "tri", "s.*")
    up = F.col("p") < F.col("q")  # the front runs up
    edges = edges.withColumns({"lo": F.least("p", "q"), "hi": F.greatest("p", "q"), "up": F.when(up, F.col("front")).otherwise(F.col("back")), "down": F.when(up, F.col("back")).otherwise(F.col("front"))})
    for end, name in (("lo", "p_"), ("hi", "q_")):
        edges = edges.join(points.select("plant_id", F.col("point_id").cast("long").alias(end), *[F.col(a).cast("double").alias(f"{name}{a}") for a in "xyz"]), ["plant_id", end])
    fan = Window.partitionBy("plant_id", "lo", "hi")
    ahead, all_of = fan.orderBy("tri"), fan.orderBy("tri").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("plant_id", "tri", "edge", "p", "q", "front", "back", F.sqrt(dist2(xyz("p_"), xyz("q_"))).alias("l"),
        F.coalesce(F.lead("down").over(ahead), F.first("down").over(all_of)).alias("of_up"), F.coalesce(F.lag("up").over(ahead), F.last("up").over(all_of)).alias("of_down"))
    edges = edges.withColumns({"of_front": F.when(up, F.col("of_up")).otherwise(F.col("of_down")), "of_back": F.when(up, F.col("of_down")).otherwise(F.col("of_up"))})
    by_edge = F.sort_array(F.collect_list(F.struct("edge", "p", "q", "l", "front", "back", "of_front", "of_back"))).alias("e")
    wide = materialize(edges.groupBy("plant_id", "tri").agg(by_edge), "flip-wide")
    length = [F.col("e")[i]["l"] for i in range(3)]
    slack = F.greatest(*[length[i] - length[i - 2] - length[i - 1] for i in range(3)])
    grown = wide.groupBy("plant_id").agg((F.max(slack) + mollify * F.sum(length[0] + length[1] + length[2]) / (3 * F.count(F.lit(1)))).alias("more"))
    wide = wide.join(grown.select("plant_id", F.greatest("more", F.lit(0.0)).alias("more")), "plant_id")

    def face(number: Column, order: tuple, start: str, half: str, twin: str) -> Column:
        of = [F.col("e")[e] for e in order]
        return F.struct(number.alias("face"), F.array(*[s[start] for s in of]).alias("t"), F.array(*[s["l"] + F.col("more") for s in of]).alias("l"), F.array(*[s[half] for s in of]).alias("h"), F.array(*[s[twin] for s in of]).alias("w"))

    both = F.array(face(2 * F.col("tri"), FRONT, "p", "front", "of_front"), face(2 * F.col("tri") + 1, BACK, "q", "back", "of_back"))
    return wide.select("plant_id", F.explode(both).alias("f")).select("plant_id", "f.*")


def _sides(faces: DataFrame) -> DataFrame:
    """(plant_id, h, w, face, cotan) of the faces' sides."""
    rows = []
    for i in range(3):
        a, b, c = (_at("l", i, j) for j in range(3))
        rows.append(F.struct(_at("h", i, 0).alias("h"), _at("w", i, 0).alias("w"), F.col("face"), ((b * b + c * c - a * a) / (4 * _area(a, b, c))).alias("cotan")))
    return faces.select("plant_id", F.explode(F.array(*rows)).alias("s")).select("plant_id", "s.*")


def _bad(sides: DataFrame) -> DataFrame:
    """(plant_id, h, g, h_face, g_face, worth): pairs of glued sides to be flipped, h < g, where both are among `sides`."""
    lower = F.col("h") < F.col("w")
    of = [F.sum(F.when(first, F.col("face")).otherwise(F.lit(0))).alias(n) for first, n in ((lower, "h_face"), (~lower, "g_face"))]
    both = sides.groupBy("plant_id", F.least("h", "w").alias("h"), F.greatest("h", "w").alias("g")).agg(*of, F.sum("cotan").alias("worth"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == 2) & (F.col("h_face") != F.col("g_face")) & (F.col("worth") < LEAST_COTAN)).drop("n")


def _now(wanted: DataFrame, faces: DataFrame, touched: DataFrame) -> DataFrame:
    """The faces wanted(plant_id, face) as they are: rows of `touched`, or of the first faces where no flip has changed them."""
    key = ["plant_id", "face"]
    first = wanted.join(touched.select(*key), key, "left_anti")
    return touched.join(wanted, key, "left_semi").unionByName(faces.join(first, key, "left_semi"))


def _bad_around(changed: DataFrame, faces: DataFrame, touched: DataFrame) -> DataFrame:
    """_bad of the sides of changed faces: their partners are in a touched face, or else where they began, in face w div 3."""
    own = materialize(_sides(changed), "flip-sides")
    beyond = own.select("plant_id", F.col("w").alias("h")).join(own.select("plant_id", "h"), ["plant_id", "h"], "left_anti")
    met = materialize(_sides(touched).join(beyond, ["plant_id", "h"], "left_semi"), "flip-met")
    rest = materialize(beyond.join(met.select("plant_id", "h"), ["plant_id", "h"], "left_anti"), "flip-rest")
    homes = rest.select("plant_id", F.expr("h div 3").alias("face")).distinct()
    still = _sides(faces.join(homes, ["plant_id", "face"], "left_semi")).join(rest, ["plant_id", "h"], "left_semi")
    bad = materialize(_bad(own.unionByName(met).unionByName(still)), "flip-bad")
    discard(own, met, rest)
    return bad


def _apart(bad: DataFrame) -> DataFrame:
    """The bad sides that come first, by worth, in both of their faces; no two share a face."""
    ends = bad.select("plant_id", F.explode(F.array("h_face", "g_face")).alias("face"), "worth", "h")
    first = ends.groupBy("plant_id", "face").agg(F.min(F.struct("worth", "h")).alias("f")).select("plant_id", "face", F.col("f.h").alias("h"))
    for end in ("h_face", "g_face"):
        bad = bad.join(first.withColumnRenamed("face", end), ["plant_id", end, "h"], "left_semi")
    return bad.select("plant_id", "h", "g", "h_face", "g_face")


def _flipped(chosen: DataFrame, faces: DataFrame) -> DataFrame:
    """The two new faces of each chosen side, under the numbers of the old ones, which `faces` holds."""
    for side in "hg":
        own = faces.select("plant_id", F.col("face").alias(f"{side}_face"), *[F.col(c).alias(f"{side}{c}") for c in "tlhw"])
        chosen = chosen.join(own, ["plant_id", f"{side}_face"]).withColumn(f"{side}_turn", F.array_position(f"{side}h", F.col(side)).cast("int") - 1)

    def f(name, i):
        return _at(f"h{name}", F.col("h_turn"), i)

    def g(name, i):
        return _at(f"g{name}", F.col("g_turn"), i)

    # h runs u, v with w opposite, g runs v, u with x opposite; afterwards they run x, w and w, x
    uv, vw, wu, ux, xv = f("l", 0), f("l", 1), f("l", 2), g("l", 1), g("l", 2)
    cos_f, cos_g = (uv * uv + wu * wu - vw * vw) / (2 * uv * wu), (uv * uv + ux * ux - xv * xv) / (2 * uv * ux)
    sin_f, sin_g = 2 * _area(uv, vw, wu) / (uv * wu), 2 * _area(g("l", 0), ux, xv) / (uv * ux)
    across = F.sqrt(F.greatest(wu * wu + ux * ux - 2 * wu * ux * (cos_f * cos_g - sin_f * sin_g), F.lit(1e-300)))
    w, x = f("t", 2), g("t", 2)
    new_f = F.struct(F.col("h_face").alias("face"), F.array(x, w, f("t", 0)).alias("t"), F.array(across, wu, ux).alias("l"), F.array(F.col("h"), f("h", 2), g("h", 1)).alias("h"), F.array(F.col("g"), f("w", 2), g("w", 1)).alias("w"))
    new_g = F.struct(F.col("g_face").alias("face"), F.array(w, x, f("t", 1)).alias("t"), F.array(across, xv, vw).alias("l"), F.array(F.col("g"), g("h", 2), f("h", 1)).alias("h"), F.array(F.col("h"), g("w", 2), f("w", 1)).alias("w"))
    return chosen.select("plant_id", F.explode(F.array(new_f, new_g)).alias("n")).select("plant_id", "n.*")


def delaunay_cover(tris: DataFrame, points: DataFrame, mollify: float = MOLLIFY, max_rounds: int = 500) -> DataFrame:
    """(plant_id, a, b, c, ab, bc, ca): tufted_cover of all plants' soups without a plant in a task.

    A round flips bad sides that share no face and looks again at the sides of the faces it
    changed. The first faces stay as they were written; those that flips have changed are a table
    beside them, so that a round writes no more than that. Rounds end when no side is bad, which
    is an error after max_rounds.
    """
    key = ["plant_id", "face"]
    faces = materialize(tufted_faces(tris, points, mollify), "flip-faces")
    bad = materialize(_bad(_sides(faces)), "flip-bad")
    touched = materialize(faces.limit(0), "flip-touched")
    for _ in range(max_rounds):
        if bad.isEmpty():
            done = faces.join(touched.select(*key), key, "left_anti").unionByName(touched)
            corner, side = [_at("t", 0, i) for i in range(3)], [_at("l", 0, i) for i in range(3)]
            return done.select("plant_id", *[c.alias(n) for n, c in zip("abc", corner, strict=True)], *[c.alias(n) for n, c in zip(("ab", "bc", "ca"), side, strict=True)])
        chosen = materialize(_apart(bad), "flip-chosen")
        ends = chosen.select("plant_id", F.explode(F.array("h_face", "g_face")).alias("face"))
        changed = materialize(_flipped(chosen, _now(ends, faces, touched)), "flip-changed")
        before = (touched, bad)
        touched = materialize(touched.join(changed.select(*key), key, "left_anti").unionByName(changed), "flip-touched")
        again, kept = _bad_around(changed, faces, touched), bad
        for end in ("h_face", "g_face"):
            kept = kept.join(changed.select("plant_id", F.col("face").alias(end)), ["plant_id", end], "left_anti")
        bad = materialize(kept.select(*again.columns).unionByName(again), "flip-bad")
        discard(chosen, changed, again, *before)
    raise RuntimeError(f"sides are still to be flipped after {max_rounds} rounds")
