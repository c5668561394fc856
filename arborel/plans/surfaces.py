"""Queries on triangle soups, their Laplacians, the contraction's systems and geodesics."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborel.config import Config
from arborel.functions import geometry as G
from arborel.operators import cloud as C
from arborel.operators import contraction as K
from arborel.operators import dissection, flips, paths
from arborel.operators import mesh as M
from arborel.operators.spatial import knn_join
from arborel.plans.tables import D2, KNN_EDGES, PLANTS, _eigen_sql, _knn_edges, _knn_sql, _plants, _query, _r
from arborel.scratch import materialize

CELLS = ("xx", "yy", "zz", "xy", "xz", "yz")


def _cross(a: str, b: str) -> list[str]:
    return [f"({a}{p} * {b}{q} - {a}{q} * {b}{p})" for p, q in ("yz", "zx", "xy")]


def _rings_sql(k: int, name: str) -> str:
    """name(plant_id, a, b, c), b < c: triangles at each point whose circle in the tangent plane holds no other of its k neighbours.

    Inverted at the point, such a pair is an edge of the hull that has the point on its inner side.
    """
    n = f"{name}_"
    rows = {"u": ("xx - low", "xy", "xz"), "v": ("xy", "yy - low", "yz"), "w": ("xz", "yz", "zz - low")}
    named = ", ".join(f"{e} AS {r}{a}" for r, row in rows.items() for a, e in zip("xyz", row))
    crosses = ", ".join(f"{e} AS {p}{q}{a}" for p, q in ("uv", "uw", "vw") for a, e in zip("xyz", _cross(p, q)))
    size = {c: f"({c}x * {c}x + {c}y * {c}y + {c}z * {c}z)" for c in ("uv", "uw", "vw")}
    pick = ", ".join(f"CASE WHEN {size['uv']} >= {size['uw']} AND {size['uv']} >= {size['vw']} THEN uv{a} WHEN {size['uw']} >= {size['vw']} THEN uw{a} ELSE vw{a} END AS n{a}" for a in "xyz")
    return f"""{_knn_sql(k, "plants", f"{n}knn")},
 {n}nb AS (SELECT k.plant_id, k.point_id, k.nbr_id, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM {n}knn k JOIN plants p ON p.point_id = k.point_id JOIN plants q ON q.point_id = k.nbr_id),
 {n}sc AS (SELECT plant_id, point_id, {", ".join(f"sum(d{c[0]} * d{c[1]}) AS {c}" for c in CELLS)} FROM {n}nb GROUP BY plant_id, point_id),
 {n}normal AS (SELECT plant_id, point_id, {pick} FROM (SELECT plant_id, point_id, {crosses} FROM (SELECT plant_id, point_id, {named} FROM ({_eigen_sql(f"{n}sc", "")})))),
 {n}axis AS (SELECT *, CASE WHEN abs(nx) <= abs(ny) AND abs(nx) <= abs(nz) THEN 1.0 ELSE 0.0 END AS hx, CASE WHEN abs(nx) <= abs(ny) AND abs(nx) <= abs(nz) THEN 0.0 WHEN abs(ny) <= abs(nz) THEN 1.0 ELSE 0.0 END AS hy,
  CASE WHEN abs(nx) <= abs(ny) AND abs(nx) <= abs(nz) THEN 0.0 WHEN abs(ny) <= abs(nz) THEN 0.0 ELSE 1.0 END AS hz
  FROM (SELECT plant_id, point_id, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM {n}normal))),
 {n}first AS (SELECT plant_id, point_id, nx, ny, nz, sx / l AS sx, sy / l AS sy, sz / l AS sz FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM (SELECT *, {", ".join(f"{e} AS s{a}" for a, e in zip("xyz", _cross("n", "h")))} FROM {n}axis))),
 {n}basis AS (SELECT *, {", ".join(f"{e} AS t{a}" for a, e in zip("xyz", _cross("n", "s")))} FROM {n}first),
 {n}flat AS (SELECT plant_id, point_id, nbr_id, g / (g * g + h * h) AS g, h / (g * g + h * h) AS h FROM (
  SELECT b.plant_id, b.point_id, nbr_id, dx * sx + dy * sy + dz * sz AS g, dx * tx + dy * ty + dz * tz AS h FROM {n}nb b JOIN {n}basis USING (plant_id, point_id))),
 {name} AS (SELECT i.plant_id, i.point_id AS a, least(i.nbr_id, j.nbr_id) AS b, greatest(i.nbr_id, j.nbr_id) AS c FROM {n}flat i JOIN {n}flat j ON i.plant_id = j.plant_id AND i.point_id = j.point_id AND i.g * j.h - i.h * j.g > 0
  JOIN {n}flat o ON o.plant_id = i.plant_id AND o.point_id = i.point_id AND o.nbr_id <> i.nbr_id AND o.nbr_id <> j.nbr_id
  GROUP BY i.plant_id, i.point_id, i.nbr_id, j.nbr_id HAVING min((j.g - i.g) * (o.h - i.h) - (j.h - i.h) * (o.g - i.g)) > 0)"""


def _edges_sql(tris: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT plant_id, least(u, v) AS src, greatest(u, v) AS dst FROM (SELECT plant_id, a AS u, b AS v FROM {tris} UNION ALL SELECT plant_id, b, c FROM {tris} UNION ALL SELECT plant_id, c, a FROM {tris}))"


#: The soup of 8 neighbours, points without a triangle attached to their two nearest.
SOUP = f"""{PLANTS}, {_rings_sql(8, "rings")}, used AS (SELECT plant_id, unnest([a, b, c]) AS point_id FROM rings),
 two AS (SELECT plant_id, point_id, min(nbr_id) AS b, max(nbr_id) AS c FROM rings_knn WHERE rank <= 2 GROUP BY plant_id, point_id),
 soup AS (SELECT * FROM rings UNION ALL SELECT plant_id, point_id, b, c FROM two WHERE (plant_id, point_id) NOT IN (SELECT plant_id, point_id FROM used))"""
LEN2 = "(({0}.x - {1}.x) * ({0}.x - {1}.x) + ({0}.y - {1}.y) * ({0}.y - {1}.y) + ({0}.z - {1}.z) * ({0}.z - {1}.z))"
FACES = f"""faces AS (SELECT s.plant_id, s.a, s.b, s.c, {LEN2.format("p", "q")} AS ab, {LEN2.format("q", "r")} AS bc, {LEN2.format("r", "p")} AS ca,
  sqrt(power((q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y), 2) + power((q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z), 2) + power((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x), 2)) / 2 AS area
  FROM soup s JOIN plants p ON p.point_id = s.a JOIN plants q ON q.point_id = s.b JOIN plants r ON r.point_id = s.c)"""
AREAS = f"{SOUP}, {FACES}, shares AS (SELECT plant_id, unnest([a, b, c]) AS point_id, area / 3 AS area FROM faces), areas AS (SELECT p.plant_id, p.point_id, coalesce(sum(area), 0) AS area FROM plants p LEFT JOIN shares s ON s.point_id = p.point_id GROUP BY p.plant_id, p.point_id)"
LAPLACIAN = f"""{SOUP}, {FACES}, sides AS (SELECT plant_id, a AS i, b AS j, (bc + ca - ab) / (8 * area) AS w FROM faces UNION ALL SELECT plant_id, b, c, (ca + ab - bc) / (8 * area) FROM faces UNION ALL SELECT plant_id, c, a, (ab + bc - ca) / (8 * area) FROM faces),
 lap AS (SELECT plant_id, row, col, sum(w) AS val FROM (SELECT plant_id, i AS row, j AS col, w FROM sides UNION ALL SELECT plant_id, j, i, w FROM sides UNION ALL SELECT plant_id, i, i, -w FROM sides UNION ALL SELECT plant_id, j, j, -w FROM sides) GROUP BY plant_id, row, col)"""
ADJACENT = f"""{_rings_sql(4, "four")}, {_edges_sql("four", "near4")},
 edges AS (SELECT e.plant_id, src, dst, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, sqrt{D2} AS length FROM near4 e JOIN plants p ON p.point_id = src JOIN plants q ON q.point_id = dst)"""
HTH = "hth AS (SELECT plant_id, row, col, sum(v)::DOUBLE AS val FROM (SELECT plant_id, src AS row, src AS col, 1.0 AS v FROM edges UNION ALL SELECT plant_id, dst, dst, 1.0 FROM edges UNION ALL SELECT plant_id, src, dst, -1.0 FROM edges UNION ALL SELECT plant_id, dst, src, -1.0 FROM edges) GROUP BY plant_id, row, col)"


def _eliminate_sql(matrix: str, right: str, names: tuple[str, ...]) -> str:
    """solved(plant_id, row, names): matrix(plant_id, row, col, val) against right(plant_id, row, names), by elimination without pivoting (for positive definite ones)."""
    return f"""placed AS (SELECT plant_id, point_id, row_number() OVER (PARTITION BY plant_id ORDER BY point_id) AS i FROM plants),
 cells AS (SELECT r.plant_id, r.i, list(coalesce(m.val, 0.0) ORDER BY c.i) AS cells FROM placed r JOIN placed c ON c.plant_id = r.plant_id LEFT JOIN {matrix} m ON m.plant_id = r.plant_id AND m.row = r.point_id AND m.col = c.point_id GROUP BY r.plant_id, r.i),
 system AS (SELECT c.plant_id, list(c.cells || [{", ".join(f"b.{n}" for n in names)}] ORDER BY c.i) AS m, list(p.point_id ORDER BY c.i) AS ids FROM cells c JOIN placed p ON p.plant_id = c.plant_id AND p.i = c.i JOIN {right} b ON b.plant_id = c.plant_id AND b.row = p.point_id GROUP BY c.plant_id),
 eliminated(plant_id, k, m) AS (SELECT plant_id, 1, m FROM system UNION ALL
  SELECT plant_id, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END) FROM eliminated WHERE k <= len(m)),
 solved AS (SELECT plant_id, ids[i] AS row, {", ".join(f"m[i][len(m) + {at}] AS {n}" for at, n in enumerate(names, 1))} FROM (
  SELECT e.plant_id, e.m, s.ids, unnest(range(1, len(e.m) + 1)) AS i FROM eliminated e JOIN system s USING (plant_id) WHERE e.k = len(s.ids) + 1))"""


def _cut(most: float) -> list[str]:
    return [f"d{a} * CASE WHEN length > {most} THEN {most} / length ELSE 1.0 END" for a in "xyz"]


def _soup(spark, d):
    p, soup, _ = _soup_near(spark, d)
    return p, soup


def _soup_near(spark, d):
    """Points, their soup and the 8 neighbours that its triangles, its orphans and other matrices of the points share."""
    p = _plants(spark, d)
    near = materialize(knn_join(p, p, 8, exclude_self=True), "soup-near", merged=True)
    soup = materialize(M.local_triangles(p, 8, near), "soup", merged=True)
    return p, materialize(M.attach_orphans(soup, p, near), "soup", merged=True), near


@_query(f"WITH {SOUP} SELECT plant_id, a, b, c FROM soup")
def local_triangles(spark, d):
    return _soup(spark, d)[1].select("plant_id", "a", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"))


@_query(f"WITH {SOUP}, {_edges_sql('soup', 'sides')} SELECT e.plant_id, src, dst, round(sqrt{D2}, 6) AS length FROM sides e JOIN plants p ON p.point_id = src JOIN plants q ON q.point_id = dst")
def mesh_edges(spark, d):
    p, soup = _soup(spark, d)
    return M.mesh_edges(soup, p).select("plant_id", "src", "dst", *_r("length"))


LONG = f"{SOUP}, {FACES}, cut AS (SELECT plant_id, avg(sqrt(ab)) AS cut FROM faces GROUP BY plant_id), short AS (SELECT f.plant_id, a, b, c FROM faces f JOIN cut USING (plant_id) WHERE sqrt(greatest(ab, bc, ca)) < cut)"


def _short(spark, d):
    p, soup = _soup(spark, d)
    soup = materialize(soup.select("plant_id", "a", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c")), "soup")
    ab = F.sqrt(G.dist2(G.xyz("a"), G.xyz("b")))
    cut = M.with_corners(soup, p).groupBy("plant_id").agg(F.avg(ab).alias("threshold"))
    return p, materialize(M.drop_long_triangles(soup, p, cut), "short")


@_query(f"WITH {LONG} SELECT plant_id, a, b, c FROM short")
def drop_long_triangles(spark, d):
    """Triangles with an edge as long as the mean first side go."""
    return _short(spark, d)[1]


@_query(f"WITH {LONG}, held AS (SELECT plant_id, unnest([a, b, c]) AS point_id FROM short) SELECT plant_id, point_id AS a, b, c FROM two WHERE (plant_id, point_id) NOT IN (SELECT plant_id, point_id FROM held)")
def attach_orphans(spark, d):
    """The triangles that points outside all short ones get."""
    p, short = _short(spark, d)
    new = M.attach_orphans(short, p).select("plant_id", "a", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"))
    return new.join(short, ["plant_id", "a", "b", "c"], "left_anti")


@_query(f"WITH {AREAS} SELECT plant_id, point_id, round(area, 6) AS area FROM areas")
def vertex_areas(spark, d):
    p, soup = _soup(spark, d)
    return M.vertex_areas(soup, p).select("plant_id", "point_id", *_r("area"))


@_query(f"WITH {AREAS} SELECT plant_id, round(avg(area), 6) AS mean_area FROM areas GROUP BY plant_id")
def mean_dual_area(spark, d):
    p, soup = _soup(spark, d)
    return M.mean_area(soup, p).select("plant_id", *_r("mean_area"))


@_query(f"WITH {LAPLACIAN} SELECT plant_id, row, col, round(val, 6) + 0.0 AS val FROM lap")
def cotan_laplacian(spark, d):
    p, soup = _soup(spark, d)
    return M.laplacian(soup, p).select("plant_id", "row", "col", *_r("val"))


@_query(f"WITH {LAPLACIAN} SELECT plant_id, round(count(*) / (SELECT count(*) FROM plants p WHERE p.plant_id = lap.plant_id), 6) AS mean_row_size FROM lap GROUP BY plant_id")
def mean_row_size(spark, d):
    p, soup = _soup(spark, d)
    return K.mean_row_size(M.laplacian(soup, p), p).select("plant_id", *_r("mean_row_size"))


@_query(f"WITH {PLANTS}, {ADJACENT} SELECT plant_id, src, dst FROM edges")
def laplacian_adjacency(spark, d):
    return K.adjacency(_plants(spark, d))


@_query(f"""WITH {PLANTS}, {ADJACENT} SELECT plant_id, src, dst, {", ".join(f"round({e}, 6) + 0.0 AS e{a}" for a, e in zip("xyz", _cut(0.1)))} FROM edges""")
def distance_constraint(spark, d):
    return K.distance_constraints(_plants(spark, d), 0.1).select("plant_id", "src", "dst", *_r("ex", "ey", "ez"))


@_query(f"WITH {PLANTS}, {ADJACENT}, {HTH} SELECT plant_id, row, col, val FROM hth")
def normal_matrix_coo(spark, d):
    return K.normal_matrix(K.stack(materialize(K.constraint_rows(K.distance_constraints(_plants(spark, d), 0.1)), "coo")))


SPD = f"""WITH RECURSIVE {PLANTS}, {ADJACENT}, {HTH}, m AS (SELECT plant_id, row, col, val + CASE WHEN row = col THEN 1.0 ELSE 0.0 END AS val FROM hth), b AS (SELECT plant_id, point_id AS row, z AS x FROM plants),
 {_eliminate_sql("m", "b", ("x",))} SELECT plant_id, row, round(x, 6) + 0.0 AS x FROM solved"""


def _spd(spark, d):
    p = _plants(spark, d)
    a = K.normal_matrix(materialize(K.constraint_rows(K.distance_constraints(p, 0.1)), "coo"))
    a = a.withColumn("val", F.col("val") + F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0))
    return p, a


@_query(SPD)
def spd_solve(spark, d):
    p, a = _spd(spark, d)
    return K.solve_spd(a, p.select("plant_id", F.col("point_id").alias("row"), F.col("z").alias("b"))).select("plant_id", "row", *_r("x"))


@_query(SPD)
def spd_solve_dissected(spark, d):
    """The same systems by nested dissection, with leaves of 32 points so that plants of every size are cut."""
    p, a = _spd(spark, d)
    rows = p.select("plant_id", F.col("point_id").alias("row"), "x", "y", "z")
    return dissection.solve(a, rows.select("plant_id", "row", F.col("z").alias("x")), rows, leaf=32).select("plant_id", "row", *_r("x"))


#: One step's normal equations: WL is 1 but 2 for even ids, WH is 1 but 9 for the lowest point, and WD is 9.
STEP = f"""{LAPLACIAN}, {ADJACENT}, {HTH}, low AS (SELECT arg_min(point_id, (z, point_id)) AS tip FROM plants GROUP BY plant_id),
 w AS (SELECT plant_id, point_id, CASE WHEN point_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS wl, CASE WHEN point_id IN (SELECT tip FROM low) THEN 9.0 ELSE 1.0 END AS wh FROM plants),
 pulls AS (SELECT l.plant_id, l.row, l.col, l.val * w.wl AS val FROM lap l JOIN w ON w.point_id = l.row),
 m AS (SELECT plant_id, row, col, sum(val) AS val FROM (SELECT p.plant_id, p.col AS row, q.col, p.val * q.val AS val FROM pulls p JOIN pulls q ON q.row = p.row UNION ALL SELECT plant_id, point_id, point_id, wh * wh FROM w UNION ALL SELECT plant_id, row, col, 81 * val FROM hth) GROUP BY plant_id, row, col),
 b AS (SELECT plant_id, row, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM (SELECT p.plant_id, p.point_id AS row, wh * wh * x AS x, wh * wh * y AS y, wh * wh * z AS z FROM plants p JOIN w USING (point_id)
  UNION ALL SELECT plant_id, src, {", ".join(f"81 * {e}" for e in _cut(0.05))} FROM edges UNION ALL SELECT plant_id, dst, {", ".join(f"-81 * {e}" for e in _cut(0.05))} FROM edges) GROUP BY plant_id, row)"""


def _step(spark, d):
    p, soup, near = _soup_near(spark, d)
    weights = K.initial_weights(p, C.lowest_point(p)).withColumn("wl", F.when(F.col("point_id") % 2 == 0, 2.0).otherwise(1.0))
    return p, weights, materialize(M.laplacian(soup, p), "laplacian", merged=True), materialize(K.distance_constraints(p, 0.05, near=near), "constraints", merged=True)


@_query(f"WITH {STEP} SELECT plant_id, row, col, round(val / (1 + abs(val)), 6) + 0.0 AS share FROM m")
def stacked_normal_matrix(spark, d):
    """The normal matrix of the stacked system, each value v as v / (1 + |v|)."""
    a, _ = K.stacked_system(*_step(spark, d))
    return K.normal_matrix(a).select("plant_id", "row", "col", (F.col("val") / (1 + F.abs("val"))).alias("share")).select("plant_id", "row", "col", *_r("share"))


@_query(f"WITH {STEP} SELECT plant_id, row, round(x, 6) + 0.0 AS bx, round(y, 6) + 0.0 AS by, round(z, 6) + 0.0 AS bz FROM b")
def stacked_rhs(spark, d):
    a, b = K.stacked_system(*_step(spark, d))
    return K.normal_rhs(a, b).select("plant_id", "row", *_r("bx", "by", "bz"))


@_query(f"""WITH RECURSIVE {STEP}, {_eliminate_sql("m", "b", ("x", "y", "z"))} SELECT plant_id, row AS point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM solved""")
def contraction_step(spark, d):
    return K.contract_once(*_step(spark, d)).select("plant_id", "point_id", *_r("x", "y", "z"))


#: Of the loop's query: what fits clouds of points spread over a box.
LOOP = Config(max_iterations=3, knn=8, knn_step=2, knn_most=12, area_knn=10, sigma_radius=0.1, max_distance=0.03, tip_neighbours=12, geodesic="graph", intrinsic=False, normalize_length=1.0)


@_query()
def contraction_loop(spark, d):
    """The whole loop over all plants: each one's log; tests hold it against a dense re-run."""
    return K.contract(_plants(spark, d), LOOP, last_sigma=False)[1].select("plant_id", "iter", *_r("ratio"), "done")


#: Shortest paths over 8 neighbours from each plant's lowest point, relaxed hop by hop.
GEODESIC = f"""WITH RECURSIVE {PLANTS}, {_knn_sql(8)}, steps2 AS (SELECT DISTINCT plant_id, a, b, w FROM (SELECT plant_id, point_id AS a, nbr_id AS b, sqrt(d2) AS w FROM knn UNION ALL SELECT plant_id, nbr_id, point_id, sqrt(d2) FROM knn)),
 placed AS (SELECT plant_id, point_id, z, row_number() OVER (PARTITION BY plant_id ORDER BY point_id) AS i FROM plants),
 near AS (SELECT p.plant_id, p.i, list({{'j': q.i, 'w': w}}) AS steps FROM steps2 e JOIN placed p ON p.point_id = e.a JOIN placed q ON q.point_id = e.b GROUP BY p.plant_id, p.i),
 nets AS (SELECT n.plant_id, list(steps ORDER BY n.i) AS net, list(p.point_id ORDER BY n.i) AS ids, arg_min(n.i, (p.z, p.point_id)) AS low, count(*) AS n FROM near n JOIN placed p ON p.plant_id = n.plant_id AND p.i = n.i GROUP BY n.plant_id),
 relaxed(plant_id, step, d) AS (SELECT plant_id, 0, list_transform(range(1, n + 1), lambda i: CASE WHEN i = low THEN 0.0 ELSE 1e300 END) FROM nets UNION ALL
  SELECT r.plant_id, step + 1, list_transform(net, lambda s, i: least(d[i], list_min(list_transform(s, lambda e: d[e.j] + e.w)))) FROM relaxed r JOIN nets USING (plant_id) WHERE step < n)
SELECT plant_id, point_id, round(value, 6) + 0.0 AS value FROM (SELECT r.plant_id, unnest(ids) AS point_id, unnest(d) AS value FROM relaxed r JOIN nets USING (plant_id) WHERE step = n) WHERE value < 1e299"""


@_query(f"""WITH {SOUP}, {FACES}, sides AS (SELECT plant_id, sqrt(ab) AS a, sqrt(bc) AS b, sqrt(ca) AS c FROM faces),
 more AS (SELECT plant_id, greatest(0, max(greatest(a - b - c, b - c - a, c - a - b)) + {M.MOLLIFY} * avg((a + b + c) / 3)) AS m FROM sides GROUP BY plant_id),
 grown AS (SELECT plant_id, a + m AS a, b + m AS b, c + m AS c, (a + b + c + 3 * m) / 2 AS s FROM sides JOIN more USING (plant_id))
SELECT plant_id, 2 * count(*) AS faces, round(sum(2 * sqrt(s * (s - a) * (s - b) * (s - c))), 6) AS area, 0 AS bad FROM grown GROUP BY plant_id""")
def delaunay_cover(spark, d):
    """Faces, area and bad sides of the flipped covers: flips keep the first two and leave none of the last; tests hold them against the kernel."""
    p, soup = _soup(spark, d)
    faces = materialize(flips.delaunay_cover(soup, p), "cover")
    own = faces.groupBy("plant_id").agg(F.count(F.lit(1)).alias("faces"), F.sum(G.heron_area(F.col("ab"), F.col("bc"), F.col("ca"))).alias("area"))
    off = M.intrinsic_laplacian(faces).where("row <> col").groupBy("plant_id").agg(F.sum(F.when(F.col("val") < -1e-6, 1).otherwise(0)).alias("bad"))
    return own.join(off, "plant_id").select("plant_id", "faces", *_r("area"), F.col("bad").cast("int").alias("bad"))


@_query(GEODESIC)
def geodesic_from_root(spark, d):
    """Rounds count the borders between patches that a path crosses, not its hops."""
    p = _plants(spark, d)
    return paths.patch_distance(p, C.lowest_point(p)).select("plant_id", "point_id", *_r("value"))


@_query(GEODESIC)
def geodesic_patches(spark, d):
    """The same distances, a patch of points at a time."""
    p = _plants(spark, d)
    return paths.patch_distance(p, C.lowest_point(p)).select("plant_id", "point_id", *_r("value"))


@_query()
def geodesic_heat(spark, d):
    """The heat method's distances; tests hold it against distances along a sheet."""
    p = _plants(spark, d)
    return K.heat_distance(p, C.lowest_point(p)).select("plant_id", "point_id", *_r("value"))


@_query(f"WITH {KNN_EDGES}, n AS (SELECT plant_id, point_id, nbr_id FROM knn WHERE rank = 1) SELECT n.plant_id, n.point_id, round(q.x - p.x, 6) + 0.0 AS x, round(q.y - p.y, 6) + 0.0 AS y, 0.0::DOUBLE AS z FROM n JOIN plants p ON p.point_id = n.point_id JOIN plants q ON q.point_id = n.nbr_id")
def tangent_part(spark, d):
    """The step to the nearest neighbour without its part along z."""
    p = _plants(spark, d)
    pairs = K._pairs(knn_join(p, p, 1, exclude_self=True), p)
    flat = G.without_component(G.sub(G.xyz("n_"), G.xyz("p_")), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return pairs.select("plant_id", "point_id", *[c.alias(a) for a, c in zip("xyz", flat, strict=True)]).select("plant_id", "point_id", *_r("x", "y", "z"))


@_query(f"WITH {KNN_EDGES} SELECT plant_id, count(*) AS edges, round(sum(length), 6) AS length FROM edges GROUP BY plant_id")
def neighbour_graph_length(spark, d):
    return _knn_edges(spark, d).groupBy("plant_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("length").alias("length")).select("plant_id", "edges", *_r("length"))
