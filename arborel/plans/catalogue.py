"""Registered queries over the driver's tables, with their SQL.

Clouds come from embeddings: the first three components are coordinates, the label names the
plant (or all points are one plant). Segmentations come from labels with documents and from
lineitem. Doubles are rounded to six places on both sides. Meshes and trees have modules of
their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arborel.functions import geometry as G
from arborel.operators import cloud as C
from arborel.operators import contraction as K
from arborel.operators import evaluate as E
from arborel.operators import graph as R
from arborel.operators import mesh as M
from arborel.operators import spacing as N
from arborel.operators import spatial as S
from arborel.plans.tables import (
    A3, B3, C3, CENTROIDS, D2, FORWARD, INST, KNN_EDGES, L1, LOP_H, ONE, PLANTS, RADIUS, SAMPLES, SEG_M, SIDE, SIGMA_RADIUS, TRI, _centroids, _eigen_sql, _FOUND, _inst, _knn_edges, _knn_sql, _one, _plants, _query, _r, _seg, _sigma_sql, _skeleton,
)
from arborel.scratch import materialize
from arborel.sources import folders, text


@_query(f"""WITH {PLANTS}, box AS (SELECT plant_id, (max(x) + min(x)) / 2 AS cx, (max(y) + min(y)) / 2 AS cy, (max(z) + min(z)) / 2 AS cz, 1.6 / greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS scale FROM plants GROUP BY plant_id)
SELECT plant_id, point_id, round((x - cx) * scale, 6) + 0.0 AS x, round((y - cy) * scale, 6) + 0.0 AS y, round((z - cz) * scale, 6) + 0.0 AS z FROM plants JOIN box USING (plant_id)""")
def normalize_aabb(spark, d):
    return C.normalize(_plants(spark, d)).select("plant_id", "point_id", *_r("x", "y", "z"))


@_query(f"WITH {PLANTS} SELECT plant_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM plants")
def unnormalize_roundtrip(spark, d):
    return C.unnormalize(C.normalize(_plants(spark, d))).select("plant_id", "point_id", *_r("x", "y", "z"))


@_query(f"WITH {PLANTS}, {_knn_sql(8)} SELECT plant_id, point_id, nbr_id, rank, round(d2, 6) AS d2 FROM knn")
def knn_8(spark, d):
    p = _plants(spark, d)
    return S.knn_join(p, p, 8, exclude_self=True).select("plant_id", "point_id", "nbr_id", "rank", *_r("d2"))


@_query(f"WITH {PLANTS}, {_knn_sql(8)} SELECT plant_id, round(avg(sqrt(d2)), 6) AS spacing FROM knn GROUP BY plant_id")
def knn_mean_spacing(spark, d):
    return S.mean_spacing(_plants(spark, d)).select("plant_id", *_r("spacing"))


@_query(f"""WITH {PLANTS}, {_knn_sql(30)}, top AS (SELECT k.plant_id, k.point_id, max(q.z) AS top FROM knn k JOIN plants q ON q.point_id = k.nbr_id GROUP BY ALL)
SELECT p.plant_id, p.point_id FROM plants p JOIN top USING (plant_id, point_id) WHERE p.z > top UNION SELECT plant_id, arg_min(point_id, (z, point_id)) FROM plants GROUP BY plant_id""")
def knn_tip_local_max(spark, d):
    p = _plants(spark, d)
    return C.tips(p.select("plant_id", "point_id", F.col("z").alias("value")), p, 30)


@_query(f"WITH {ONE} SELECT p.point_id, count(*) AS n FROM one p JOIN one q ON {D2} <= {RADIUS**2!r} GROUP BY p.point_id")
def radius_count(spark, d):
    p = _one(spark, d)
    return S.radius_join(p, p, RADIUS).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {ONE} SELECT p.point_id, q.point_id AS nbr_id, round({D2}, 6) AS d2 FROM one p JOIN one q ON {D2} <= {RADIUS**2!r}")
def radius_pairs_grid(spark, d):
    p = _one(spark, d)
    return S.radius_join(p, p, RADIUS).select("point_id", "nbr_id", *_r("d2"))


@_query(f"""WITH {ONE}, {_knn_sql(3, "one")}, near AS (SELECT p.point_id, q.point_id AS nbr_id FROM one p JOIN one q ON {D2} <= {RADIUS**2!r}), n AS (SELECT point_id, count(*) AS n FROM near GROUP BY point_id)
SELECT point_id, nbr_id FROM near JOIN n USING (point_id) WHERE n >= 3 UNION ALL SELECT point_id, nbr_id FROM knn JOIN n USING (point_id) WHERE n < 3""")
def radius_with_fallback(spark, d):
    p = _one(spark, d)
    return S.with_fallback(S.radius_join(p, p, RADIUS), p).select("point_id", "nbr_id")


@_query(f"""WITH {CENTROIDS}, {ONE}, near AS (SELECT p.point_id, arg_min(q.point_id, ({D2}, q.point_id)) AS v FROM one p, centroids q GROUP BY p.point_id)
SELECT point_id, (v - 1)::BIGINT AS instance, CASE WHEN v = 0 THEN 0 ELSE 1 END AS semantic FROM near""")
def nearest_label_transfer(spark, d):
    v = materialize(_centroids(spark, d).withColumnRenamed("point_id", "vertex_id"), "transfer")
    labels = v.select("plant_id", "vertex_id", (F.col("vertex_id") - 1).alias("instance"))
    return R.project_labels(_one(spark, d), v, labels).select("point_id", "instance", "semantic")


@_query(f"WITH {_sigma_sql()} SELECT point_id, round(sigma, 6) AS sigma FROM sig")
def sigma_linearness(spark, d):
    return K.sigma(_one(spark, d), SIGMA_RADIUS).select("point_id", *_r("sigma"))


def _smooth(spark, d):
    return K.linearness(_one(spark, d), SIGMA_RADIUS, 0.9)


@_query(f"WITH {_sigma_sql()} SELECT point_id, round(sigma, 6) AS sigma, round(smooth_sigma, 6) AS smooth_sigma FROM smooth")
def sigma_smooth(spark, d):
    return _smooth(spark, d).select("point_id", *_r("sigma", "smooth_sigma"))


@_query(f"""WITH {_sigma_sql()}, low AS (SELECT arg_min(point_id, (z, point_id)) AS tip FROM one)
SELECT point_id, CASE WHEN point_id = tip THEN 1.0 WHEN smooth_sigma >= 0.7 THEN 0.0 WHEN smooth_sigma >= 0.6 THEN 1.0 ELSE 3.0 END::DOUBLE AS wl,
 CASE WHEN point_id = tip THEN 9.0 WHEN smooth_sigma >= 0.7 THEN 3.0 ELSE 1.0 END::DOUBLE AS wh FROM smooth, low""")
def adaptive_weights(spark, d):
    p = _one(spark, d)
    start = K.initial_weights(p, C.lowest_point(p))
    smooth = _smooth(spark, d).select("plant_id", "point_id", "smooth_sigma")
    return K.adapt_weights(start.join(smooth, ["plant_id", "point_id"]), 0.7).select("point_id", "wl", "wh")


@_query(f"""WITH {CENTROIDS}, {ONE}, near AS (SELECT p.point_id, q.x, q.y, q.z, exp(-(({L1} + 1e-8) * ({L1} + 1e-8)) / {(LOP_H / 4) ** 2!r}) / ({L1} + 1e-8) AS a FROM centroids p JOIN one q ON {D2} <= {LOP_H**2!r}),
 s AS (SELECT point_id, sum(a) AS w, sum(a * x) AS sx, sum(a * y) AS sy, sum(a * z) AS sz FROM near GROUP BY point_id)
SELECT point_id, round(CASE WHEN w > 0 THEN sx / w ELSE x END, 6) + 0.0 AS x, round(CASE WHEN w > 0 THEN sy / w ELSE y END, 6) + 0.0 AS y, round(CASE WHEN w > 0 THEN sz / w ELSE z END, 6) + 0.0 AS z FROM centroids LEFT JOIN s USING (point_id)""")
def lop_calibrate(spark, d):
    return K.lop_calibrate(materialize(_centroids(spark, d), "lop"), _one(spark, d), LOP_H).select("point_id", *_r("x", "y", "z"))


@_query("""SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY l_returnflag) USING (l_returnflag) WHERE l_extendedprice - m > 1.5::DOUBLE * s""")
def upper_outliers(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return C.upper_outliers(li, "l_extendedprice", ["l_returnflag"], 1.5).select("l_orderkey", "l_linenumber", "l_returnflag")


@_query(f"WITH {KNN_EDGES}, s AS (SELECT plant_id, avg(length) AS m, stddev_pop(length) AS s FROM edges GROUP BY plant_id) SELECT plant_id, round(min(length) FILTER (length - m > 3 * s), 6) AS threshold FROM edges JOIN s USING (plant_id) GROUP BY plant_id")
def edge_threshold(spark, d):
    return M.edge_threshold(materialize(_knn_edges(spark, d), "edges")).select("plant_id", *_r("threshold"))


@_query(f"WITH {PLANTS} SELECT plant_id, round(covar_samp(x, x), 6) + 0.0 AS xx, round(covar_samp(y, y), 6) + 0.0 AS yy, round(covar_samp(z, z), 6) + 0.0 AS zz, round(covar_samp(x, y), 6) + 0.0 AS xy, round(covar_samp(x, z), 6) + 0.0 AS xz, round(covar_samp(y, z), 6) + 0.0 AS yz FROM plants GROUP BY plant_id")
def covariance3(spark, d):
    return C.covariance(_plants(spark, d)).select("plant_id", *_r("xx", "yy", "zz", "xy", "xz", "yz"))


COV = "SELECT plant_id, " + ", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM plants GROUP BY plant_id"


@_query(f"WITH {PLANTS}, cov AS ({COV}) SELECT plant_id, round(low, 6) + 0.0 AS low, round(3 * q - high - low, 6) + 0.0 AS mid, round(high, 6) + 0.0 AS high FROM ({_eigen_sql('cov', '')})")
def eigenvalues3(spark, d):
    cov = C.covariance(_plants(spark, d))
    values = G.symmetric_eigenvalues(*[F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return cov.select("plant_id", *[v.alias(n) for v, n in zip(values, ("low", "mid", "high"), strict=True)]).select("plant_id", *_r("low", "mid", "high"))


@_query(f"""WITH RECURSIVE {ONE}, lists AS (SELECT list(point_id ORDER BY point_id) AS ids, list(x ORDER BY point_id) AS xs, list(y ORDER BY point_id) AS ys, list(z ORDER BY point_id) AS zs, count(*) AS n FROM one),
 f(pos, cur, far) AS (SELECT 0, (42 % n + 1)::BIGINT, list_transform(range(n), lambda i: 1e300) FROM lists
  UNION ALL SELECT pos + 1, list_position(far, list_max(far))::BIGINT, far FROM (SELECT pos, list_transform(range(1, n + 1), lambda i: CASE WHEN i = cur OR far[i] < 0 THEN -1.0 ELSE least(far[i], (xs[i] - xs[cur]) * (xs[i] - xs[cur]) + (ys[i] - ys[cur]) * (ys[i] - ys[cur]) + (zs[i] - zs[cur]) * (zs[i] - zs[cur])) END) AS far FROM f, lists WHERE pos < 49))
SELECT pos::BIGINT AS pos, ids[cur] AS point_id FROM f, lists""")
def fps_50(spark, d):
    return C.farthest_points(_one(spark, d), m=50).select("pos", "point_id")


SIZE = "((b.low + b.high) / 2)"


@_query(f"""WITH RECURSIVE {PLANTS}, sizes AS (SELECT plant_id, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM plants GROUP BY plant_id),
 halved(plant_id, round, low, high, best) AS (SELECT plant_id, 0, 0.0::DOUBLE, extent + 1e-12, 0.0::DOUBLE FROM sizes WHERE n > 24 UNION ALL
  SELECT plant_id, round + 1, CASE WHEN kept >= 24 THEN size ELSE low END, CASE WHEN kept >= 24 AND kept > 24 * 1.05::DOUBLE THEN high ELSE size END, CASE WHEN kept >= 24 THEN size ELSE best END
  FROM (SELECT b.plant_id, b.round, b.low, b.high, b.best, {SIZE} AS size, count(DISTINCT [floor(p.x / {SIZE}), floor(p.y / {SIZE}), floor(p.z / {SIZE})]) AS kept FROM halved b JOIN plants p USING (plant_id) WHERE b.round < 24 AND b.low < b.high GROUP BY ALL)),
 final AS (SELECT plant_id, arg_max(best, round) AS best FROM halved GROUP BY plant_id),
 voxels AS (SELECT p.*, floor(x / best) AS vx, floor(y / best) AS vy, floor(z / best) AS vz FROM plants p JOIN final USING (plant_id)),
 means AS (SELECT plant_id, vx, vy, vz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM voxels GROUP BY plant_id, vx, vy, vz),
 kept AS (SELECT plant_id, arg_min(point_id, ((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), point_id)) AS point_id FROM voxels JOIN means USING (plant_id, vx, vy, vz) GROUP BY plant_id, vx, vy, vz),
 held AS (SELECT p.* FROM plants p JOIN kept USING (plant_id, point_id)),
 spaced AS (SELECT p.plant_id, p.point_id, p.x, p.y, p.z, min({D2}) AS d2 FROM held p JOIN held q ON p.plant_id = q.plant_id AND p.point_id <> q.point_id GROUP BY p.plant_id, p.point_id, p.x, p.y, p.z),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY d2 DESC, point_id) AS rank FROM spaced)
SELECT plant_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM ranked WHERE rank <= 24""")
def uniform_downsample(spark, d):
    return C.uniform_downsample(_plants(spark, d), 24).select("plant_id", "point_id", *_r("x", "y", "z"))


#: The greedy order of spaced points: each is kept unless a kept one is nearer than the spacing.
TURNS = f"{PLANTS}, turned AS (SELECT *, ('0x' || substr(md5(point_id::VARCHAR), 1, 8))::BIGINT AS turn FROM plants), ordered AS (SELECT plant_id, count(*) AS n, list({{'id': point_id, 'x': x, 'y': y, 'z': z}} ORDER BY turn, point_id) AS pts FROM turned GROUP BY plant_id)"
NEARER = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"


def _greedy(spacing: str) -> str:
    return f"list_reduce(pts, lambda kept, p: CASE WHEN len(list_filter(kept, lambda q: {NEARER} < {spacing} * {spacing})) > 0 THEN kept ELSE list_append(kept, p) END, pts[:0])"


@_query(f"WITH {TURNS} SELECT plant_id, unnest({_greedy('0.15::DOUBLE')}).id AS point_id FROM ordered")
def spaced_points(spark, d):
    return N.spaced_points(_plants(spark, d), 0.15)


@_query(f"""WITH RECURSIVE {TURNS}, {_knn_sql(1)}, start AS (SELECT plant_id, pow(2.0::DOUBLE, floor(log2(1.17::DOUBLE * avg(sqrt(d2))))) AS start FROM knn GROUP BY plant_id),
 tried(plant_id, round, low, high, gap, best) AS (SELECT plant_id, 0, 0.0::DOUBLE, NULL::DOUBLE, start, pts FROM start JOIN ordered USING (plant_id) WHERE n > 24 UNION ALL
  SELECT plant_id, round + 1, low, high, CASE WHEN len(kept) BETWEEN 24 AND 25 OR high - low <= high / 1024 OR high <= start / 1024 THEN NULL WHEN high IS NULL THEN 2 * gap ELSE (low + high) / 2 END, best FROM (
   SELECT plant_id, round, gap, start, kept, CASE WHEN len(kept) >= 24 THEN gap ELSE low END AS low, CASE WHEN len(kept) < 24 THEN gap ELSE high END AS high, CASE WHEN len(kept) >= 24 THEN kept ELSE best END AS best
   FROM (SELECT t.plant_id, t.round, s.start, t.low, t.high, t.gap, t.best, {_greedy("t.gap")} AS kept FROM tried t JOIN ordered o USING (plant_id) JOIN start s USING (plant_id) WHERE t.round < 40 AND t.gap IS NOT NULL))),
 held AS (SELECT plant_id, unnest(best, recursive := true) FROM (SELECT plant_id, arg_max(best, round) AS best FROM tried GROUP BY plant_id)),
 spaced AS (SELECT p.plant_id, p.id, min({NEARER}) AS d2 FROM held p JOIN held q ON p.plant_id = q.plant_id AND p.id <> q.id GROUP BY p.plant_id, p.id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY d2 DESC, id) AS rank FROM spaced)
SELECT plant_id, id AS point_id FROM ranked WHERE rank <= 24 UNION ALL SELECT plant_id, point_id FROM plants JOIN ordered USING (plant_id) WHERE n = 24""")
def spaced_downsample(spark, d):
    return N.spaced_downsample(_plants(spark, d), 24).select("plant_id", "point_id")


@_query(f"WITH {SEG_M} SELECT plant_id, class, tp, fp, fn, n FROM c")
def semantic_confusion(spark, d):
    return E.semantic_counts(_seg(spark, d)).select("plant_id", "class", "tp", "fp", "fn", "n")


@_query(f"WITH {SEG_M} SELECT plant_id, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(iou, 6) AS iou FROM m")
def semantic_prf_iou(spark, d):
    return E.semantic_metrics(_seg(spark, d)).select("plant_id", "class", *_r("precision", "recall", "f1", "iou"))


@_query(f"""WITH {SEG_M}, plants AS (SELECT plant_id, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(iou) AS iou FROM m GROUP BY plant_id),
 acc AS (SELECT plant_id, avg((pred_sem = gt_sem)::INT) AS accuracy FROM seg GROUP BY plant_id),
 tidy AS (SELECT 'precision' AS metric, precision AS v FROM plants UNION ALL SELECT 'recall', recall FROM plants UNION ALL SELECT 'f1', f1 FROM plants UNION ALL SELECT 'iou', iou FROM plants UNION ALL SELECT 'accuracy', accuracy FROM acc)
SELECT metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std FROM tidy GROUP BY metric""")
def semantic_overall(spark, d):
    return E.semantic_overall(_seg(spark, d)).select("metric", *_r("mean", "std"))


@_query(f"WITH {INST} SELECT plant_id, inst::INT AS inst, class::INT AS class, size FROM gt")
def instance_mode_class(spark, d):
    return E.instance_class(_inst(spark, d), "gt").select("plant_id", F.col("inst").cast("int").alias("inst"), F.col("class").cast("int").alias("class"), "size")


@_query(f"WITH {INST} SELECT plant_id, class::INT AS class, pred::INT AS pred, gt::INT AS gt, round(iou, 6) AS iou FROM iou")
def instance_iou(spark, d):
    return E.instance_iou(_inst(spark, d)).select("plant_id", *[F.col(c).cast("int").alias(c) for c in ("class", "pred", "gt")], *_r("iou"))


@_query(f"""WITH {INST}, best AS (SELECT g.plant_id, g.class, g.inst, g.size, coalesce(max(iou), 0) AS best FROM gt g LEFT JOIN iou i ON i.plant_id = g.plant_id AND i.class = g.class AND i.gt = g.inst GROUP BY ALL)
SELECT plant_id, class::INT AS class, round(avg(best), 6) AS mucov, round(sum(best * size) / sum(size), 6) AS mwcov FROM best GROUP BY plant_id, class""")
def mucov_mwcov(spark, d):
    return E.coverage(_inst(spark, d)).select("plant_id", F.col("class").cast("int").alias("class"), *_r("mucov", "mwcov"))


@_query(f"""WITH {INST}, tp AS (SELECT plant_id, class, count(*) AS tp FROM iou WHERE iou >= 0.5 GROUP BY ALL), np AS (SELECT plant_id, class, count(*) AS n FROM pred GROUP BY ALL), ng AS (SELECT plant_id, class, count(*) AS n FROM gt GROUP BY ALL)
SELECT c.plant_id, c.class::INT AS class, round(CASE WHEN np.n > 0 THEN coalesce(tp, 0) / np.n ELSE 0 END, 6) AS precision, round(CASE WHEN ng.n > 0 THEN coalesce(tp, 0) / ng.n ELSE 0 END, 6) AS recall
FROM (SELECT DISTINCT plant_id, class FROM inst, (VALUES (0), (1)) t(class)) c LEFT JOIN tp USING (plant_id, class) LEFT JOIN np USING (plant_id, class) LEFT JOIN ng USING (plant_id, class)""")
def instance_greedy_pr(spark, d):
    return E.instance_pr(_inst(spark, d)).select("plant_id", F.col("class").cast("int").alias("class"), *_r("precision", "recall"))


@_query(f"WITH {SAMPLES} SELECT src, dst, s::INT AS s, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM samples")
def edge_samples(spark, d):
    return E.edge_samples(*_skeleton(spark, d)).select("src", "dst", "s", "point_id", *_r("x", "y", "z"))


@_query(f"WITH {FORWARD} SELECT point_id, round(d, 6) AS d FROM forward")
def skeleton_forward(spark, d):
    v, e = _skeleton(spark, d)
    return E.forward_distances(_one(spark, d), v, e, materialize(E.edge_samples(v, e), "samples")).select("point_id", *_r("d"))


@_query(f"""WITH {FORWARD}, back AS (SELECT p.point_id, min(sqrt{D2}) AS d FROM samples p, one q GROUP BY p.point_id), f AS (SELECT avg(d) AS m, list_sort(list(d))[floor(0.9 * count(*))::BIGINT + 1] AS p90 FROM forward), b AS (SELECT avg(d) AS m FROM back)
SELECT round(f.m, 6) AS forward_mean, round(p90, 6) AS forward_90th, round(b.m, 6) AS reverse_mean, round((f.m + b.m) / 2, 6) AS chamfer FROM f, b""")
def skeleton_chamfer(spark, d):
    v, e = _skeleton(spark, d)
    return E.skeleton_metrics(_one(spark, d), v, e).select(*_r("forward_mean", "forward_90th", "reverse_mean", "chamfer"))


@_query(f"WITH {PLANTS} SELECT plant_id, row_number() OVER (PARTITION BY plant_id ORDER BY z, point_id) - 1 AS pos, point_id, round(x, 6) + 0.0 AS x FROM plants")
def select_by_ids(spark, d):
    """All points in the order of their heights."""
    from pyspark.sql import Window

    p = _plants(spark, d)
    order = F.row_number().over(Window.partitionBy("plant_id").orderBy("z", "point_id")).cast("long") - 1
    return C.select_by_ids(p, p.select("plant_id", "point_id", order.alias("pos"))).select("plant_id", "pos", "point_id", *_r("x"))


@_query(f"WITH {PLANTS} SELECT plant_id, point_id FROM plants WHERE point_id % 3 <> 0")
def finite_points(spark, d):
    """Every third point's x is made infinite, null or no number, and goes."""
    bad = F.when(F.col("point_id") % 9 == 0, F.lit(float("nan"))).when(F.col("point_id") % 9 == 3, F.lit(float("-inf")))
    return C.finite(_plants(spark, d).withColumn("x", F.when(F.col("point_id") % 3 == 0, bad).otherwise(F.col("x")))).select("plant_id", "point_id")


@_query(f"""WITH {PLANTS}, low AS (SELECT plant_id, arg_min(point_id, (z, point_id)) AS point_id FROM plants GROUP BY plant_id) SELECT plant_id, point_id, round(z, 6) + 0.0 AS z FROM low JOIN plants USING (plant_id, point_id)""")
def lowest_point(spark, d):
    return C.lowest_point(_plants(spark, d)).select("plant_id", "point_id", *_r("z"))


@_query("SELECT plant_id, p FROM (SELECT l_returnflag AS plant_id, l_extendedprice AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE i = floor(n * 0.9::DOUBLE) + 1")
def p90_index(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("plant_id"), "l_extendedprice")
    return E.index_percentile(li, "l_extendedprice")


@_query(f"WITH {ONE} SELECT point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM one")
def parse_xyz_lines(spark, d):
    line = F.concat(F.lit(" "), F.col("x").cast("string"), F.lit("  "), F.col("y").cast("string"), F.lit(" "), F.col("z").cast("string"), F.lit(" more"))
    v = _one(spark, d).select("point_id", text.parse_line(line, 3).alias("v"))
    return v.select("point_id", *[F.col("v")[i].alias(a) for i, a in enumerate("xyz")]).select("point_id", *_r("x", "y", "z"))


@_query("SELECT o_orderstatus AS plant_id, max(o_orderkey) AS iter, 'out/' || o_orderstatus || '/.iterations/cpts_' || max(o_orderkey) || '.ply' AS path FROM orders GROUP BY o_orderstatus")
def latest_iteration(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    path = F.concat(F.lit("out/"), F.col("o_orderstatus"), F.lit("/.iterations/cpts_"), F.col("o_orderkey").cast("string"), F.lit(".ply"))
    return folders.latest_iteration(o.select(F.col("o_orderstatus").alias("plant_id"), path.alias("path")))


@_query("SELECT c_custkey::VARCHAR AS plant_id, 'eval/' || c_custkey || '/a_Result.ply' AS path FROM customer")
def collect_evaluation(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    names = F.explode(F.array(*[F.concat(F.lit("eval/"), F.col("c_custkey").cast("string"), F.lit(n)) for n in ("/a_Result.ply", "/a_Raw.ply", "/notes.txt")])).alias("path")
    return folders.collect_evaluation(c.select(names)).where("role = 'Result'").select("plant_id", "path")


@_query("SELECT plant_id, iter, coalesce(before - ratio <= 0.0001::DOUBLE, false) AS stop FROM (SELECT user_id AS plant_id, event_id AS iter, value AS ratio, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)")
def contraction_stop(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("plant_id"), F.col("event_id").alias("iter"), F.col("value").alias("ratio"))
    return K.stops(e).select("plant_id", "iter", "stop")


@_query(f"""WITH {TRI}, s AS (SELECT vec_id, {SIDE(A3, B3)} AS ab, {SIDE(B3, C3)} AS bc, {SIDE(C3, A3)} AS ca FROM tri), h AS (SELECT *, sqrt(greatest(0.0, (ab + bc + ca) / 2 * ((ab + bc + ca) / 2 - ab) * ((ab + bc + ca) / 2 - bc) * ((ab + bc + ca) / 2 - ca))) AS area FROM s)
SELECT vec_id, round(area, 6) AS area, round(area, 6) AS cross_area, round(CASE WHEN area > 0 THEN ab * bc * ca / (4 * area) END, 6) AS radius, round(acos(greatest(-1.0, least(1.0, (ab * ab + ca * ca - bc * bc) / (2 * ab * ca)))), 6) AS angle, round((bc * bc + ca * ca - ab * ab) / (8 * area), 6) + 0.0 AS cotan FROM h""")
def triangle_geometry(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"{'abc'[i // 3]}{'xyz'[i % 3]}") for i in range(9)])
    a, b, c = G.xyz("a"), G.xyz("b"), G.xyz("c")
    s = e.select("vec_id", G.distance(a, b).alias("ab"), G.distance(b, c).alias("bc"), G.distance(c, a).alias("ca"), G.triangle_area(a, b, c).alias("cross_area"))
    s = s.withColumn("area", G.heron_area(F.col("ab"), F.col("bc"), F.col("ca")))
    s = s.withColumns({"radius": G.circumradius(F.col("ab"), F.col("bc"), F.col("ca")), "angle": G.corner_angle(F.col("bc"), F.col("ab"), F.col("ca")), "cotan": G.half_cotan(F.col("ab") * F.col("ab"), F.col("bc") * F.col("bc"), F.col("ca") * F.col("ca"), F.col("area"))})
    return s.select("vec_id", *_r("area", "cross_area", "radius", "angle", "cotan"))


from arborel.plans import surfaces, trees  # noqa: E402, F401  (they register their queries)


def queries() -> dict:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
