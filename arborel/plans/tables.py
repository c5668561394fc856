"""What the registered queries share: clouds and segmentations from the driver's tables, SQL fragments and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborel.operators import graph as R
from arborel.operators import mesh as M
from arborel.operators import spatial as S
from arborel.scratch import materialize

RADIUS, SIGMA_RADIUS, LOP_H, STEP = 0.05, 0.08, 0.3, 0.001


def _r(*names: str) -> list:
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def _plants(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("label").cast("string").alias("plant_id"), F.col("vec_id").alias("point_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


def _one(spark: SparkSession, d: str) -> DataFrame:
    return _plants(spark, d).withColumn("plant_id", F.lit("all"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return _plants(spark, d).groupBy("plant_id").agg(*[F.round(F.avg(a), 6).alias(a) for a in "xyz"]).select(F.lit("all").alias("plant_id"), F.col("plant_id").cast("long").alias("point_id"), "x", "y", "z")


def _skeleton(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Centroids joined in the order of their ids."""
    v = materialize(_centroids(spark, d).withColumnRenamed("point_id", "vertex_id"), "skeleton")
    w = Window.partitionBy("plant_id").orderBy("vertex_id")
    return v, v.select("plant_id", F.col("vertex_id").alias("src"), F.lead("vertex_id").over(w).alias("dst")).where("dst is not null")


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _plants(spark, d)
    return p.withColumnRenamed("point_id", "vertex_id"), materialize(R.euclidean_tree(p), "tree", merged=True)


def _seg(spark: SparkSession, d: str) -> DataFrame:
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    joined = labels.join(docs, "doc_id")
    return joined.select(F.col("source").alias("plant_id"), F.col("doc_id").alias("point_id"), F.col("quality").alias("pred_sem"), F.col("toxic").alias("gt_sem"))


def _inst(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    pred = F.col("l_linenumber") - 2
    gt = F.when(F.col("l_quantity") <= 40, pred).otherwise(F.col("l_linenumber") % 7 - 1)
    return li.select(F.col("l_returnflag").alias("plant_id"), pred.alias("pred_inst"), gt.alias("gt_inst"), F.when(pred == -1, 0).otherwise(1).alias("pred_sem"), F.when(gt == -1, 0).otherwise(1).alias("gt_sem"))


PLANTS = "plants AS (SELECT label::VARCHAR AS plant_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
ONE = "one AS (SELECT 'all' AS plant_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
CENTROIDS = f"{PLANTS}, centroids AS (SELECT 'all' AS plant_id, plant_id::BIGINT AS point_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM plants GROUP BY plant_id)"
D2 = "((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"
L1 = "(abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z))"


def _knn_sql(k: int, table: str = "plants", name: str = "knn") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT p.plant_id, p.point_id, q.point_id AS nbr_id, {D2} AS d2,
  row_number() OVER (PARTITION BY p.plant_id, p.point_id ORDER BY {D2}, q.point_id) AS rank
  FROM {table} p JOIN {table} q ON p.plant_id = q.plant_id AND p.point_id <> q.point_id) WHERE rank <= {k})"""


EIGEN = """CASE WHEN p > 0 THEN q + 2 * p * cos(acos(greatest(-1.0, least(1.0, det / 2))) / 3) ELSE q END"""


def _eigen_sql(source: str, extra: str) -> str:
    """The largest eigenvalue `high` (and low) of xx, yy, zz, xy, xz, yz of source."""
    return f"""SELECT *, {EIGEN} AS high, CASE WHEN p > 0 THEN q + 2 * p * cos(acos(greatest(-1.0, least(1.0, det / 2))) / 3 + 2 * pi() / 3) ELSE q END AS low FROM (
  SELECT *, CASE WHEN p > 0 THEN (((xx - q) / p) * (((yy - q) / p) * ((zz - q) / p) - (yz / p) * (yz / p)) - (xy / p) * ((xy / p) * ((zz - q) / p) - (yz / p) * (xz / p))
    + (xz / p) * ((xy / p) * (yz / p) - ((yy - q) / p) * (xz / p))) END AS det FROM (
  SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM (
  SELECT *, (xx + yy + zz) / 3 AS q {extra} FROM {source})))"""


def _sigma_sql(threshold: float = 0.9) -> str:
    w = f"exp(-({L1} * {L1}) / {(SIGMA_RADIUS / 4) ** 2!r})"
    cells = ", ".join(f"sum({w} * (p.{a} - q.{a}) * (p.{b} - q.{b})) AS {a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))
    return f"""{ONE}, near AS (SELECT p.plant_id, p.point_id, q.point_id AS nbr_id FROM one p JOIN one q ON {D2} <= {SIGMA_RADIUS**2!r}),
 scatter AS (SELECT p.plant_id, p.point_id, count(*) AS n, {cells} FROM one p JOIN one q ON {D2} <= {SIGMA_RADIUS**2!r} GROUP BY ALL),
 sig AS (SELECT plant_id, point_id, n, CASE WHEN n < 3 THEN {threshold} WHEN xx + yy + zz > 0 THEN high / (xx + yy + zz) END AS sigma FROM ({_eigen_sql("scatter", "")})),
 smooth AS (SELECT s.plant_id, s.point_id, s.n, s.sigma, (s.sigma + coalesce(sum(t.sigma), 0)) / (count(t.point_id) + 1) AS smooth_sigma
  FROM sig s JOIN near ON near.point_id = s.point_id LEFT JOIN sig t ON t.point_id = near.nbr_id AND (s.n < 3 OR t.point_id <> s.point_id) GROUP BY s.plant_id, s.point_id, s.n, s.sigma)"""


#: Prim's algorithm per plant on lists, as the tree's oracle.
PRIM = f"""{PLANTS}, lists AS (SELECT plant_id, list(point_id ORDER BY point_id) AS ids, list(x ORDER BY point_id) AS xs, list(y ORDER BY point_id) AS ys, list(z ORDER BY point_id) AS zs, count(*) AS n FROM plants GROUP BY plant_id),
 prim(plant_id, step, cur, best, link, src, dst, weight) AS (
  SELECT plant_id, 0, 1, list_transform(range(n), lambda i: 1e300), list_transform(range(n), lambda i: 0), NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM lists
  UNION ALL
  SELECT plant_id, step + 1, next, best, link, least(ids[next], ids[link[next]]), greatest(ids[next], ids[link[next]]), sqrt(best[next]) FROM (
   SELECT *, list_position(best, list_min(list_filter(best, lambda b: b >= 0))) AS next FROM (
    SELECT prim.plant_id, step, ids,
     list_transform(range(1, n + 1), lambda i: CASE WHEN i = cur OR best[i] < 0 THEN -1.0 ELSE least(best[i], (xs[i] - xs[cur]) * (xs[i] - xs[cur]) + (ys[i] - ys[cur]) * (ys[i] - ys[cur]) + (zs[i] - zs[cur]) * (zs[i] - zs[cur])) END) AS best,
     list_transform(range(1, n + 1), lambda i: CASE WHEN (xs[i] - xs[cur]) * (xs[i] - xs[cur]) + (ys[i] - ys[cur]) * (ys[i] - ys[cur]) + (zs[i] - zs[cur]) * (zs[i] - zs[cur]) < best[i] THEN cur ELSE link[i] END) AS link
    FROM prim JOIN lists ON prim.plant_id = lists.plant_id WHERE step < n - 1))),
 tree AS (SELECT plant_id, src, dst, weight FROM prim WHERE step > 0)"""

SEG = "seg AS (SELECT d.source AS plant_id, l.doc_id AS point_id, l.quality AS pred_sem, l.toxic AS gt_sem FROM labels l JOIN documents d USING (doc_id))"
SEG_M = f"""{SEG}, c AS (SELECT plant_id, class, count(*) AS n, count(*) FILTER (pred_sem = class AND gt_sem = class) AS tp, count(*) FILTER (pred_sem = class AND gt_sem <> class) AS fp, count(*) FILTER (pred_sem <> class AND gt_sem = class) AS fn
 FROM seg, (VALUES (0), (1)) t(class) GROUP BY plant_id, class),
 m AS (SELECT plant_id, class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou FROM c)"""
INST = """inst AS (SELECT plant_id, pred_inst, gt_inst, CASE WHEN pred_inst = -1 THEN 0 ELSE 1 END AS pred_sem, CASE WHEN gt_inst = -1 THEN 0 ELSE 1 END AS gt_sem FROM (
  SELECT l_returnflag AS plant_id, l_linenumber - 2 AS pred_inst, CASE WHEN l_quantity <= 40 THEN l_linenumber - 2 ELSE l_linenumber % 7 - 1 END AS gt_inst FROM lineitem)),
 pred AS (SELECT plant_id, inst, arg_max(sem, n * 10 - sem) AS class, sum(n)::BIGINT AS size FROM (SELECT plant_id, pred_inst AS inst, pred_sem AS sem, count(*) AS n FROM inst WHERE pred_inst <> -1 GROUP BY ALL) GROUP BY plant_id, inst),
 gt AS (SELECT plant_id, inst, arg_max(sem, n * 10 - sem) AS class, sum(n)::BIGINT AS size FROM (SELECT plant_id, gt_inst AS inst, gt_sem AS sem, count(*) AS n FROM inst GROUP BY ALL) GROUP BY plant_id, inst),
 iou AS (SELECT i.plant_id, p.class, i.pred_inst AS pred, i.gt_inst AS gt, i.n / (p.size + g.size - i.n) AS iou FROM (SELECT plant_id, pred_inst, gt_inst, count(*) AS n FROM inst GROUP BY ALL) i
  JOIN pred p ON p.plant_id = i.plant_id AND p.inst = i.pred_inst JOIN gt g ON g.plant_id = i.plant_id AND g.inst = i.gt_inst AND g.class = p.class)"""
SAMPLES = f"""{CENTROIDS}, edges AS (SELECT * FROM (SELECT point_id AS src, lead(point_id) OVER (ORDER BY point_id) AS dst FROM centroids) WHERE dst IS NOT NULL),
 lines AS (SELECT src, dst, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS length
  FROM edges JOIN centroids a ON a.point_id = src JOIN centroids b ON b.point_id = dst),
 counted AS (SELECT *, greatest(2, ceil(length / (SELECT avg(length) / 6 FROM lines)) + 1)::BIGINT AS n FROM lines),
 samples AS (SELECT 'all' AS plant_id, row_number() OVER (ORDER BY src, dst, s) - 1 AS point_id, src, dst, s, ax + s / (n - 1) * (bx - ax) AS x, ay + s / (n - 1) * (by_ - ay) AS y, az + s / (n - 1) * (bz - az) AS z
  FROM counted, LATERAL (SELECT unnest(range(n)) AS s))"""
FORWARD = f"""{SAMPLES}, {ONE}, near AS (SELECT * FROM (SELECT p.point_id, q.src, q.dst, row_number() OVER (PARTITION BY p.point_id ORDER BY {D2}, q.point_id) AS rank FROM one p, samples q) WHERE rank <= 5),
 cand AS (SELECT DISTINCT near.point_id, one.x, one.y, one.z, lines.* FROM near JOIN lines ON lines.src = near.src AND lines.dst = near.dst JOIN one ON one.point_id = near.point_id),
 along AS (SELECT *, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay) + (z - az) * (bz - az)) / (length * length))) AS t FROM cand),
 forward AS (SELECT point_id, min(sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay)) + (z - az - t * (bz - az)) * (z - az - t * (bz - az)))) AS d FROM along GROUP BY point_id)"""

TRI = "tri AS (SELECT vec_id, " + ", ".join(f"embedding[{i}]::DOUBLE AS {c}" for i, c in enumerate(("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz"), 1)) + " FROM embeddings)"
SIDE = lambda p, q: f"sqrt(({p[0]} - {q[0]}) * ({p[0]} - {q[0]}) + ({p[1]} - {q[1]}) * ({p[1]} - {q[1]}) + ({p[2]} - {q[2]}) * ({p[2]} - {q[2]}))"
A3, B3, C3 = ("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")

_FOUND: dict[str, tuple] = {}


def _query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


KNN_EDGES = f"{PLANTS}, {_knn_sql(4)}, pairs AS (SELECT DISTINCT plant_id, least(point_id, nbr_id) AS src, greatest(point_id, nbr_id) AS dst FROM knn), edges AS (SELECT e.plant_id, src, dst, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, sqrt{D2} AS length FROM pairs e JOIN plants p ON p.point_id = src JOIN plants q ON q.point_id = dst)"


def _knn_edges(spark, d, k=4):
    p = _plants(spark, d)
    near = S.knn_join(p, p, k, exclude_self=True)
    pairs = near.select("plant_id", F.least("point_id", "nbr_id").alias("src"), F.greatest("point_id", "nbr_id").alias("dst")).distinct()
    return M.edge_lengths(pairs, p)
