"""Quality of skeletons and of segmentations.

Segmentations are (plant_id, point_id, pred_sem, pred_inst, gt_sem, gt_inst); metrics come as
tidy rows. Everything but the greedy matching is counts and sums, so points are aggregated
once and the rest runs on classes or instances.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborel.functions.geometry import distance, segment_distance, xyz
from arborel.operators.numbering import numbered
from arborel.operators.spatial import knn_join, nearest_join
from arborel.scratch import materialize


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(0.0)


def semantic_counts(seg: DataFrame) -> DataFrame:
    """(plant_id, class, tp, fp, fn, n) for the classes 0 and 1."""
    one = seg.groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if((F.col("pred_sem") == c) & (F.col("gt_sem") == c)).alias(f"tp{c}") for c in (0, 1)],
        *[F.count_if((F.col("pred_sem") == c) & (F.col("gt_sem") != c)).alias(f"fp{c}") for c in (0, 1)],
        *[F.count_if((F.col("pred_sem") != c) & (F.col("gt_sem") == c)).alias(f"fn{c}") for c in (0, 1)],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(f"{m}{c}").alias(m) for m in ("tp", "fp", "fn")]) for c in (0, 1)])).alias("r")
    return one.select("plant_id", "n", rows).select("plant_id", "r.class", "r.tp", "r.fp", "r.fn", "n")


def semantic_metrics(seg: DataFrame) -> DataFrame:
    """(plant_id, class, precision, recall, f1, iou) per class; zero denominators give 0."""
    c = semantic_counts(seg)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("plant_id", "class", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("iou"))


def semantic_overall(seg: DataFrame) -> DataFrame:
    """(metric, mean, std): class means of each plant, then their mean and sample deviation over plants (0 for one plant)."""
    plants = semantic_metrics(seg).groupBy("plant_id").agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1", "iou")])
    accuracy = seg.groupBy("plant_id").agg(F.avg(F.coalesce(F.col("pred_sem") == F.col("gt_sem"), F.lit(False)).cast("double")).alias("accuracy"))
    return macro(plants.join(accuracy, "plant_id"), ["precision", "recall", "f1", "iou", "accuracy"])


def macro(plants: DataFrame, metrics: list[str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")
    tidy = plants.select(rows).select("r.metric", "r.value")
    return tidy.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def instance_class(seg: DataFrame, side: str) -> DataFrame:
    """(plant_id, inst, class, size): the majority class of each instance, the smaller on ties; classes besides 0 and 1 go.

    The predicted instance -1 (the stem) is left out, the true one is not.
    """
    rows = seg.select("plant_id", F.col(f"{side}_inst").alias("inst"), F.col(f"{side}_sem").alias("sem")).where("inst is not null")
    if side == "pred":
        rows = rows.where("inst <> -1")
    counts = rows.groupBy("plant_id", "inst", "sem").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("plant_id", "inst").agg(F.max(F.struct("n", (-F.col("sem")).alias("neg"))).alias("b"), F.sum("n").alias("size"))
    return best.select("plant_id", "inst", (-F.col("b.neg")).alias("class"), "size").where("class in (0, 1)")


def instance_iou(seg: DataFrame) -> DataFrame:
    """(plant_id, class, pred, gt, iou) of predicted and true instances of one class that share points."""
    pred, gt = instance_class(seg, "pred"), instance_class(seg, "gt")
    both = seg.groupBy("plant_id", F.col("pred_inst").alias("pred"), F.col("gt_inst").alias("gt")).agg(F.count(F.lit(1)).alias("both"))
    joined = both.join(pred.select("plant_id", F.col("inst").alias("pred"), "class", F.col("size").alias("np")), ["plant_id", "pred"])
    joined = joined.join(gt.select("plant_id", F.col("inst").alias("gt"), "class", F.col("size").alias("ng")), ["plant_id", "gt", "class"])
    return joined.select("plant_id", "class", "pred", "gt", (F.col("both") / (F.col("np") + F.col("ng") - F.col("both"))).alias("iou"))


def coverage(seg: DataFrame) -> DataFrame:
    """(plant_id, class, mucov, mwcov): mean and size-weighted mean of each true instance's best IoU; classes without any are left out."""
    best = instance_iou(seg).groupBy("plant_id", "class", "gt").agg(F.max("iou").alias("best"))
    gt = instance_class(seg, "gt").withColumnRenamed("inst", "gt").join(best, ["plant_id", "class", "gt"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return gt.groupBy("plant_id", "class").agg(F.avg("best").alias("mucov"), (F.sum(F.col("best") * F.col("size")) / F.sum("size")).alias("mwcov"))


def greedy_matches(ious: DataFrame, least: float = 0.5) -> DataFrame:
    """(plant_id, class, pred, gt): predictions in ascending id take their best free true instance, the first on ties, at IoU `least` or more.

    A group is one plant's class: its pairs of instances, not its points.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for pred, rows in pdf.sort_values(["pred", "gt"]).groupby("pred", sort=True):
            free = rows[~rows["gt"].isin(taken)]
            if len(free) and free["iou"].max() >= least:
                gt = free["gt"].iloc[int(free["iou"].to_numpy().argmax())]
                taken.add(gt)
                out.append((pdf.plant_id.iloc[0], pdf["class"].iloc[0], pred, gt))
        return pd.DataFrame(out, columns=["plant_id", "class", "pred", "gt"])

    kinds = dict(ious.dtypes)
    return ious.groupBy("plant_id", "class").applyInPandas(match, ", ".join(f"{c} {kinds[c]}" for c in ("plant_id", "class", "pred", "gt")))


def instance_pr(seg: DataFrame, leaf_only: bool = False) -> DataFrame:
    """(plant_id, class, precision, recall) of greedy matches; plants without true instances count with 0."""
    tp = greedy_matches(instance_iou(seg)).groupBy("plant_id", "class").agg(F.count(F.lit(1)).alias("tp"))
    n = lambda side: instance_class(seg, side).groupBy("plant_id", "class").agg(F.count(F.lit(1)).alias(f"n_{side}"))
    cells = seg.select("plant_id").distinct().select("plant_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    for part in (tp, n("pred"), n("gt")):
        cells = cells.join(part, ["plant_id", "class"], "left")
    cells = cells.fillna(0)
    out = cells.select("plant_id", "class", ratio(F.col("tp"), F.col("n_pred")).alias("precision"), ratio(F.col("tp"), F.col("n_gt")).alias("recall"))
    return out.where("class = 1") if leaf_only else out


def with_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    for end, name in (("src", "a_"), ("dst", "b_")):
        edges = edges.join(vertices.select("plant_id", F.col("vertex_id").alias(end), *[F.col(a).cast("double").alias(f"{name}{a}") for a in "xyz"]), ["plant_id", end])
    return edges


def edge_samples(vertices: DataFrame, edges: DataFrame, interval: float | None = None) -> DataFrame:
    """(plant_id, point_id, src, dst, s, x, y, z): points along edges, both ends included, `interval` apart at most.

    By default the interval is a sixth of the plant's mean edge length.
    """
    lines = with_ends(edges.select("plant_id", "src", "dst"), vertices).withColumn("length", distance(xyz("a_"), xyz("b_")))
    if interval is None:
        lines = lines.join(lines.groupBy("plant_id").agg((F.avg("length") / 6).alias("gap")), "plant_id")
    else:
        lines = lines.withColumn("gap", F.lit(float(interval)))
    n = F.greatest(F.lit(2), F.when(F.col("gap") > 0, F.ceil(F.col("length") / F.when(F.col("gap") > 0, F.col("gap"))) + 1).otherwise(2)).cast("int")
    points = lines.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("s") / (F.col("n") - 1)
    placed = points.select("plant_id", "src", "dst", "s", *[(F.col(f"a_{a}") + t * (F.col(f"b_{a}") - F.col(f"a_{a}"))).alias(a) for a in "xyz"])
    return numbered(placed, [F.col(c) for c in ("src", "dst", "s")], "point_id")


def forward_distances(cloud: DataFrame, vertices: DataFrame, edges: DataFrame, samples: DataFrame, candidates: int = 5) -> DataFrame:
    """(plant_id, point_id, d): each cloud point's distance to the edges of its nearest samples."""
    near = knn_join(cloud, samples, candidates).select("plant_id", "point_id", F.col("nbr_id").alias("sample"))
    owner = samples.select("plant_id", F.col("point_id").alias("sample"), "src", "dst")
    pairs = near.join(owner, ["plant_id", "sample"]).select("plant_id", "point_id", "src", "dst").distinct()
    pairs = with_ends(pairs, vertices).join(cloud.select("plant_id", "point_id", "x", "y", "z"), ["plant_id", "point_id"])
    return pairs.groupBy("plant_id", "point_id").agg(F.min(segment_distance(xyz(), xyz("a_"), xyz("b_"))).alias("d"))


def index_percentile(values: DataFrame, value: str, share: float = 0.9) -> DataFrame:
    """(plant_id, p): the element at index floor(share * n) of the sorted values; no interpolation. Nulls are left out.

    Values are counted and their counts dealt out by range; sums say which range of a plant
    holds the index, and only that one is sorted. No task takes a whole plant.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy("plant_id", F.col(value).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(counts.repartitionByRange(parts, "plant_id", "p").withColumn("_part", F.spark_partition_id()), "percentile")
    plant = Window.partitionBy("plant_id")
    before = plant.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("plant_id", "_part").agg(F.sum("c").alias("n"))
    placed = sums.select("plant_id", "_part", "n", F.floor(F.sum("n").over(plant) * F.lit(share)).alias("index"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    chosen = placed.where("ahead <= index and index < ahead + n").select("plant_id", "_part", (F.col("index") - F.col("ahead")).alias("index"))
    upto = F.sum("c").over(Window.partitionBy("plant_id", "_part").orderBy("p"))
    return spread.join(chosen, ["plant_id", "_part"]).withColumn("upto", upto).where("upto > index").groupBy("plant_id").agg(F.min("p").alias("p"))


def skeleton_metrics(cloud: DataFrame, vertices: DataFrame, edges: DataFrame, interval: float | None = None) -> DataFrame:
    """(plant_id, forward_mean, forward_90th, reverse_mean, chamfer)."""
    samples = materialize(edge_samples(vertices, edges, interval), "edge-samples")
    forward = materialize(forward_distances(cloud, vertices, edges, samples), "forward")
    back = nearest_join(samples, cloud).groupBy("plant_id").agg(F.avg(F.sqrt("d2")).alias("reverse_mean"))
    out = forward.groupBy("plant_id").agg(F.avg("d").alias("forward_mean")).join(index_percentile(forward, "d").withColumnRenamed("p", "forward_90th"), "plant_id").join(back, "plant_id")
    return out.withColumn("chamfer", (F.col("forward_mean") + F.col("reverse_mean")) / 2)
