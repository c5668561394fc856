"""The evaluators on files: segmentations as pairs of results and inputs, skeletons against clouds, metrics as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.operators import evaluate as E
from arborel.scratch import materialize
from arborel.sources import ply
from arborel.sources.inputs import prepare_folder, write_text

#: Names of the predicted and the true labels in the files.
PREDICTED, TRUE = ("pred-semantic", "pred-instance"), ("semantic", "instance")


def read_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    """(plant_id, point_id, pred_sem, pred_inst, gt_sem, gt_inst) of every <plant>_Result.ply with its <plant>_Input.ply in a folder.

    A result without its input, and a pair of unequal numbers of points, are errors; inputs
    without a result are left out.
    """

    def side(role: str, names: tuple[str, str], to: str) -> DataFrame:
        rows = ply.read_vertices(spark, f"{folder.rstrip('/')}/*_{role}.ply").where(F.col("plant_id").endswith(f"_{role}"))
        plant = F.expr(f"substring(plant_id, 1, length(plant_id) - {len(role) + 1})")
        return rows.select(plant.alias("plant_id"), "point_id", *[F.col(f"`{n}`").cast("int").alias(f"{to}_{c}") for n, c in zip(names, ("sem", "inst"), strict=True)])

    pred, gt = side("Result", PREDICTED, "pred"), side("Input", TRUE, "gt")
    sizes = [df.groupBy("plant_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((pred, "n_pred"), (gt, "n_gt"))]
    both = sizes[0].join(sizes[1], "plant_id", "left")
    wrong = F.when(F.col("n_gt").isNull(), F.concat(F.lit("no input file for "), F.col("plant_id"))).otherwise(F.concat(F.lit("unequal numbers of points in "), F.col("plant_id")))
    checked = both.select("plant_id", F.when(F.col("n_pred") == F.col("n_gt"), 0).otherwise(F.raise_error(wrong).cast("int")).alias("ok"))
    return pred.join(checked, "plant_id").where("ok = 0").drop("ok").join(gt, ["plant_id", "point_id"])


def segmentation_metrics(seg: DataFrame) -> DataFrame:
    """(kind, plant_id, class, metric, value): all metrics of each plant and class, and of plant 'Overall' means and sample deviations over plants.

    Overall means are means over plants of class means; a class that a plant has no true
    instance of has no coverage there and stays out of its means.
    """
    seg = materialize(seg, "segmentation")
    semantic = E.semantic_metrics(seg)
    counts = E.semantic_counts(seg)
    instance = E.instance_pr(seg).join(E.coverage(seg), ["plant_id", "class"], "left")

    def tidy(df: DataFrame, kind: str, names: list[str]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")
        return df.select(F.lit(kind).alias("kind"), "plant_id", F.col("class").cast("string").alias("class"), rows).select("kind", "plant_id", "class", "r.metric", "r.value").where("value is not null")

    by_class = tidy(semantic, "semantic", ["precision", "recall", "f1", "iou"]).unionByName(tidy(counts, "semantic", ["tp", "fp", "fn"])).unionByName(tidy(instance, "instance", ["precision", "recall", "mucov", "mwcov"]))
    overall = E.semantic_overall(seg).select(F.lit("semantic").alias("kind"), "metric", "mean", "std")
    # instances are summed up for each class over plants, semantics over the plants' class means
    per_class = by_class.where("kind = 'instance'").groupBy("kind", "class", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    summary = overall.withColumn("class", F.lit("mean")).unionByName(per_class)
    both = F.explode(F.array(F.struct(F.col("metric").alias("metric"), F.col("mean").alias("value")), F.struct(F.concat("metric", F.lit("_std")).alias("metric"), F.col("std").alias("value")))).alias("r")
    return by_class.unionByName(summary.select("kind", F.lit("Overall").alias("plant_id"), "class", both).select("kind", "plant_id", "class", "r.metric", "r.value"))


def evaluate_segmentation(spark: SparkSession, folder: str, output: str | None = None) -> DataFrame:
    """segmentation_metrics of a folder's pairs; with output, semantic.json and instance.json are written there: plant, class, metric."""
    metrics = materialize(segmentation_metrics(read_segmentation(spark, folder)), "metrics")
    if output:
        prepare_folder(spark, output, "overwrite")
        for kind in ("semantic", "instance"):
            tree: dict = {}
            for r in metrics.where(F.col("kind") == kind).orderBy("plant_id", "class", "metric").toLocalIterator():
                tree.setdefault(r.plant_id, {}).setdefault(r["class"], {})[r.metric] = r.value
            write_text(spark, f"{output.rstrip('/')}/{kind}.json", json.dumps(tree, indent=4))
    return metrics


def evaluate_skeleton(spark: SparkSession, cloud: str, graph: str, interval: float | None = None) -> DataFrame:
    """(plant_id, points, vertices, edges, forward_mean, forward_90th, reverse_mean, chamfer) of clouds and skeletons with the same file stems.

    Points and vertices that are not finite are left out, and edges to them.
    """
    points = materialize(ply.read_cloud(spark, cloud, single=False, finite_only=True), "eval-cloud")
    vertices, edges = (materialize(df, "eval-graph") for df in ply.read_graph(spark, graph))
    out = E.skeleton_metrics(points, vertices.select("plant_id", "vertex_id", "x", "y", "z"), edges.select("plant_id", "src", "dst"), interval)
    for df, name in ((edges, "edges"), (vertices, "vertices"), (points, "points")):
        out = df.groupBy("plant_id").agg(F.count(F.lit(1)).alias(name)).join(out, "plant_id")
    return out


def report(metrics: DataFrame) -> str:
    """evaluate_skeleton's rows as text, a plant at a time, without gathering more than its lines."""
    lines = []
    for r in metrics.orderBy("plant_id").toLocalIterator():
        lines.append(f"{r.plant_id}: {r.points} points, {r.vertices} vertices, {r.edges} edges")
        lines += [f"  {name:<22}{r[c]:.6f}" for name, c in (("forward mean", "forward_mean"), ("forward 90th", "forward_90th"), ("reverse mean", "reverse_mean"), ("Chamfer", "chamfer"))]
    return "\n".join(lines)
