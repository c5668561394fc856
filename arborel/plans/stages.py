"""The staged run from clouds to labelled clouds; every stage is a table that can be looked at.

With a store, stages outlive the session: each is written below the fingerprint of its
parameters, its inputs and the stages that it follows from, and marked when it is whole. A new
run takes what is there under the same fingerprint and makes the rest, so it goes on where
a lost one stopped, and a changed parameter makes only what depends on it.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.config import Config
from arborel.operators import cloud, contraction, graph, spacing
from arborel.scratch import materialize
from arborel.sources import inputs, ply

log = logging.getLogger("arborel")

#: Stages in their order.
STAGES = ["input", "contracted", "sampled", "calibrated", "graph", "tree", "pruned", "segmented", "result"]
#: The stages that a stage follows from, and the parameters that it reads itself.
NEEDS = {
    "input": [], "contracted": ["input"], "sampled": ["contracted"], "calibrated": ["sampled", "input"], "graph": ["calibrated"], "tree": ["graph"],
    "pruned": ["calibrated", "tree"], "segmented": ["pruned"], "result": ["segmented", "input"],
}
READS = {
    "input": "with_labels semantic_name instance_name total_columns semantic_column instance_column down_sample normalize_length".split(),
    "contracted": (
        "normalize_length use_knn knn knn_step knn_most use_radius radius radius_step radius_least sigma_threshold sigma_radius max_distance max_iterations epsilon "
        "tip_neighbours geodesic intrinsic area_knn laplacian_scale"
    ).split(),
    "sampled": ["fps_ratio"], "calibrated": ["normalize_length", "lop_ratio"], "graph": ["normalize_length", "graph_step"], "tree": [], "pruned": ["prune_ratio"], "segmented": [], "result": [],
}
#: Part of every fingerprint; to be raised when stages come to other results.
VERSION = 1


class Run:
    """A run over many plants at once. until("tree") computes what is missing up to that stage.

    tables holds each stage's DataFrames; timings is (stage, seconds) of the stages made, not of
    those found in the store. store is a folder that all executors share; source names the
    points' origin and must change when they do.
    """

    def __init__(self, points: DataFrame, config: Config, store: str | None = None, source: str | None = None):
        if store and source is None:
            raise ValueError("a store needs the name of the points' source")
        self.points, self.config = points, config.validate()
        self.store, self.source = store and store.rstrip("/"), source
        self.spark: SparkSession = points.sparkSession
        self.tables: dict[str, DataFrame | tuple] = {}
        self.timings: list[tuple[str, float]] = []

    @classmethod
    def of(cls, spark: SparkSession, config: Config, store: str | None = None) -> Run:
        """A run over the configured input, with its labels; files that changed in name, length or time are another source."""
        return cls(inputs.load(spark, config), config, store, inputs.fingerprint(spark, config) if store else None)

    def fingerprint(self, stage: str) -> str:
        """Of the stage's parameters, the fingerprints of the stages it follows from, and the source of the first."""
        own = [VERSION, stage, {name: getattr(self.config, name) for name in READS[stage]}, [self.fingerprint(up) for up in NEEDS[stage]]]
        return hashlib.sha256(json.dumps(own if NEEDS[stage] else [*own, self.source], sort_keys=True).encode()).hexdigest()

    def _place(self, stage: str) -> str:
        return f"{self.store}/{stage}/{self.fingerprint(stage)[:32]}"

    def _stored(self, stage: str) -> DataFrame | tuple | None:
        """A whole stage from the store, or None; one without its mark was not finished."""
        mark = inputs.read_text(self.spark, f"{self._place(stage)}/stage.json")
        if mark is None:
            return None
        tables = tuple(self.spark.read.parquet(f"{self._place(stage)}/{i}") for i in range(json.loads(mark)["tables"]))
        return tables if json.loads(mark)["several"] else tables[0]

    def _keep(self, stage: str, made: DataFrame | tuple) -> DataFrame | tuple:
        """made, written: in the store with its mark last, or for the session."""
        several = isinstance(made, tuple)
        tables = made if several else (made,)
        if not self.store:
            kept = tuple(materialize(df, f"stage-{stage}") for df in tables)
            return kept if several else kept[0]
        for i, df in enumerate(tables):
            df.write.mode("overwrite").parquet(f"{self._place(stage)}/{i}")
        mark = {"stage": stage, "fingerprint": self.fingerprint(stage), "tables": len(tables), "several": several, "parameters": {name: getattr(self.config, name) for name in READS[stage]}, "source": self.source}
        inputs.write_text(self.spark, f"{self._place(stage)}/stage.json", json.dumps(mark, indent=4))
        return self._stored(stage)

    def until(self, stage: str) -> Run:
        for name in STAGES[: STAGES.index(stage) + 1]:
            if name not in self.tables:
                found = self._stored(name) if self.store else None
                if found is not None:
                    self.tables[name] = found
                    log.info("%s found in the store", name)
                    continue
                began = time.time()
                self.tables[name] = self._keep(name, getattr(self, f"_{name}")())
                self.timings.append((name, time.time() - began))
                log.info("%s took %.3f s", *self.timings[-1])
        return self

    def _input(self):
        kept = spacing.spaced_downsample(cloud.finite(self.points), self.config.down_sample)
        return cloud.normalize(kept, self.config.normalize_length)

    def _contracted(self):
        return contraction.contract(self.tables["input"].select("plant_id", "point_id", "x", "y", "z"), self.config)

    def _sampled(self):
        return cloud.farthest_points(self.tables["contracted"][0], ratio=self.config.fps_ratio)

    def _calibrated(self):
        skeleton = self.tables["sampled"].selectExpr("plant_id", "pos as point_id", "x", "y", "z")
        return contraction.lop_calibrate(skeleton, self.tables["input"], self.config.normalize_length * self.config.lop_ratio)

    def _graph(self):
        at = self.tables["calibrated"]
        tree = graph.euclidean_tree(at)
        return graph.initial_graph(at, materialize(tree, "stage-bottleneck"), self.config.normalize_length * self.config.graph_step)

    def _tree(self):
        return graph.minimum_spanning_tree(self.tables["graph"])

    def _vertices(self):
        return self.tables["calibrated"].selectExpr("plant_id", "point_id as vertex_id", "x", "y", "z")

    def _pruned(self):
        return graph.prune(self._vertices(), self.tables["tree"].select("plant_id", "src", "dst"), self.config.prune_ratio)

    def _segmented(self):
        vertices, edges = self.tables["pruned"]
        labels = materialize(graph.vertex_labels(vertices, edges), "stage-labels")
        return vertices.join(labels, ["plant_id", "vertex_id"]), graph.edge_labels(edges, labels)

    def _result(self):
        vertices, _ = self.tables["segmented"]
        at = self.tables["input"].drop("semantic", "instance")
        found = graph.project_labels(at, vertices.select("plant_id", "vertex_id", "x", "y", "z"), vertices)
        return found.withColumnsRenamed({"semantic": "pred-semantic", "instance": "pred-instance"})

    def stage_metrics(self) -> DataFrame:
        return self.spark.createDataFrame(self.timings, "stage string, seconds double")

    def normalization(self) -> DataFrame:
        """(plant_id, cx, cy, cz, scale): what the input was moved and scaled by."""
        return self.tables["input"].select("plant_id", "cx", "cy", "cz", "scale").distinct()

    def write(self, folder: str | None = None) -> DataFrame:
        """Everything the run made, below folder (the configured output by default); (plant_id, path, n) of the results.

        <plant>_Result.ply has the labelled cloud; 0_Original the cloud as it was read, with its labels; 1_Input to 7_Segmented hold each stage's
        PLY files, one a plant; iterations/<n> the contraction's snapshots as
        cpts_<n> files; tables each stage as Parquet, by name; config.json the parameters and
        normalization the plants' centres and scales. The configured mode says whether a
        folder that holds something is an error.
        """
        self.until("result")
        folder = inputs.prepare_folder(self.spark, (folder or self.config.output).rstrip("/"), self.config.output_mode)
        own = [c for c in ("semantic", "instance") if c in self.tables["input"].columns]
        labels = [c for c in ("semantic", "instance") if c in self.points.columns]
        clouds = [("0_Original", self.points, labels), ("1_Input", self.tables["input"], own), ("2_Sampled", self.tables["sampled"].withColumn("point_id", F.col("pos")), []), ("3_Calibrated", self.tables["calibrated"], [])]
        for name, points, columns in clouds:
            ply.write_clouds(points, f"{folder}/{name}", "{plant}.ply", self.config.binary, columns).collect()
        graphs = [("4_Graph", self._vertices(), self.tables["graph"], False), ("5_Tree", self._vertices(), self.tables["tree"], False), ("6_Pruned", *self.tables["pruned"], False), ("7_Segmented", *self.tables["segmented"], True)]
        for name, vertices, edges, labels in graphs:
            ply.write_graphs(vertices, edges, f"{folder}/{name}", "{plant}.ply", self.config.binary, labels).collect()
        snapshots = self.tables["contracted"][2]
        # at most max_iterations + 1 numbers
        for (step,) in snapshots.select("iter").distinct().orderBy("iter").collect():
            shot = snapshots.where(F.col("iter") == step).withColumnRenamed("smooth_sigma", "smooth-sigma")
            ply.write_clouds(shot, f"{folder}/iterations/{step}", "{plant}_" + f"cpts_{step}.ply", self.config.binary, ["smooth-sigma"] if step else []).collect()
        for name, made in self.tables.items():
            for i, df in enumerate(made if isinstance(made, tuple) else (made,)):
                df.write.mode("overwrite").parquet(f"{folder}/tables/{name}" + (f"-{i}" if isinstance(made, tuple) else ""))
        self.normalization().write.mode("overwrite").json(f"{folder}/normalization")
        inputs.write_text(self.spark, f"{folder}/config.json", self.config.dump())
        return ply.write_clouds(self.tables["result"], folder, "{plant}_Result.ply", self.config.binary, ["pred-semantic", "pred-instance"])
