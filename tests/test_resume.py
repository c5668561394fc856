"""Runs that go on from a store."""

import json
import random
from dataclasses import replace

import pytest

from arborel.config import Config
from arborel.plans.stages import NEEDS, READS, STAGES, Run
from arborel.sources import inputs

POINTS = "plant_id string, point_id long, x double, y double, z double"
CONFIG = Config(
    down_sample=90, max_iterations=1, fps_ratio=0.3, knn=6, knn_most=10, area_knn=8, sigma_radius=0.05, max_distance=0.05, lop_ratio=0.08, prune_ratio=0.03, tip_neighbours=12, geodesic="graph", intrinsic=False,
)


def made(run):
    return [stage for stage, _ in run.timings]


def test_a_new_session_goes_on_and_parameters_decide(spark, tmp_path):
    rng = random.Random(2)
    arms = [((0, 0, 0), (0, 0, 1)), ((0, 0, 1), (0.5, 0, 1.5)), ((0, 0, 1), (-0.5, 0, 1.5))]
    rows = []
    for i in range(120):
        a, b = arms[i % 3]
        t = rng.random()
        rows.append(("y", i, *(p + t * (q - p) + rng.gauss(0, 0.01) for p, q in zip(a, b))))
    points, store = spark.createDataFrame(rows, POINTS), str(tmp_path / "store")
    first = Run(points, CONFIG, store, "rows-1").until("contracted")
    assert made(first) == ["input", "contracted"]
    # a stage that the lost session had begun: tables without their mark
    torn = tmp_path / "store" / "sampled" / first.fingerprint("sampled")[:32] / "0"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"half a file")
    second = Run(spark.newSession().createDataFrame(rows, POINTS), CONFIG, store, "rows-1").until("result")
    assert made(second) == STAGES[2:]
    want = sorted(map(tuple, second.tables["result"].collect()))
    third = Run(points, CONFIG, store, "rows-1").until("result")
    assert made(third) == [] and sorted(map(tuple, third.tables["result"].collect())) == want
    pruned = Run(points, replace(CONFIG, prune_ratio=0.05), store, "rows-1").until("result")
    assert made(pruned) == ["pruned", "segmented", "result"]
    other = Run(points, CONFIG, store, "rows-2")
    assert other.fingerprint("input") != first.fingerprint("input") and other._stored("input") is None
    mark = json.loads((tmp_path / "store" / "pruned" / pruned.fingerprint("pruned")[:32] / "stage.json").read_text())
    assert mark["parameters"] == {"prune_ratio": 0.05} and mark["source"] == "rows-1"
    with pytest.raises(ValueError, match="source"):
        Run(points, CONFIG, store)


def test_fingerprints_follow_what_a_stage_reads(spark):
    points = spark.createDataFrame([], POINTS)
    assert list(NEEDS) == STAGES == list(READS)
    base = Run(points, CONFIG, "nowhere", "s")
    for name, value, first in (("knn", 7, "contracted"), ("fps_ratio", 0.2, "sampled"), ("graph_step", 0.002, "graph"), ("down_sample", 80, "input"), ("binary", False, None)):
        run = Run(points, replace(CONFIG, **{name: value}), "nowhere", "s")
        changed = [s for s in STAGES if run.fingerprint(s) != base.fingerprint(s)]
        assert changed == (STAGES[STAGES.index(first) :] if first else [])


def test_files_are_fingerprinted(spark, tmp_path):
    path = tmp_path / "a.xyz"
    path.write_text("0 0 0\n1 1 1\n")
    config = Config(input=str(path), extension=".xyz")
    before = inputs.fingerprint(spark, config)
    assert inputs.fingerprint(spark, config) == before
    path.write_text("0 0 0\n1 1 1\n2 2 2\n")
    assert inputs.fingerprint(spark, config) != before
    assert inputs.read_text(spark, str(tmp_path / "none")) is None and inputs.read_text(spark, str(path)) == "0 0 0\n1 1 1\n2 2 2\n"
