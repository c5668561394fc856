"""Configured inputs with and without labels, output folders, and the evaluators on files."""

import json

import numpy as np
import pytest

from arborel.config import Config
from arborel.plans import evaluation
from arborel.sources import inputs, ply

POINTS = "plant_id string, point_id long, x double, y double, z double, semantic int, instance int"
ROWS = [(p, i, i * 0.5, -i * 1.25, 3.0, i % 2, i - 1) for p in ("one", "two") for i in range(6)]


@pytest.fixture
def folder(spark, tmp_path):
    ply.write_clouds(spark.createDataFrame(ROWS, POINTS), str(tmp_path / "in"), columns=["semantic", "instance"]).collect()
    (tmp_path / "a.xyz").write_text("".join(f"{i} 2 3 {i % 2}.7 {i - 1}\n" for i in range(4)))
    (tmp_path / "sem.txt").write_text("1\n0\n1\n0\n")
    (tmp_path / "inst.txt").write_text("0\n-1\n1\n-1\n")
    return tmp_path


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_named_properties_of_ply_files(spark, folder):
    config = Config(input=str(folder / "in"), with_labels=True)
    assert rows(inputs.load(spark, config)) == sorted(ROWS)
    assert rows(inputs.load(spark, Config(input=str(folder / "in")))) == sorted(r[:5] for r in ROWS)
    with pytest.raises(ValueError, match="no vertex property leaf"):
        inputs.load(spark, Config(input=str(folder / "in"), with_labels=True, semantic_name="leaf"))


def test_label_columns_and_files(spark, folder):
    config = Config(input=str(folder / "a.xyz"), extension=".xyz", with_labels=True)
    assert [r[5:] for r in rows(inputs.load(spark, config))] == [(0, -1), (1, 0), (0, 1), (1, 2)]
    files = {"semantic_file": str(folder / "sem.txt"), "instance_file": str(folder / "inst.txt")}
    want = [(1, 0), (0, -1), (1, 1), (0, -1)]
    assert [r[5:] for r in rows(inputs.load(spark, Config(input=str(folder / "a.xyz"), extension=".xyz", with_labels=True, **files)))] == want
    with pytest.raises(Exception, match="do not match"):
        inputs.load(spark, Config(input=str(folder / "in" / "one.ply"), with_labels=True, **files)).collect()
    with pytest.raises(ValueError, match="one cloud"):
        inputs.load(spark, Config(input=str(folder / "in"), with_labels=True, **files))
    for bad in ({"semantic_file": "x"}, {"total_columns": 2}, {"semantic_column": 5}, {"output_mode": "append"}):
        with pytest.raises(ValueError):
            Config(with_labels=True, **bad).validate()


def test_inputs_that_are_not_there(spark, folder):
    for bad in ("nowhere", "in/none.ply"):
        with pytest.raises(ValueError, match="no input"):
            inputs.load(spark, Config(input=str(folder / bad)))
    with pytest.raises(ValueError, match=r"no \.xyz file"):
        inputs.load(spark, Config(input=str(folder / "in"), extension=".xyz"))
    (folder / "x.las").write_text("x")
    with pytest.raises(ValueError, match="unknown"):
        inputs.load(spark, Config(input=str(folder / "x.las")))


def test_output_folders(spark, tmp_path):
    out = str(tmp_path / "a" / "b")
    assert inputs.prepare_folder(spark, out) == out and inputs.prepare_folder(spark, out) == out
    inputs.write_text(spark, f"{out}/x.json", '{"é": 1}')
    assert json.loads((tmp_path / "a" / "b" / "x.json").read_text()) == {"é": 1}
    with pytest.raises(ValueError, match="not empty"):
        inputs.prepare_folder(spark, out)
    inputs.prepare_folder(spark, out, "overwrite")
    assert (tmp_path / "a" / "b" / "x.json").exists()


def test_segmentation_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    truth = [(p, i, 0.0, 0.0, float(i), int(i > 7), -1 if i <= 7 else i % 2) for p in ("a", "b", "c") for i in range(20)]
    guess = [(p, i, x, y, z, s if rng.random() < 0.8 else 1 - s, n) for p, i, x, y, z, s, n in truth if p != "c"]
    for name, data in (("Input", truth), ("Result", guess)):
        df = spark.createDataFrame(data, POINTS)
        if name == "Result":
            df = df.withColumnsRenamed({"semantic": "pred-semantic", "instance": "pred-instance"})
        columns = [c for c in df.columns if c.endswith(("semantic", "instance"))]
        ply.write_clouds(df, str(tmp_path / "d"), "{plant}_" + f"{name}.ply", columns=columns).collect()
    metrics = evaluation.evaluate_segmentation(spark, str(tmp_path / "d"), str(tmp_path / "out"))
    got = {(r.kind, r.plant_id, r["class"], r.metric): r.value for r in metrics.collect()}
    for p in "ab":
        g, t = ([r[5] for r in data if r[0] == p] for data in (guess, truth))
        tp = sum(a == b == 1 for a, b in zip(g, t))
        assert got["semantic", p, "1", "precision"] == pytest.approx(tp / sum(g)) and got["semantic", p, "1", "tp"] == tp
    accuracy = [np.mean([a[5] == b[5] for a, b in zip([r for r in guess if r[0] == p], [r for r in truth if r[0] == p])]) for p in "ab"]
    assert got["semantic", "Overall", "mean", "accuracy"] == pytest.approx(np.mean(accuracy))
    assert got["semantic", "Overall", "mean", "accuracy_std"] == pytest.approx(np.std(accuracy, ddof=1))
    assert not any(k[1] == "c" for k in got)
    assert json.loads((tmp_path / "out" / "semantic.json").read_text())["a"]["1"]["tp"] == got["semantic", "a", "1", "tp"]
    assert "1" in json.loads((tmp_path / "out" / "instance.json").read_text())["Overall"]
    ply.write_clouds(spark.createDataFrame([r for r in truth if r[0] == "a"][:5], POINTS), str(tmp_path / "d"), "{plant}_Input.ply", columns=["semantic", "instance"]).collect()
    with pytest.raises(Exception, match="unequal numbers"):
        evaluation.read_segmentation(spark, str(tmp_path / "d")).collect()
    (tmp_path / "d" / "a_Input.ply").unlink()
    with pytest.raises(Exception, match="no input file"):
        evaluation.read_segmentation(spark, str(tmp_path / "d")).collect()


def test_skeleton_files_and_report(spark, tmp_path):
    cloud = spark.createDataFrame([("p", i, float(i % 7), 1.0, 0.0) for i in range(14)] + [("p", 99, float("nan"), 0.0, 0.0)], "plant_id string, point_id long, x double, y double, z double")
    v = spark.createDataFrame([("p", 0, 0.0, 0.0, 0.0), ("p", 1, 6.0, 0.0, 0.0), ("p", 2, float("inf"), 0.0, 0.0)], "plant_id string, vertex_id long, x double, y double, z double")
    e = spark.createDataFrame([("p", 0, 1), ("p", 1, 2)], "plant_id string, src long, dst long")
    ply.write_clouds(cloud, str(tmp_path / "c")).collect()
    ply.write_graphs(v, e, str(tmp_path / "g")).collect()
    metrics = evaluation.evaluate_skeleton(spark, str(tmp_path / "c"), str(tmp_path / "g"))
    r = metrics.first()
    assert (r.points, r.vertices, r.edges, r.forward_mean, r.chamfer) == (14, 2, 1, 1.0, 1.0)
    text = evaluation.report(metrics)
    assert text.startswith("p: 14 points, 2 vertices, 1 edges") and "Chamfer               1.000000" in text
