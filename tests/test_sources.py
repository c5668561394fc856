import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.config import Config
from arborel.sources import folders, ply, text
from arborel.streaming.folder import process

POINTS = "plant_id string, point_id long, x double, y double, z double, semantic int, instance int"
ROWS = [(p, i, i * 0.5, -i * 1.25, 3.0, i % 2, i - 1) for p in ("one", "two") for i in range(5)]


@pytest.mark.parametrize("binary", [True, False])
def test_ply_round_trip(spark, tmp_path, binary):
    df = spark.createDataFrame(ROWS, POINTS)
    made = ply.write_clouds(df, str(tmp_path), binary=binary, columns=["semantic", "instance"]).collect()
    assert sorted(r.n for r in made) == [5, 5]
    back = ply.read_vertices(spark, str(tmp_path))
    assert back.columns == ["plant_id", "point_id", "x", "y", "z", "semantic", "instance"]
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    assert sorted(map(tuple, ply.read_cloud(spark, str(tmp_path / "one.ply")).collect())) == [r[:5] for r in ROWS if r[0] == "one"]


def test_graph_round_trip_drops_what_is_not_finite(spark, tmp_path):
    nan = float("nan")
    v = spark.createDataFrame([("g", 0, 0.0, 0.0, 0.0), ("g", 1, nan, 0.0, 0.0), ("g", 2, 2.0, 0.0, 0.0), ("g", 3, 3.0, 0.0, 0.0)], "plant_id string, vertex_id long, x double, y double, z double")
    e = spark.createDataFrame([("g", 0, 1), ("g", 0, 2), ("g", 2, 3), ("g", 3, 9)], "plant_id string, src long, dst long")
    ply.write_graphs(v, e, str(tmp_path)).collect()
    vertices, edges = ply.read_graph(spark, str(tmp_path))
    assert sorted((r.vertex_id, r.x) for r in vertices.collect()) == [(0, 0.0), (1, 2.0), (2, 3.0)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (1, 2)]


def test_lists_big_endian_and_skipped_elements():
    head = b"ply\nformat binary_big_endian 1.0\ncomment c\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex 2\nproperty float x\nproperty uchar r\nend_header\n"
    raw = head + b"\x03" + np.array([0, 1, 2], ">i4").tobytes() + b"\x01" + np.array([7], ">i4").tobytes() + np.array([1.5], ">f4").tobytes() + b"\x09" + np.array([-2.0], ">f4").tobytes() + b"\x01"
    assert ply.read_element(raw, "face") == {"vertex_indices": [[0, 1, 2], [7]]}
    got = ply.read_element(raw, "vertex")
    assert got["x"].tolist() == [1.5, -2.0] and got["r"].tolist() == [9, 1]
    with pytest.raises(ValueError):
        ply.read_element(raw, "edge")
    with pytest.raises(ValueError):
        ply.Header(b"not ply")


def test_text_clouds(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1 2 3\n4  5   6 7 8\r\n-1e2 0.5 .25\n")
    (tmp_path / "a.sem").write_text("0\n1\n1\n")
    got = sorted(map(tuple, text.load_cloud(spark, str(tmp_path / "a.xyz")).collect()))
    assert got == [("a", 0, 1.0, 2.0, 3.0), ("a", 1, 4.0, 5.0, 6.0), ("a", 2, -100.0, 0.5, 0.25)]
    semantic, instance = (text.read_labels(spark, str(tmp_path / "a.sem"), n) for n in ("semantic", "instance"))
    assert sorted(r.semantic for r in text.with_labels(text.load_cloud(spark, str(tmp_path / "a.xyz")), semantic, instance).collect()) == [0, 1, 1]
    with pytest.raises(Exception, match="do not match"):
        text.with_labels(text.load_cloud(spark, str(tmp_path / "a.xyz")), semantic.where("point_id < 2"), instance).collect()
    (tmp_path / "l.txt").write_text("1 2 3 0.0 -1.0\n4 5 6 1.9 3\n")
    assert [(r.semantic, r.instance) for r in text.read_labelled_cloud(spark, str(tmp_path / "l.txt"), 5, 3, 4).orderBy("point_id").collect()] == [(0, -1), (1, 3)]
    for bad in ("1 2\n", "1 2 3\n\n4 5 6\n", "1\t2\t3\n", "1 x 3\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="without its numbers"):
            text.read_cloud(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(ValueError):
        text.load_cloud(spark, "cloud.las")


def test_folders(spark):
    files = spark.createDataFrame([("in/a.ply",), ("in/b.PLY",), ("in/sub/c.ply",), ("in/d.xyz",)], "path string")
    assert [(r.plant_id, r.path) for r in folders.batch_files(files, "in/", ".ply").collect()] == [("a", "in/a.ply")]
    runs = spark.createDataFrame([("p", f"o/p/cpts_{i}.ply") for i in (2, 10, 9)] + [("p", "o/p/other.ply")], "plant_id string, path string")
    assert [tuple(r) for r in folders.latest_iteration(runs).collect()] == [("p", 10, "o/p/cpts_10.ply")]
    pairs = spark.createDataFrame([("e/x_Result.ply",), ("e/x_Input.ply",), ("e/y_Input.ply",)], "path string")
    assert [tuple(r) for r in folders.pair_results(pairs).collect()] == [("x", "e/x_Result.ply", "e/x_Input.ply")]
    with pytest.raises(Exception, match="no input"):
        folders.pair_results(pairs.where("path like '%Result%'")).collect()
    one = spark.createDataFrame([("p", "o/p_Result.ply"), ("p", "o/n.ply"), ("q", "o/n.ply")], "plant_id string, path string")
    assert folders.unique_result(one.where("plant_id = 'p'")).first().path == "o/p_Result.ply"
    with pytest.raises(Exception, match="exactly one"):
        folders.unique_result(one).collect()


def test_config(spark):
    config = Config.load('{"down_sample": 100, "epsilon": 1}')
    assert config.down_sample == 100 and Config.load(config.dump()) == config and config.frame(spark).count() == 1
    assert [config.neighbours_at(i)[0] for i in (0, 1, 10)] == [8, 12, 32]
    for bad in ('{"knn": 0}', '{"extension": ".las"}', '{"use_radius": true}', '{"nope": 1}', '{"knn": "x"}', '{"fps_ratio": 2.0}'):
        with pytest.raises(ValueError):
            Config.load(bad)


def test_folder_stream_takes_each_file_once(spark, tmp_path):
    df, seen = spark.createDataFrame(ROWS, POINTS), []
    for plant in ("one", "two"):
        ply.write_clouds(df.where(F.col("plant_id") == plant), str(tmp_path / "in")).collect()
        process(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda points, _: seen.extend(r.plant_id for r in points.select("plant_id").distinct().collect())).awaitTermination()
    assert seen == ["one", "two"]
