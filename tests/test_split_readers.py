import numpy as np
import pytest

from arborel.config import Config
from arborel.sources import inputs, ply, text


def _file(path, n, order="<", first=()):
    """A binary file of n vertices and n - 1 edges; `first` are list rows of an element before them."""
    rng = np.random.default_rng(n)
    rows = np.zeros(n, dtype=[("x", order + "f8"), ("y", order + "f4"), ("z", order + "f8"), ("tag", order + "i2")])
    rows["x"], rows["y"], rows["z"], rows["tag"] = rng.random(n), rng.random(n), np.arange(n), np.arange(n) % 7
    edges = np.zeros(n - 1, dtype=[("vertex1", order + "i4"), ("vertex2", order + "i4")])
    edges["vertex1"], edges["vertex2"] = np.arange(n - 1), np.arange(1, n)
    kind = "little" if order == "<" else "big"
    head = ["ply", f"format binary_{kind}_endian 1.0"]
    head += [f"element face {len(first)}", "property list uchar int corners"] if first else []
    head += [f"element vertex {n}", "property double x", "property float y", "property double z", "property short tag"]
    head += [f"element edge {n - 1}", "property int vertex1", "property int vertex2", "end_header"]
    lists = b"".join(np.uint8(len(f)).tobytes() + np.array(f, order + "i4").tobytes() for f in first)
    path.write_bytes(("\n".join(head) + "\n").encode() + lists + rows.tobytes() + edges.tobytes())
    return rows


def _frame(spark, path, split, **options):
    ply.register(spark)
    return spark.read.format("ply").option("split", split).options(**options).load(str(path))


@pytest.mark.parametrize("order", ["<", ">"])
def test_ranges_of_a_file_give_the_rows_of_the_whole(spark, tmp_path, order):
    rows = _file(tmp_path / "a.ply", 1000, order)
    whole, cut = _frame(spark, tmp_path / "a.ply", 1 << 20), _frame(spark, tmp_path / "a.ply", 2750)
    assert whole.rdd.getNumPartitions() == 1 and cut.rdd.getNumPartitions() == 8
    key = lambda r: (r.plant_id, r.point_id)
    got = sorted(cut.collect(), key=key)
    assert got == sorted(whole.collect(), key=key)
    assert [(r.point_id, r.z, r.tag) for r in got] == [(i, float(i), i % 7) for i in range(1000)]
    assert np.array_equal([r.x for r in got], rows["x"].astype(float))
    edges = _frame(spark, tmp_path / "a.ply", 800, element="edge")
    assert edges.rdd.getNumPartitions() > 5
    assert sorted((r.point_id, r.vertex1, r.vertex2) for r in edges.collect()) == [(i, i, i + 1) for i in range(999)]


def test_files_with_lists_stay_whole_and_small_files_go_together(spark, tmp_path):
    _file(tmp_path / "lists.ply", 200, "<", [[1, 2, 3], [4, 5], []])
    assert _frame(spark, tmp_path / "lists.ply", 500).rdd.getNumPartitions() == 1
    assert sorted(r.z for r in _frame(spark, tmp_path / "lists.ply", 500).collect()) == list(map(float, range(200)))
    many = tmp_path / "many"
    many.mkdir()
    for n in range(2, 32):
        _file(many / f"p{n}.ply", n)
    cut = _frame(spark, many, 4096)
    assert 2 <= cut.rdd.getNumPartitions() < 15
    assert {r.plant_id: r["count"] for r in cut.groupBy("plant_id").count().collect()} == {f"p{n}": n for n in range(2, 32)}


def test_a_file_that_ends_early_is_an_error(spark, tmp_path):
    _file(tmp_path / "a.ply", 1000)
    raw = (tmp_path / "a.ply").read_bytes()
    (tmp_path / "a.ply").write_bytes(raw[:15_000])
    with pytest.raises(Exception, match="ends before"):
        _frame(spark, tmp_path / "a.ply", 5000).collect()


def test_text_is_cut_at_line_ends(spark, tmp_path):
    """Blocks of 512 bytes, some without a line of their own, number lines as the whole file does."""
    (tmp_path / "in").mkdir()
    wanted = {}
    for name, n, long in (("a", 400, ""), ("b", 3, " 7" * 700), ("c", 1, "")):
        lines = [f"{i} {i / 8} -{i}.5{long}" for i in range(n)]
        (tmp_path / "in" / f"{name}.xyz").write_text("\n".join(lines) + ("" if name == "c" else "\n"))
        wanted |= {(name, i): (float(i), i / 8, -(i + 0.5)) for i in range(n)}
    (tmp_path / "in" / "none.xyz").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        df = text.read_cloud(spark, str(tmp_path / "in" / "*.xyz"))
        assert spark.read.text(str(tmp_path / "in" / "a.xyz")).rdd.getNumPartitions() > 8
        assert {(r.plant_id, r.point_id): (r.x, r.y, r.z) for r in df.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_folder_is_one_scan(spark, tmp_path):
    for n in (3, 4, 5):
        _file(tmp_path / f"p{n}.ply", n)
        (tmp_path / f"t{n}.xyz").write_text("".join(f"{i} 0 0\n" for i in range(n)))
    for extension, stem in ((".ply", "p"), (".xyz", "t")):
        df = inputs.load(spark, Config(input=str(tmp_path), extension=extension))
        assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert {r.plant_id: r["count"] for r in df.groupBy("plant_id").count().collect()} == {f"{stem}{n}": n for n in (3, 4, 5)}
