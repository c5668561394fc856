"""PLY files as a Spark data source: format "ply".

Reading: options path (file, folder or glob), element (vertex by default), columns (comma
separated; all by default), split (bytes of a partition, 64 MB by default). Files that are
smaller share partitions; a larger binary file whose rows have one size is cut into ranges of
rows, and a partition reads its range's bytes only. Larger ASCII files, and those with a list
property in or before the element, are a partition each, as their rows' places are not known.
Rows carry plant_id (the file's stem) and point_id (the row's place). List properties become
arrays. ASCII and binary files of both byte orders are read, other elements are skipped.

Writing: write_clouds and write_graphs make one file a plant, ASCII or binary little-endian.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

#: Fixed names of scalar types in PLY headers.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def list_files(path: str, suffix: str = ".ply", recursive: bool = False) -> list[str]:
    """Files below a folder, or the one file, or those a * pattern names; any store that the URI reaches."""
    return [f for f, _ in sized_files(path, suffix, recursive)]


def sized_files(path: str, suffix: str = ".ply", recursive: bool = False) -> list[tuple[str, int]]:
    """list_files with each file's size in bytes, by one listing."""
    from fnmatch import fnmatch

    scheme = path.split("://")[0] + "://" if "://" in path else ""
    folder = path.rsplit("/", 1)[0] if "*" in path else path
    fs, name = _open(folder)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(name, recursive=recursive)) if f.type == pafs.FileType.File]
    pattern = path.rsplit("/", 1)[1] if "*" in path else f"*{suffix}"
    return sorted(((scheme if scheme and scheme != "file://" else "") + f, size) for f, size in found if fnmatch(f.rsplit("/", 1)[1], pattern))


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[1] if "/" in path else path)


class Header:
    """Elements and properties of a PLY header, and where the data begins."""

    def __init__(self, raw: bytes):
        end = re.search(rb"end_header\r?\n", raw)
        if not raw.startswith(b"ply") or end is None:
            raise ValueError("not a PLY file")
        self.start, self.format, self.elements = end.end(), "", []
        for line in raw[: end.start()].decode("ascii", "replace").splitlines():
            word = line.split()
            if not word or word[0] in ("ply", "comment", "obj_info"):
                continue
            if word[0] == "format":
                self.format = word[1]
            elif word[0] == "element":
                self.elements.append((word[1], int(word[2]), []))
            elif word[0] == "property" and word[1] == "list":
                self.elements[-1][2].append((word[4], TYPES[word[3]], TYPES[word[2]]))
            elif word[0] == "property":
                self.elements[-1][2].append((word[2], TYPES[word[1]], None))
        if self.format not in ("ascii", "binary_little_endian", "binary_big_endian"):
            raise ValueError(f"unknown PLY format {self.format!r}")


    def rows_at(self, element: str) -> tuple[np.dtype, int, int] | None:
        """(row, offset of the first row, rows) of a binary element whose rows have one size, as have all before it; else None."""
        if self.format == "ascii":
            return None
        at = self.start
        for name, count, properties in self.elements:
            if any(size is not None for _, _, size in properties):
                return None
            kind = np.dtype([(p, ("<" if "little" in self.format else ">") + t) for p, t, _ in properties])
            if name == element:
                return kind, at, count
            at += kind.itemsize * count
        return None


def _header(path: str) -> Header:
    fs, name = _open(path)
    with fs.open_input_stream(name) as source:
        return Header(source.read(1 << 20))


def read_element(raw: bytes, element: str) -> dict[str, np.ndarray | list]:
    """The element's columns by property name."""
    header = Header(raw)
    if header.format == "ascii":
        return _read_ascii(header, raw, element)
    order, at = "<" if "little" in header.format else ">", header.start
    for name, count, properties in header.elements:
        if all(size is None for _, _, size in properties):
            kind = np.dtype([(p, order + t) for p, t, _ in properties])
            if name == element:
                rows = np.frombuffer(raw, dtype=kind, count=count, offset=at)
                return {p: rows[p].astype(rows[p].dtype.newbyteorder("=")) for p, _, _ in properties}
            at += kind.itemsize * count
            continue
        columns: dict[str, list] = {p: [] for p, _, _ in properties}
        for _ in range(count):
            for p, t, size in properties:
                n = 1
                if size is not None:
                    n = int(np.frombuffer(raw, order + size, 1, at)[0])
                    at += np.dtype(size).itemsize
                values = np.frombuffer(raw, order + t, n, at)
                at += n * np.dtype(t).itemsize
                columns[p].append(values.tolist() if size is not None else values[0].item())
        if name == element:
            return columns
    raise ValueError(f"no element {element!r}")


def _read_ascii(header: Header, raw: bytes, element: str) -> dict[str, np.ndarray | list]:
    words = iter(raw[header.start :].split())
    for name, count, properties in header.elements:
        columns: dict[str, list] = {p: [] for p, _, _ in properties}
        for _ in range(count):
            for p, t, size in properties:
                read = float if t[0] == "f" else int
                columns[p].append(read(next(words)) if size is None else [read(next(words)) for _ in range(int(next(words)))])
        if name == element:
            return {p: columns[p] if size is not None else np.array(columns[p], dtype=t) for p, t, size in properties}
    raise ValueError(f"no element {element!r}")


def _spark_type(kind: str, is_list: bool):
    base = FloatType() if kind == "f4" else DoubleType() if kind == "f8" else LongType()
    return ArrayType(base) if is_list else base


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        files = list_files(self.options["path"])
        if not files:
            raise ValueError(f"no PLY files at {self.options['path']}")
        header = _header(files[0])
        wanted = self.options.get("element", "vertex")
        found = next((p for n, _, p in header.elements if n == wanted), None)
        if found is None:
            raise ValueError(f"no element {wanted!r} in {files[0]}")
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or [p for p, _, _ in found]
        kinds = {p: _spark_type(t, size is not None) for p, t, size in found}
        return StructType([StructField("plant_id", StringType()), StructField("point_id", LongType()), *(StructField(n, kinds[n]) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(schema, dict(self.options))


#: Bytes of a partition.
SPLIT = 64 << 20


class PlyPieces(InputPartition):
    """Pieces (path, first row, rows); rows is None for a whole file."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        self.pieces = pieces


class PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.element = options.get("element", "vertex")

    def partitions(self):
        """Small files together, large ones by ranges of rows; only the headers of large files are opened here."""
        split = int(self.options.get("split", SPLIT))
        out, bundle, held = [], [], 0
        for path, size in sized_files(self.options["path"]):
            fixed = _header(path).rows_at(self.element) if size > split else None
            if fixed is not None:
                kind, _, count = fixed
                step = max(1, split // max(1, kind.itemsize))
                out += [PlyPieces([(path, first, min(step, count - first))]) for first in range(0, count, step)]
            elif size > split:
                out.append(PlyPieces([(path, 0, None)]))
            else:
                if bundle and held + size > split:
                    out.append(PlyPieces(bundle))
                    bundle, held = [], 0
                bundle, held = [*bundle, (path, 0, None)], held + size
        return [*out, PlyPieces(bundle)] if bundle or not out else out

    def read(self, partition: PlyPieces):
        for path, first, count in partition.pieces:
            yield from self._rows(path, first, count)

    def _rows(self, path: str, first: int, count: int | None):
        fs, name = _open(path)
        if count is None:
            with fs.open_input_stream(name) as source:
                columns = read_element(source.read(), self.element)
        else:
            kind, at, _ = _header(path).rows_at(self.element)
            with fs.open_input_file(name) as source:
                rows = np.frombuffer(source.read_at(count * kind.itemsize, at + first * kind.itemsize), dtype=kind)
            if len(rows) < count:
                raise ValueError(f"{path} ends before its {self.element} rows do")
            columns = {c: rows[c].astype(rows[c].dtype.newbyteorder("=")) for c in kind.names}
        names = self.schema.fieldNames()[2:]
        missing = [c for c in names if c not in columns]
        if missing:
            raise ValueError(f"{path} has no {self.element} property {' and no '.join(missing)}")
        n = len(columns[names[0]]) if names else 0
        target = self.schema_arrow()
        for start in range(0, n, 65_536):
            stop = min(n, start + 65_536)
            arrays = [pa.array([stem(path)] * (stop - start)), pa.array(np.arange(first + start, first + stop))]
            arrays += [pa.array(columns[c][start:stop]).cast(target.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    def schema_arrow(self) -> pa.Schema:
        plain = {FloatType: pa.float32(), DoubleType: pa.float64(), LongType: pa.int64(), StringType: pa.string()}
        of = lambda t: pa.list_(plain[type(t.elementType)]) if isinstance(t, ArrayType) else plain[type(t)]
        return pa.schema([(f.name, of(f.dataType)) for f in self.schema])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def read_cloud(spark: SparkSession, path: str, single: bool = True, finite_only: bool = False) -> DataFrame:
    """(plant_id, point_id, x, y, z) as doubles; single rounds coordinates to 32 bits as ingestion does.

    finite_only drops points with a coordinate that is not finite, as the evaluators do.
    """
    from pyspark.sql import functions as F

    from arborel.operators.cloud import finite

    register(spark)
    df = spark.read.format("ply").option("columns", "x,y,z").load(path)
    df = df.select("plant_id", "point_id", *[F.col(a).cast("float" if single else "double").cast("double").alias(a) for a in "xyz"])
    return finite(df) if finite_only else df


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """All vertex properties."""
    register(spark)
    return spark.read.format("ply").load(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): vertices that are not finite go, the rest are renumbered, edges to lost or unknown vertices go."""
    from pyspark.sql import functions as F

    from arborel.operators.cloud import finite
    from arborel.operators.graph import renumber

    register(spark)
    vertices = finite(spark.read.format("ply").load(path)).withColumnRenamed("point_id", "vertex_id")
    edges = spark.read.format("ply").option("element", "edge").load(path).select("plant_id", F.col("vertex1").alias("src"), F.col("vertex2").alias("dst"))
    return renumber(vertices, edges)


def _bytes(elements: list[tuple[str, dict[str, np.ndarray]]], binary: bool) -> bytes:
    lines = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0"]
    body = []
    for name, columns in elements:
        n = len(next(iter(columns.values()))) if columns else 0
        lines.append(f"element {name} {n}")
        lines += [f"property {'double' if v.dtype.kind == 'f' else 'int'} {c}" for c, v in columns.items()]
        rows = np.empty(n, dtype=[(c, "<f8" if v.dtype.kind == "f" else "<i4") for c, v in columns.items()])
        for c, v in columns.items():
            rows[c] = v
        body.append(rows.tobytes() if binary else "".join(" ".join(repr(x.item()) for x in r) + "\n" for r in rows).encode())
    return ("\n".join(lines) + "\nend_header\n").encode() + b"".join(body)


def _write(folder: str, name: str, raw: bytes, attempt: str) -> str:
    """Write under another name first, so that a lost task leaves no half file."""
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/.{name}.{attempt}") as sink:
        sink.write(raw)
    fs.move(f"{at}/.{name}.{attempt}", f"{at}/{name}")
    return f"{folder}/{name}"


def _attempt() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return str(context.taskAttemptId()) if context else "0"


def write_clouds(points: DataFrame, folder: str, name: str = "{plant}.ply", binary: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One file a plant with x, y, z and the given columns (int or double), in point_id order; (plant_id, path, n)."""
    import pandas as pd

    extra = columns or []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plant = pdf.plant_id.iloc[0]
        pdf = pdf.sort_values("point_id")
        raw = _bytes([("vertex", {c: pdf[c].to_numpy() for c in ("x", "y", "z", *extra)})], binary)
        return pd.DataFrame({"plant_id": [plant], "path": [_write(folder, name.format(plant=plant), raw, _attempt())], "n": [len(pdf)]})

    kind = dict(points.dtypes)["plant_id"]
    picked = points.select("plant_id", "point_id", "x", "y", "z", *extra)
    return picked.groupBy("plant_id").applyInPandas(run, f"plant_id {kind}, path string, n long")


def write_graphs(vertices: DataFrame, edges: DataFrame, folder: str, name: str = "{plant}.ply", binary: bool = True, labels: bool = False) -> DataFrame:
    """One file a plant with its vertices and edges (vertex1, vertex2), and semantic and instance of both if labels; (plant_id, path, n)."""
    import pandas as pd

    more = ["semantic", "instance"] if labels else []

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        plant = v.plant_id.iloc[0]
        v, e = v.sort_values("vertex_id"), e.sort_values(["src", "dst"])
        ends = {"vertex1": e["src"].to_numpy(np.int32), "vertex2": e["dst"].to_numpy(np.int32)} | {c: e[c].to_numpy(np.int32) for c in more}
        raw = _bytes([("vertex", {c: v[c].to_numpy() for c in ("x", "y", "z", *more)}), ("edge", ends)], binary)
        return pd.DataFrame({"plant_id": [plant], "path": [_write(folder, name.format(plant=plant), raw, _attempt())], "n": [len(v)]})

    kind = dict(vertices.dtypes)["plant_id"]
    v = vertices.select("plant_id", "vertex_id", "x", "y", "z", *more).groupBy("plant_id")
    return v.cogroup(edges.select("plant_id", "src", "dst", *more).groupBy("plant_id")).applyInPandas(run, f"plant_id {kind}, path string, n long")
