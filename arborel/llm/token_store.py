"""Token ids of documents in seekable Zstandard files, and readers that decompress only what they need.

A file holds independent Zstandard frames (each with its own content checksum), then one
skippable frame with the documents' index, then the seek table of the public Zstandard
seekable format: a skippable frame that lists every data frame's compressed and decompressed
size and checksum, and a footer. A reader takes the footer from the end, the seek table and
index before it, and then only the frames that hold the requested documents' ids.

Data frames hold ids as little-endian unsigned 32-bit integers, documents one after another
in ascending doc_id, null first; a long document goes on in the frames that follow. The index
holds all ids, then all sizes; a document without an id has id 0 and size -1 - size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.llm.encode import encoder, text_batches
from arborel.scratch import materialize, new_path

#: Fixed values of the public Zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Ids in one frame (256 KiB before compression) and the compression level.
FRAME_IDS, LEVEL = 1 << 16, 3


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path; local and remote stores are reached alike."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Writer:
    """Writes one file; close() gives it its name, so a task that dies leaves no half file under it."""

    def __init__(self, path: str, attempt: str = "0"):
        import zstandard

        self.fs, self.path = open_store(path)
        self.part = f"{self.path}.{attempt}.writing"
        self.sink = self.fs.open_output_stream(self.part)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(tokens))
        self.held.append(tokens.astype("<u4", copy=False))
        self.waiting += len(tokens)
        if self.waiting >= FRAME_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        tokens = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        end = len(tokens) if last else len(tokens) // FRAME_IDS * FRAME_IDS
        for at in range(0, end, FRAME_IDS):
            self._frame(tokens[at : min(at + FRAME_IDS, end)].tobytes())
        self.held, self.waiting = [tokens[end:]], len(tokens) - end

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        self._flush(True)
        index = self.packer.compress(np.array([[i or 0 for i in self.ids], [-1 - n if i is None else n for i, n in zip(self.ids, self.sizes, strict=True)]], dtype="<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.sink.close()
        self.fs.move(self.part, self.path)
        return len(self.ids), sum(self.sizes)


class Reader:
    """Reads documents of one file by doc_id or in order, one frame in memory at a time."""

    def __init__(self, path: str):
        import zstandard

        fs, name = open_store(path)
        self.source = fs.open_input_file(name)
        size = self.source.size()
        n, descriptor, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or descriptor != 0x80:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * n
        self.table = np.frombuffer(self.source.read_at(12 * n, at), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.packer = zstandard.ZstdDecompressor()
        head = int(self.offsets[-1])
        kind, length = struct.unpack("<II", self.source.read_at(8, head))
        if kind != SKIPPABLE_INDEX:
            raise ValueError(f"{path} has no document index")
        both = np.frombuffer(self.packer.decompress(self.source.read_at(length, head + 8)), dtype="<i8").reshape(2, -1)
        self.ids, self.unnamed = both[0], both[1] < 0
        self.sizes = np.where(self.unnamed, -1 - both[1], both[1])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.frame_starts = np.concatenate([[0], np.cumsum(self.table[:, 1].astype(np.int64) // 4)])
        self.frames_read = 0
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _frame(self, k: int) -> np.ndarray:
        import xxhash

        if self._last[0] != k:
            raw = self.packer.decompress(self.source.read_at(int(self.table[k, 0]), int(self.offsets[k])))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.frames_read += 1
            self._last = (k, np.frombuffer(raw, dtype="<u4"))
        return self._last[1]

    def _at(self, position: int) -> np.ndarray:
        start, left = int(self.starts[position]), int(self.sizes[position])
        parts = []
        k = int(np.searchsorted(self.frame_starts, start, side="right")) - 1
        while left:
            frame = self._frame(k)
            inside = start - int(self.frame_starts[k])
            parts.append(frame[inside : inside + left])
            start, left, k = start + len(parts[-1]), left - len(parts[-1]), k + 1
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def _id(self, position: int) -> int | None:
        return None if self.unnamed[position] else int(self.ids[position])

    def read(self, doc_ids: Iterable[int | None]) -> list[tuple[int | None, np.ndarray]]:
        """The requested documents that the file holds, in file order; None asks for all without an id. Other frames stay compressed."""
        asked = set(doc_ids)
        named = np.isin(self.ids, np.fromiter(asked - {None}, dtype=np.int64)) & ~self.unnamed
        wanted = np.flatnonzero(named | self.unnamed if None in asked else named)
        return [(self._id(i), self._at(i)) for i in wanted]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        return ((self._id(i), self._at(i)) for i in range(len(self.ids)))

    def close(self) -> None:
        self.source.close()


def write_store(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode docs into files part-NNNNNN.zst below folder, ascending by doc_id over and within files.

    Returns one row a file: file_no, path, n_docs, n_ids. Null and empty texts hold end_id
    alone (or nothing). Rows that repeat an id are stored next to each other. Rows with a null
    id come first, by a hash of their text, and keep the null. A table
    without rows makes no file with documents. Texts are range partitioned by id, so a file
    is as large as one partition; a retried task writes the same file again.
    """

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        path = f"{folder.rstrip('/')}/part-{number:06d}.zst"
        codec, writer = encoder(tokenizer_path), None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in text_batches(batch.column(1).to_pylist()):
                for doc_id, tokens in zip(ids[start : start + len(texts)], codec.encode(texts), strict=True):
                    if writer is None:
                        writer = Writer(path, f"{context.attemptNumber()}-{context.taskAttemptId()}")
                    writer.add(doc_id, tokens if end_id is None else np.append(tokens, np.uint32(end_id)))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    fs, name = open_store(folder)
    fs.create_dir(name, recursive=True)
    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    ordered = picked.repartitionByRange(parts, "doc_id", unnamed).sortWithinPartitions("doc_id", unnamed)
    files = ordered.mapInArrow(write, "file_no long, path string, n_docs long, n_ids long")
    return materialize(files, "token-files", free_shuffles=True)


def read_store(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files themselves.

    files is what write_store returned: a row a file. start counts the ids of all documents
    before; the running sum over files is over that short list, not over documents.
    """
    from pyspark.sql import Window

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                crc = [zlib.crc32(tokens.tobytes()) for _, tokens in reader]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.ids, pa.int64(), mask=reader.unnamed), pa.array(reader.starts + at, pa.int64()), pa.array(reader.sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                reader.close()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.select("path", "first").repartition(parts, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_store(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-store"), end_id=2)
    return read_store(files)
