"""Fill-in-middle examples whose cuts are found from counts of content-defined chunks.

A text is cut where a rolling hash of its last WINDOW bytes has MASK's bits clear, so the same
passage is cut in the same places wherever it stands. What a chunk adds to a text is a small
summary: its code points, whether it holds a marker, and the bytes at its two ends, which tell
of markers across a boundary. Summaries are remembered by the chunk's whole content, so
passages that documents share are summed up once by a worker. Two summaries combine into that
of the joined text; running counts say which chunk holds a cut, and only there code points are
told apart. Texts stay UTF-8 bytes throughout.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes under the rolling hash; a cut where the hash has these bits clear: some 1024 bytes apart.
WINDOW, MASK = 32, np.uint32(0x3FF << 22)
#: Longest chunk in bytes, for texts in which the hash never cuts.
LONGEST = 1 << 16
#: Bytes of chunks that a worker remembers before it starts anew.
REMEMBERED = 64 << 20
#: Bytes of texts that are hashed at once.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Markers:
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def within(self, data: bytes) -> bool:
        return self.prefix in data or self.suffix in data or self.middle in data

    @property
    def reach(self) -> int:
        """Bytes at an end of a chunk that may belong to a marker across it."""
        return max(len(self.prefix), len(self.suffix), len(self.middle)) - 1


@dataclass(frozen=True)
class Summary:
    """What a stretch of text adds: its code points, its ends and whether it holds a marker."""

    chars: int
    size: int
    head: bytes
    tail: bytes
    marked: bool

    @classmethod
    def of(cls, data: bytes, markers: Markers) -> Summary:
        chars = len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
        reach = markers.reach
        return cls(chars, len(data), data[:reach], data[max(0, len(data) - reach) :], markers.within(data))

    def then(self, after: Summary, markers: Markers) -> Summary:
        """The summary of this stretch followed by another."""
        reach = markers.reach
        tail = after.tail if after.size >= reach else (self.tail + after.tail)[-reach:]
        head = self.head if self.size >= reach else (self.head + after.head)[:reach]
        marked = self.marked or after.marked or markers.within(self.tail + after.head)
        return Summary(self.chars + after.chars, self.size + after.size, head, tail, marked)


@cache
def _gear() -> np.ndarray:
    """A random number for each byte value."""
    digests = b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256))
    return np.frombuffer(digests, dtype="<u4")


def cuts(data: np.ndarray) -> np.ndarray:
    """Ascending ends of data's chunks (bytes of one text or of several in a row), each at the start of a code point.

    The hash of a place is the sum of its last WINDOW bytes' numbers, each shifted by its
    distance; it is built by doubling the window.
    """
    rolled = _gear()[data]
    width = 1
    while width < WINDOW:
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = longer, 2 * width
    ends = np.flatnonzero((rolled & MASK) == 0) + 1
    return _to_starts(data, ends)


def _to_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Move each end on to the next start of a code point (three bytes at most)."""
    ends = ends[ends < len(data)]
    for _ in range(3):
        inside = ends < len(data)
        inside[inside] = (data[ends[inside]] & 0xC0) == 0x80
        if not inside.any():
            break
        ends = ends + inside
    return np.unique(ends[ends < len(data)])


def chunk_ends(data: np.ndarray, found: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of the text data[begin:end], given the places where the hash cuts.

    The first WINDOW bytes of a text are not cut, as the hash there depends on what stands before.
    """
    low, high = np.searchsorted(found, [begin + WINDOW, end])
    inner = [*found[low:high].tolist(), end] if end > begin else []
    out, last = [], begin
    for stop in inner:
        if stop - last > LONGEST:
            forced = last + LONGEST * np.arange(1, (stop - last - 1) // LONGEST + 1)
            out += (begin + _to_starts(data[begin:stop], forced - begin)).tolist()
        out.append(stop)
        last = stop
    return out


class Memory:
    """Summaries by whole content; equal hashes of different chunks never share one."""

    def __init__(self, markers: Markers, most: int = REMEMBERED):
        self.markers, self.most, self.held, self.known = markers, most, 0, {}
        self.hits = 0

    def summary(self, chunk: bytes) -> Summary:
        got = self.known.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        if self.held > self.most:
            self.known, self.held = {}, 0
        got = self.known[chunk] = Summary.of(chunk, self.markers)
        self.held += len(chunk) + 200
        return got


class ChunkedText:
    """A text as chunks with summaries."""

    def __init__(self, raw: bytes, ends: list[int], memory: Memory):
        self.raw, self.starts = raw, [0, *ends][: len(ends)]
        parts = [memory.summary(raw[a:b]) for a, b in zip(self.starts, ends, strict=True)]
        self.before = [0, *accumulate(p.chars for p in parts)]
        whole = Summary(0, 0, b"", b"", False)
        for part in parts:
            whole = whole.then(part, memory.markers)
        self.chars, self.marked = whole.chars, whole.marked

    def offset(self, chars: int) -> int:
        """The byte where code point number `chars` starts."""
        if chars >= self.chars:
            return len(self.raw)
        at = bisect_right(self.before, chars) - 1
        start, rest = self.starts[at], chars - self.before[at]
        end = self.starts[at + 1] if at + 1 < len(self.starts) else len(self.raw)
        if end - start == self.before[at + 1] - self.before[at]:
            return start + rest
        lead = np.flatnonzero((np.frombuffer(self.raw, np.uint8, end - start, start) & 0xC0) != 0x80)
        return start + int(lead[rest])


@dataclass(frozen=True)
class Rates:
    """Of 100 texts, how many become examples, and of 100 examples, how many name the suffix first."""

    changed: int = 90
    suffix_first: int = 20


def numbers_of(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed, colon and decimal id (nothing for null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _texts_together(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for raw in texts:
        held.append(raw)
        size += len(raw)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _chunked(texts: list[bytes], memory: Memory) -> Iterator[ChunkedText]:
    for held in _texts_together(texts):
        data = np.frombuffer(b"".join(held), np.uint8)
        found, begin = cuts(data), 0
        for raw in held:
            ends = chunk_ends(data, found, begin, begin + len(raw))
            yield ChunkedText(raw, [e - begin for e in ends], memory)
            begin += len(raw)


def _example(text: ChunkedText, h: tuple, markers: Markers, rates: Rates) -> tuple:
    """n, form, prefix_chars, middle_chars and output of a text with its four numbers."""
    n, raw = text.chars, text.raw
    if n == 0 or text.marked or h[2] % 100 >= rates.changed:
        return n, "plain", None, None, raw
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = text.offset(first), text.offset(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h[3] % 100 < rates.suffix_first:
        output = b"".join((markers.suffix, suffix, markers.prefix, prefix, markers.middle, middle))
        return n, "spm", first, second - first, output
    output = b"".join((markers.prefix, prefix, markers.suffix, suffix, markers.middle, middle))
    return n, "psm", first, second - first, output


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", markers: Markers = Markers(), rates: Rates = Rates()
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of docs, no shuffle.

    n counts code points. Cuts and form follow from the id and the seed alone, so reruns,
    retried tasks and rows that repeat an id agree; a null id is hashed as no digits. Null
    texts count as empty. Empty texts, and those that hold a marker themselves, stay plain,
    with null counts. Texts are taken whole, however long. Other columns are not read. No rows
    give no rows.
    """

    def batches(found):
        memory = Memory(markers)
        for batch in found:
            texts = [raw or b"" for raw in batch.column("text").to_pylist()]
            hashes = zip(*[batch.column(f"h{i}").to_pylist() for i in range(1, 5)], strict=True)
            ids, at, rows, size = batch.column("doc_id"), 0, [], 0
            for text, h in zip(_chunked(texts, memory), hashes, strict=True):
                rows.append(_example(text, h, markers, rates))
                size += len(rows[-1][4])
                if size >= 8 * TOGETHER:
                    yield _batch(ids.slice(at, len(rows)), rows)
                    at, rows, size = at + len(rows), [], 0
            if rows:
                yield _batch(ids.slice(at, len(rows)), rows)

    h = numbers_of(F.col(id_col), seed)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *[v.alias(f"h{i}") for i, v in enumerate(h, 1)])
    out = given.mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that an output of this form was made of; markers stand in it once each."""
    prefix, suffix, middle = (F.lit(m.decode()) for m in (markers.prefix, markers.suffix, markers.middle))
    order = {"psm": (prefix, suffix), "spm": (suffix, prefix)}
    head, last = F.split_part(output, middle, F.lit(1)), F.split_part(output, middle, F.lit(2))
    made = F.when(form == "plain", output)
    for name, (_, second) in order.items():
        opening = len(markers.prefix if name == "psm" else markers.suffix)
        one, two = F.split_part(head, second, F.lit(1)), F.split_part(head, second, F.lit(2))
        one = F.substring(one, opening + 1, 2**31 - 1)
        made = made.when(form == name, F.concat(one, last, two) if name == "psm" else F.concat(two, last, one))
    return made


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), seed="1")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbered AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
