"""Removal of byte strings that occur earlier in the corpus, by suffix arrays.

A byte goes when some WINDOW-byte string over it also starts earlier: in a document with a
smaller id, or earlier in the same one. The work takes three steps:

1. What to gather. Every window belongs to the smallest hash of its GRAM-byte strings.
   Neighbouring windows with one such hash form a run; equal windows have equal hashes,
   wherever they stand. Runs whose hash comes up once in the corpus, and once in themselves,
   hold no repeated window; all others are candidates. Nothing is removed here.
2. Suffix arrays. Tasks gather the text of their documents' candidates into shards. Each shard
   gets its suffix array by Larsson-Sadakane refinement in numpy and common prefixes in
   Kasai's order; neighbours with WINDOW bytes in common are one string, and all but the
   shard's first go.
3. Shards are merged. Each sends sorted runs of 96-bit digests with other bases than those of
   step 1, cut at fixed digests into ranges of bounded size: one digest of each candidate run
   as a whole, and one of each window where runs agree only in part (there the first of equal
   runs stands for all). Runs are merged in pairs by binary search; of equal digests the first
   stays and the others go.

Before every exchange a task keeps one row of equal runs, so a passage that stands in a third
of all documents meets at most once for each task.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.llm.near_dedup import mix
from arborel.scratch import materialize

WINDOW, GRAM = 100, 32
#: Bytes of text in one vectorised step; longer documents are taken in parts that overlap.
BLOCK = 1 << 18
#: Rows of runs among which a task drops repeats before they leave it.
HELD_ROWS = 1 << 18
#: Bytes of one shard's suffix array.
SHARD = 1 << 19
#: A run of windows is cut after so many.
LONGEST = 256
_BASES = (0x9E6C63D0876A9A47, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Bytes of digests that one range of the merge should hold.
RANGE_BYTES = 1 << 23


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    return _powers(base, size)


class Hashes:
    """Polynomial hashes of any substring of data from one pass of prefix sums."""

    def __init__(self, data: np.ndarray, base: int):
        self.up, self.down = _table(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of width, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :])


def _repeating(grams: np.ndarray, low: np.ndarray, start: np.ndarray, count: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a run's smallest hash stands at more than one place in it, so that it may repeat itself."""
    span = WINDOW - GRAM + 1
    padded = np.zeros(len(low) + 2 * (span - 1), dtype=np.uint64)
    padded[span - 1 : span - 1 + len(low)] = low
    at = np.flatnonzero(~sliding_min(~padded, span) == grams)  # places that are the smallest of some window
    kinds, kind = np.unique(grams[at], return_inverse=True)
    placed = np.sort((kind.astype(np.int64) << 32) | at)
    own = np.searchsorted(kinds, value) << 32
    return np.searchsorted(placed, own | (start + count - 1 + span)) - np.searchsorted(placed, own | start) > 1


def window_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, start in data, windows, smallest hash, content hash, repeats itself) of the runs in parts data[begin:end], which lie side by side."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes = Hashes(data, _BASES[0])
    grams = hashes.all(GRAM)
    low = sliding_min(grams, WINDOW - GRAM + 1)
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(begin, end - WINDOW + 1), 1)
    np.add.at(edge, end, -1)
    whole = np.cumsum(edge)[:n] == 0
    turn = np.ones(n + 1, dtype=bool)
    turn[1:n] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(turn)
    start, count = at[:-1], np.diff(at)
    keep = whole[start]
    start, count = start[keep], count[keep]
    if (count > LONGEST).any():
        pieces = -(-count // LONGEST)
        offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
        start, count = np.repeat(start, pieces) + offset, np.minimum(LONGEST, np.repeat(count, pieces) - offset)
    part = np.searchsorted(begin, start, side="right") - 1
    return part, start, count, low[start], hashes.at(start, count + WINDOW - 1), _repeating(grams, low, start, count, low[start])


def parts_of(batches, min_bytes: int = WINDOW):
    """(ids, places in the document, data, begin, end): documents side by side in blocks of about BLOCK bytes."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            if len(raw) < min_bytes:
                continue
            for place in range(0, len(raw) - WINDOW + 1, BLOCK):
                piece = raw[place : place + BLOCK + WINDOW - 1]
                held.append((doc_id, place, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield _together(held)
                    held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list) -> tuple:
    length = np.array([len(p) for _, _, p in held])
    end = np.cumsum(length)
    data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
    return np.array([i for i, _, _ in held]), np.array([p for _, p, _ in held]), data, end - length, end


def _first_of_equal(key_a: np.ndarray, key_b: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for the row with the smallest (doc, start) of each pair of keys."""
    order = np.argsort(key_a ^ mix(key_b))
    same = (key_a[order][1:] == key_a[order][:-1]) & (key_b[order][1:] == key_b[order][:-1])
    first = np.ones(len(order), dtype=bool)
    inside = np.zeros(len(order), dtype=bool)
    inside[1:] |= same
    inside[:-1] |= same
    rows = order[inside]  # only rows that have an equal need an order
    rows = rows[np.lexsort((start[rows], doc[rows], key_b[rows], key_a[rows]))]
    repeat = (key_a[rows][1:] == key_a[rows][:-1]) & (key_b[rows][1:] == key_b[rows][:-1])
    first[rows[1:][repeat]] = False
    return first


#: place = start * PLACE + windows, plus REPEATS for a run that may repeat itself, SHARED for the first of equal runs of its task, COPY for a later one.
PLACE, REPEATS, SHARED, COPY = 8192, 512, 1024, 2048


def _runs(docs: DataFrame) -> DataFrame:
    """(low, content, doc_id, place) of every run of windows."""
    schema = pa.schema([("low", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def flush(held):
        low, content, doc, start, count, repeats = (np.concatenate(c) for c in zip(*held, strict=True))
        copy = ~_first_of_equal(low, content, doc, start)
        shared = ~copy & np.isin(content, content[copy])
        place = start * PLACE + count + REPEATS * repeats + SHARED * shared + COPY * copy
        low[copy] = mix(doc[copy].astype(np.uint64) * np.uint64(_BASES[0]) + start[copy].astype(np.uint64))  # not to the hot key's partition
        for at in range(0, len(low), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(low[cut].view(np.int64)), pa.array(content[cut].view(np.int64)), pa.array(doc[cut]), pa.array(place[cut])], schema=schema)

    def run(batches):
        held, size = [], 0
        for ids, places, data, begin, end in parts_of(batches):
            part, start, count, low, content, repeats = window_runs(data, begin, end)
            held.append((low, content, ids[part], start - begin[part] + places[part], count, repeats))
            size += len(low)
            if size >= HELD_ROWS:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return docs.mapInArrow(run, "low long, content long, doc_id long, place long")


def _candidates(runs: DataFrame) -> DataFrame:
    """(doc_id, start, windows, apart) of runs whose hash comes up more than once; apart: the first of its bytes, and others have other bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("apart", pa.bool_())])

    def rows(doc, place, apart):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place // PLACE), pa.array(place % REPEATS), pa.array(apart)], schema=schema)

    def run(batches):
        last = None  # low and content of the row before
        waiting = None  # doc, place, whether it has equals: the first run of a hash, of which no other content has come up yet

        def settled(apart):
            doc, place, equals = waiting
            if apart or equals or place[0] & (REPEATS | SHARED):
                yield rows(doc, place, np.array([apart]))

        for batch in batches:
            low, content, doc, place = (batch.column(i).to_numpy() for i in range(4))
            copy = (place & COPY) > 0
            if copy.any():
                yield rows(doc[copy], place[copy], np.zeros(copy.sum(), dtype=bool))
                low, content, doc, place = (c[~copy] for c in (low, content, doc, place))
            if not len(low):
                continue
            new = np.append(last is None or low[0] != last[0], low[1:] != low[:-1])
            head = new | np.append(last is None or content[0] != last[1], content[1:] != content[:-1])
            last = (low[-1], content[-1])
            first = np.flatnonzero(new)
            carried = int(first[0]) if len(first) else len(low)
            if waiting is not None and head[:carried].any():
                yield from settled(True)
                waiting = None
            elif waiting is not None:
                waiting = (waiting[0], waiting[1], waiting[2] or carried > 0)
            other = head & ~new
            out, apart = ~new, other.copy()
            if len(first):
                if waiting is not None:
                    yield from settled(False)
                several = np.add.reduceat(other, first) > 0
                equals = np.diff(np.append(first, len(low))) > 1
                apart[first] = several
                out[first] = several | equals | ((place[first] & (REPEATS | SHARED)) > 0)
                waiting = None
                if not several[-1]:
                    at = first[-1]
                    waiting, out[at] = (doc[at : at + 1], place[at : at + 1], bool(equals[-1])), False
            if out.any():
                yield rows(doc[out], place[out], apart[out])
        if waiting is not None:
            yield from settled(False)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.repartition(parts, "low").sortWithinPartitions("low", "content", "doc_id", "place")
    return ordered.mapInArrow(run, "doc_id long, start long, windows long, apart boolean")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order: sorted by their first 7 bytes, then Larsson and Sadakane's refinement.

    Only groups that are not yet single suffixes are sorted again, by the rank of the suffix
    that begins where the known prefix ends; that prefix doubles each time.
    """
    n = len(data)
    one = np.zeros(n + 7, dtype=np.uint64)
    one[:n] = data.astype(np.uint64) + np.uint64(1)
    two = (one[:-1] << np.uint64(9)) | one[1:]
    four = (two[:-2] << np.uint64(18)) | two[2:]
    three = (two[4:-1] << np.uint64(9)) | one[6:]
    key = (four[:n] << np.uint64(27)) | three[:n]
    order = np.argsort(key)
    rank = np.zeros(n, dtype=np.int64)
    slots, sorted_key, known = np.arange(n), key[order], 7
    while len(slots):
        turn = np.append(True, sorted_key[1:] != sorted_key[:-1])
        first = slots[np.maximum.accumulate(np.where(turn, np.arange(len(slots)), 0))]
        rank[order[slots]] = first + 1
        single = turn & np.append(turn[1:], True)
        slots = slots[~single]
        inside = order[slots]
        ahead = inside + known
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        sorted_key = (rank[inside].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        again = np.argsort(sorted_key)
        order[slots], sorted_key = inside[again], sorted_key[again]
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int = WINDOW, stride: int = 16) -> np.ndarray:
    """Bytes (cap at most) that each suffix in order shares with the one before it.

    Kasai's bound, in steps: a suffix shares at least one byte less with its neighbour than
    the suffix one place before it in the text. Every stride-th suffix is compared from its
    start, then the suffixes after those from their bound on, all of one residue at once and
    eight bytes at a time.
    """
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view("<u8").ravel()
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    for residue in range(min(stride, n)):
        at = np.arange(residue, n, stride)
        if residue:
            shared[at] = np.maximum(shared[at - 1] - 1, 0)
        at = at[before[at] >= 0]
        while len(at):
            near, far = at + shared[at], before[at] + shared[at]
            room = np.minimum(np.minimum(n - near, n - far), cap - shared[at])
            more = room > 0
            at, near, far, room = at[more], near[more], far[more], room[more]
            differ = eight[near] ^ eight[far]
            lowest = differ & (~differ + np.uint64(1))  # a power of two, which a double holds exactly
            same = np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            shared[at] += np.minimum(same, room)
            at = at[(same == 8) & (room > 8)]
    return shared[order]


def shard_strings(data: np.ndarray, window_at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For the windows that begin at window_at in data: whether each is its string's first by (doc, start), or stands at that very place."""
    order = suffix_array(data)
    shared = common_prefixes(data, order)
    row = np.full(len(data), -1, dtype=np.int64)
    row[window_at] = np.arange(len(window_at))
    group = np.cumsum(shared < WINDOW)
    listed = row[order]
    group, listed = group[listed >= 0], listed[listed >= 0]
    same = group[1:] == group[:-1]
    several = np.append(same, False) | np.append(False, same)  # only strings that come up again need an order
    group, listed = group[several], listed[several]
    by = np.lexsort((start[listed], doc[listed], group))
    group, listed = group[by], listed[by]
    turn = np.append(True, group[1:] != group[:-1])
    least = listed[np.maximum.accumulate(np.where(turn, np.arange(len(listed)), 0))] if len(listed) else listed
    first = np.ones(len(window_at), dtype=bool)
    first[listed] = (doc[listed] == doc[least]) & (start[listed] == start[least])
    return first


#: Windows in a sorted run: 96 bits of digest, their number, the first one's place in its document (below 4 GiB) and the document.
RUN = np.dtype([("a", "<u8"), ("b", "<u4"), ("start", "<u4"), ("doc", "<i8"), ("windows", "<u2")])


def pack_run(run: np.ndarray) -> bytes:
    """A run column by column, compressed: places and documents have few bits each."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(run[c].tobytes() for c in RUN.names))


def unpack_run(raw: bytes) -> np.ndarray:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(raw)
    out, at = np.empty(len(plain) // RUN.itemsize, dtype=RUN), 0
    for name in RUN.names:
        out[name] = np.frombuffer(plain, dtype=RUN[name], count=len(out), offset=at)
        at += RUN[name].itemsize * len(out)
    return out


def merge_runs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(merged run, rows that go) of two runs sorted by digest: each right row is looked up in left by binary search."""
    if not len(left) or not len(right):
        return (left if len(left) else right), left[:0]
    at = np.searchsorted(left["a"], right["a"])
    near = np.minimum(at, len(left) - 1)
    same = (left["a"][near] == right["a"]) & (left["b"][near] == right["b"])
    mine, theirs = near[same], np.flatnonzero(same)
    old = (right["doc"][theirs] < left["doc"][mine]) | ((right["doc"][theirs] == left["doc"][mine]) & (right["start"][theirs] < left["start"][mine]))
    goes = np.where(old, left[mine], right[theirs]) if len(mine) else left[:0]
    goes = goes[(right["doc"][theirs] != left["doc"][mine]) | (right["start"][theirs] != left["start"][mine])]
    left = left.copy()
    left[mine[old]] = right[theirs[old]]
    return np.insert(left, at[~same], right[~same]), goes


def merge_all(runs) -> list[np.ndarray]:
    """What goes when the runs are merged in pairs of like size, each as it comes."""
    gone, stack = [], []
    for run in runs:
        level = 0
        while stack and stack[-1][0] == level:
            run, out = merge_runs(stack.pop()[1], run)
            gone += [out] if len(out) else []
            level += 1
        stack.append((level, run))
    while len(stack) > 1:
        right, left = stack.pop()[1], stack.pop()[1]
        run, out = merge_runs(left, right)
        gone += [out] if len(out) else []
        stack.append((0, run))
    return gone


def window_ranges(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, windows) of the maximal stretches of neighbouring windows; those given do not overlap."""
    order = np.lexsort((start, doc))
    doc, start, windows = doc[order], start[order], windows[order]
    turn = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != (start + windows)[:-1]))) if len(doc) else np.empty(0, dtype=np.int64)
    return doc[turn], start[turn], np.add.reduceat(windows, turn) if len(doc) else windows


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("range", pa.int32()), ("digests", pa.binary())])
_OUT_DDL = "doc_id long, start long, windows long, range int, digests binary"


def _going(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Windows that go, as ranges; they travel beside the digests under negative range numbers."""
    doc, start, windows = window_ranges(doc, start.astype(np.int64), windows.astype(np.int64))
    aside = -1 - (np.arange(len(doc)) % 1024)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(windows), pa.array(aside, pa.int32()), pa.nulls(len(doc)).cast(pa.binary())], schema=_OUT)


def _digests(hashes: tuple[Hashes, Hashes], at: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A sorted run of digests; of equal ones the first by (doc, start) stands for the shard."""
    run = np.empty(len(at), dtype=RUN)
    length = windows + WINDOW - 1
    run["a"], run["b"] = hashes[0].at(at, length), hashes[1].at(at, length) >> np.uint64(32)
    run["doc"], run["start"], run["windows"] = doc, start, windows
    run = run[np.lexsort((start, doc, run["b"], run["a"]))]
    return run[np.append(True, (run["a"][1:] != run["a"][:-1]) | (run["b"][1:] != run["b"][:-1]))] if len(run) else run


def _shards(docs: DataFrame, candidates: DataFrame, ranges: int) -> DataFrame:
    """Suffix-array shards over the candidates: windows that go, and sorted digest runs for the merge.

    Ranges from 0 hold digests of candidate runs, those from `ranges` on digests of windows.
    """

    def one(held):
        data = np.frombuffer(b"".join(h[0] for h in held), dtype=np.uint8)
        base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        runs = np.concatenate([h[1] + [[b, 0, 0]] for h, b in zip(held, base, strict=True)])  # place in data, windows, apart
        owner = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        run_doc, shift = np.array([h[2] for h in held])[owner], (np.array([h[3] for h in held]) - base)[owner]
        of = np.repeat(np.arange(len(runs)), runs[:, 1])
        at = np.arange(len(of)) - (np.cumsum(runs[:, 1]) - runs[:, 1] - runs[:, 0])[of]
        doc, start = run_doc[of], at + shift[of]
        first = shard_strings(data, at, doc, start)
        if not first.all():
            yield _going(doc[~first], start[~first], np.ones((~first).sum(), dtype=np.int64))
        hashes = Hashes(data, _BASES[1]), Hashes(data, _BASES[2])
        whole = _digests(hashes, runs[:, 0], run_doc, runs[:, 0] + shift, runs[:, 1])
        single = first & (runs[of, 2] > 0)
        single = _digests(hashes, at[single], doc[single], start[single], np.ones(single.sum(), dtype=np.int64))
        step = ((1 << 64) + ranges - 1) // ranges
        cuts = np.array([i * step for i in range(1, ranges)], dtype=np.uint64)
        pieces = [*np.split(whole, np.searchsorted(whole["a"], cuts)), *np.split(single, np.searchsorted(single["a"], cuts))]
        keep = [i for i, p in enumerate(pieces) if len(p)]
        none = pa.nulls(len(keep)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(keep, pa.int32()), pa.array([pack_run(pieces[i]) for i in keep], pa.binary())], schema=_OUT)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc_id, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                spans = sorted({(r["start"], r["windows"], r["apart"]) for r in runs if r["start"] + r["windows"] + WINDOW - 1 <= len(raw)})
                k = 0
                while k < len(spans):
                    begin, first, end = spans[k][0], k, spans[k][0]
                    while k < len(spans) and spans[k][0] <= end and end - begin < SHARD:
                        end = max(end, spans[k][0] + spans[k][1] + WINDOW - 1)
                        k += 1
                    held.append((raw[begin:end], np.array(spans[first:k], dtype=np.int64) - [begin, 0, 0], doc_id, begin))
                    size += end - begin
                    if size >= SHARD:
                        yield from one(held)
                        held, size = [], 0
        if held:
            yield from one(held)

    by_doc = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "apart")).alias("runs"))
    return docs.join(by_doc, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, _OUT_DDL)


def _merged(shards: DataFrame, ranges: int) -> DataFrame:
    """Windows that go: those found in one shard, and those whose string another shard has earlier."""

    def settle(raws):
        gone = merge_all(map(unpack_run, raws))
        if gone:
            gone = np.concatenate(gone)
            yield _going(gone["doc"], gone["start"], gone["windows"])

    def run(batches):
        current, raws = None, []
        for batch in batches:
            numbers = batch.column(3).to_numpy()
            if (numbers < 0).any():
                yield batch.filter(pa.array(numbers < 0))
            for number, raw in zip(numbers[numbers >= 0], batch.column(4).filter(pa.array(numbers >= 0)), strict=True):
                if number != current:
                    yield from settle(raws)
                    current, raws = number, []
                raws.append(raw.as_py())
        yield from settle(raws)

    return shards.repartition(2 * ranges, "range").sortWithinPartitions("range").mapInArrow(run, _OUT_DDL)


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, windows): stretches of windows of docs(doc_id, text) whose string occurs earlier."""
    known = materialize(_candidates(_runs(docs)), "suffix-candidates", free_shuffles=True)
    sent = known.agg(F.count(F.lit(1)) * 22 + F.coalesce(F.sum(F.when(F.col("apart"), F.col("windows"))), F.lit(0)) * 14).first()[0]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sent // RANGE_BYTES))
    merged = _merged(_shards(docs, known, ranges), ranges).select("doc_id", "start", "windows")
    return materialize(merged, "suffix-merged", free_shuffles=True)


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    turn = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[turn].tolist(), np.append(reach[turn[1:] - 1], reach[-1]).tolist(), strict=True))


#: From here on lie the keys of rows without an id.
UNNAMED = 1 << 62


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, copy: the id, or for a null id a key from the text's digest; copy marks a text that another such row has too."""
    unnamed = docs.where("doc_id IS NULL")
    if unnamed.isEmpty():
        return docs.select("doc_id", "text", F.col("doc_id").alias("key"), F.lit(False).alias("copy"))
    rows = unnamed.select("doc_id", "text", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "suffix-unnamed")
    first = rows.groupBy("digest").agg(F.min("row").alias("row")).select("row", F.lit(False).alias("copy"))
    rows = rows.join(first, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(True)))
    digest = F.coalesce(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(0))
    rows = rows.select("doc_id", "text", F.when(F.col("copy"), F.col("row")).otherwise(F.lit(UNNAMED) + digest).alias("key"), "copy")
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.col("doc_id").alias("key"), F.lit(False).alias("copy")).unionByName(rows)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless with_text is false, spans and kept (the bytes left) of every row.

    Null texts are empty; texts below WINDOW bytes lose nothing. Matches never cross
    documents, strings are judged on the input, and overlapping matches count. Documents of
    any length are taken whole. Rows that repeat an id are one document that is there again:
    they lose nothing to each other at the same place, and each loses the places that any of
    them loses, as far as its own text reaches. Rows with a null id are
    documents of their own and keep the null; they come after all ids below 2**62, in the
    order of their texts' digests, and one of those with equal texts comes first. No rows give no rows;
    other columns are not read. What is left need not be valid UTF-8, as cuts fall on bytes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = _keyed(docs)
    own = docs.where("not copy").select(F.col("key").alias("doc_id"), "text")
    gone = removed_windows(own).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ddl += ", spans array<struct<start: long, end: long>>, kept binary" if with_text else ""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text, runs, copy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, spans = (text or "").encode(), []
                if copy:
                    spans = [(0, len(raw))] if len(raw) >= WINDOW else []
                elif runs and (runs := [r for r in runs if r["start"] + r["windows"] + WINDOW - 1 <= len(raw)]):
                    starts = np.array([r["start"] for r in runs])
                    spans = spans_of(starts, starts + np.array([r["windows"] for r in runs]) + WINDOW - 1)
                ends = [0, *(e for _, e in spans)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(raw)], strict=True)) if spans else raw
                for column, value in zip(rows, (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans] if with_text else None, kept if with_text else None), strict=True):
                    column.append(value)
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()), strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays(columns[: 7 if with_text else 5], names[: 7 if with_text else 5])

    return docs.join(gone, "key", "left").select("doc_id", "text", "runs", "copy").mapInArrow(run, ddl)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP1_SQL = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), blocks AS (
  SELECT doc_id, base, substr(h, 2 * base + 1, 1198) AS part, least(500, n - 99 - base) AS many FROM (SELECT doc_id, h, n, unnest(range(0, n - 99, 500)) AS base FROM bytes WHERE n >= 100)
), windows AS (
  SELECT doc_id, base + q AS p, doc_id * 4294967296 + base + q AS place, substr(part, 2 * q + 1, 200) AS w FROM (SELECT doc_id, base, part, unnest(range(many)) AS q FROM blocks)
), firsts AS (
  SELECT w, min(place) AS first FROM windows GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE place <> first
), marked AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM gone
), numbered AS (
  SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked
), spans AS (
  SELECT doc_id, min(p) AS start, max(p) + 100 AS stop FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS start, start AS stop FROM spans
  UNION ALL SELECT b.doc_id, coalesce(max(s.stop), 0), b.n FROM bytes b LEFT JOIN spans s USING (doc_id) GROUP BY b.doc_id, b.n
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS h FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT bytes.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
