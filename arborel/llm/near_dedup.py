"""Near duplicates by MinHash bands, odd sketches and confirmation on full shingle sets.

1. One pass over the texts gives each document its number of distinct word shingles, a digest
   of the set, BANDS band keys of ROWS MinHash values each, and an odd sketch: the MinHash
   samples folded into a bitmap of parities. The population count of two sketches' XOR
   estimates their similarity, most precisely where it is high.
2. Documents with equal sets become one node (a tree merge; no group of copies is gathered).
3. Nodes with equal band keys meet. Each node of a bucket is paired with the bucket's leader
   only: the node that meets most others over all its bands, which is the text that a group
   of near copies was made from, if any. Sizes and sketches rule out most false pairs, the
   rest are confirmed on full sets.
4. Buckets whose nodes are not all connected by then are compared in full: nodes that share
   such buckets, directly or not, form a cluster, dealt into blocks of bounded size. Each
   pair of blocks compares sketches first and full sets where those allow, and only links
   leave it, so nothing as large as the pairs is ever written.
5. Connected components of the confirmed links.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8**5)**32 < 4e-6.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.llm.exact_dedup import tree_merge
from arborel.operators.components import connected_components
from arborel.scratch import materialize

BANDS, ROWS, SKETCH_BITS = 32, 5, 1024
#: Standard deviations of the similarity estimate by which a pair may fall short and still be confirmed.
SLACK = 5.5
#: Nodes, and shingles, of one block of a cluster.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
#: A smaller cluster still makes up to so many blocks of so many nodes, for as many tasks.
SPREAD, LEAST_BLOCK = 8, 256
#: Shingles that are looked up at a time, and texts that are taken out of a batch at a time.
COUNTED, TEXTS = 1 << 16, 512
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    n = BANDS * ROWS
    draws = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP)
    return draws[:n, None] | np.uint64(1), draws[n:, None]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than width make one shingle."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and parts at space, tab .. carriage return only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        acc = acc * _MIX1 + h[j : len(h) - n + 1 + j]
    return np.unique(mix(acc + np.array([n], dtype=np.uint64) * _STEP))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch) of a set that is not empty, as int64."""
    a, b = _permutations()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 1024):
        low = np.minimum(low, (found[None, start : start + 1024] * a + b).min(axis=1))
    samples = mix(low + np.arange(1, len(low) + 1, dtype=np.uint64) * _STEP)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = keys * _MIX2 + samples.reshape(BANDS, ROWS)[:, j]
    odd = np.bincount((samples >> np.uint64(32)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return mix(keys).view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """Bits that two sketches may differ in: SLACK standard deviations beyond what the similarity leads to expect."""
    k = BANDS * ROWS
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / k)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-4 * k * (1 - least) / SKETCH_BITS)))


def pieces(batches):
    """Batches of TEXTS rows at most, so that no more texts than those are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, set_a, set_b, bands, sketch of docs(doc_id, text); sets without shingles have no bands."""

    def run(batches):
        for batch in pieces(batches):
            n, first, second, bands, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                n.append(len(found))
                # two sums of differently mixed hashes: a digest of the set as a whole
                first.append(int(np.add.reduce(mix(found + _STEP)).view(np.int64)) if len(found) else 0)
                second.append(int(np.add.reduce(mix(found ^ _MIX2)).view(np.int64)) if len(found) else 0)
                keys, sketch = signature(found) if len(found) else ([], [])
                bands.append(keys)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n", "set_a", "set_b", "bands", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, bands array<long>, sketch array<long>")


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, found): the full shingle sets of the documents in ids."""

    def run(batches):
        for batch in pieces(batches):
            found = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "found"])

    once = docs.join(ids, "doc_id", "left_semi").withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "digest"])
    full = once.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<long>")
    return materialize(full, "near-sets", free_shuffles=True)


def _confirm(pairs: DataFrame, nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of node ids whose full sets are similar enough."""
    of = lambda side: nodes.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    close = pairs.join(of("a"), "a").where("n_a > 0").join(of("b"), "b")
    close = close.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (_differing(F.col("s_a"), F.col("s_b")) <= most_differing_bits(percent / 100)))
    close = materialize(close.select("a", "b").distinct(), "near-pairs")
    both = close.join(full.select(F.col("doc_id").alias("a"), F.col("found").alias("f_a")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("found").alias("f_b")), "b")
    shared = F.size(F.array_intersect("f_a", "f_b"))
    both = both.select("a", "b", F.size("f_a").alias("n_a"), F.size("f_b").alias("n_b"), shared.alias("shared"))
    both = both.where(F.col("shared").cast("long") * 100 >= (F.col("n_a").cast("long") + F.col("n_b") - F.col("shared")) * percent)
    return materialize(both.select("a", "b"), "near-links", free_shuffles=True)


def _unfinished(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, id, leader) of buckets that hold more than one component of links, with the component and bucket size."""
    parts = connected_components(links, "a", "b")
    placed = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    return placed.join(open_keys.where("low < high and size > 2").drop("low", "high"), "key")


def shared_counts(own: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many values of the sorted array own stand in each of the sets flat[begin:begin + size]; about COUNTED values at a time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // COUNTED)) + 1
    return np.concatenate([_shared_counts(own, flat, b, n) for b, n in zip(np.split(begin, cuts), np.split(size, cuts), strict=True)])


def _shared_counts(own: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    values = flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    return np.bincount(np.repeat(np.arange(len(size)), size), own[at] == values, len(size)).astype(np.int64)


def _within(left: DataFrame, nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of nodes that meet in unfinished buckets."""
    clusters = connected_components(left.select("leader", "id"), "leader", "id").withColumnRenamed("component", "cluster")
    who = materialize(left.select("id", "component").distinct().join(clusters, "id"), "near-clusters")
    rows = who.join(nodes.select(F.col("doc_id").alias("id"), "sketch"), "id").join(full.withColumnRenamed("doc_id", "id").withColumn("n", F.size("found").cast("long")), "id")
    total = who.join(nodes.select(F.col("doc_id").alias("id"), "n"), "id").groupBy("cluster")
    total = total.agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES, F.least(F.lit(float(SPREAD)), F.count(F.lit(1)) / LEAST_BLOCK))).cast("int").alias("parts"))
    rows = rows.join(total, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sketch", "found")
    # rows lie by cluster, which Spark would take as good enough for the grouping below: one task for all blocks of a cluster
    rows = rows.repartition(F.col("cluster"), F.col("i"), F.col("j"))
    schema, most = pa.schema([("a", pa.int64()), ("b", pa.int64())]), most_differing_bits(percent / 100)

    def compare(table: pa.Table) -> pa.Table:
        ids, own, comp, n = (table.column(c).to_numpy() for c in ("id", "own", "component", "n"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(np.uint64)
        flat = table.column("found").combine_chunks().flatten().to_numpy().view(np.uint64)
        begin = np.cumsum(n) - n
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = []
        for r in rows:
            c = columns[(comp[columns] != comp[r]) & ((ids[columns] > ids[r]) | (i != j))]
            c = c[np.minimum(n[c], n[r]) * 100 >= np.maximum(n[c], n[r]) * percent]
            c = c[np.bitwise_count(sketch[c] ^ sketch[r]).sum(axis=1) <= most]
            if len(c):
                shared = shared_counts(flat[begin[r] : begin[r] + n[r]], flat, begin[c], n[c])
                links += [(min(ids[r], x), max(ids[r], x)) for x in ids[c[shared * 100 >= (n[c] + n[r] - shared) * percent]]]
        low, high = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(low, pa.int64()), pa.array(high, pa.int64())], schema=schema)

    return materialize(rows.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"), "near-links")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when 100 * shared >= percent * united distinct shingles of `width`
    words (fewer words: the whole sequence is one); component_id is the smallest id reachable.
    Null, empty and blank texts have no shingles and are linked with nothing. Texts of any
    length are taken whole. Rows that repeat an id give a row each and are one document: with
    other words, it is linked with whatever any of its texts is linked with. A row with a null
    id cannot be named in a link: it has no component_id and is kept. No rows give no rows;
    other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, width), "near-signatures")
    keyed = tree_merge(signed.where("n > 0 and doc_id is not null").select("doc_id", "n", "set_a", "set_b"), "doc_id", ["n", "set_a", "set_b"], "min")
    keyed = materialize(keyed.select("doc_id", "n", F.col("keep_id").alias("node")), "near-copies")
    nodes = signed.join(keyed.where("doc_id = node").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
    nodes = materialize(nodes.select("doc_id", "n", "bands", "sketch"), "near-nodes")

    exploded = nodes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    met = materialize(exploded.join(shared, "key"), "near-met", free_shuffles=True)
    meets = met.groupBy("id").agg(F.sum("many").alias("meets"))
    ranked = met.join(meets, "id").select("key", "id", F.struct("meets", (-F.col("id")).alias("id")).alias("by"))
    # written, so that the join below meets two plain exchanges, of which Spark can split a hot key's
    leaders = materialize(ranked.groupBy("key").agg(F.max("by").alias("by")).select("key", (-F.col("by.id")).alias("leader")), "near-leaders")
    members = materialize(met.select("key", "id").join(leaders, "key"), "near-members")

    # the texts move once, for all nodes that may have to be compared
    full = _sets(docs, meets.select(F.col("id").alias("doc_id")), width)
    star = members.where("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    links = _confirm(star, nodes, full, percent)
    left = materialize(_unfinished(members, links), "near-unfinished")
    if left.limit(1).count():
        links = links.unionByName(_within(left, nodes, full, percent))
    parts = connected_components(links, "a", "b")
    linked = keyed.join(parts.select(F.col("id").alias("node"), "component"), "node", "left")
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP6_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS common FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 80 * (n_a + n_b - common)
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.seen
), least_seen AS (
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_seen USING (doc_id)
"""
