"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every row gets a run number from a hash of its id, so a text with any number of copies is
spread over all runs. A run is sorted by digest: Spark sorts a partition's rows, merges equal
neighbours into one row (digest, kept id, count), sends the sorted run on, and sorts and
merges again where runs meet (sort aggregates, as the kept id travels in a struct). Runs meet
in binomial rounds, FAN_BITS of them in one exchange: run r goes to run r >> FAN_BITS, so
2**FAN_BITS runs are merged at once, and a merge sees at most that many rows of one digest.
Each level keeps the smallest (or largest) id whose text has the digest, length and check
hash. Going down, each level takes its answer from the level above by the same keys, and at
last every document from its own run. No step gathers all copies of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.scratch import materialize

FAN_BITS = 4
#: Runs at the lowest level, as a power of two, per shuffle partition of the session.
RUNS_PER_PARTITION = 1


def run_bits(df: DataFrame) -> int:
    """log2 of the number of runs: at least as many runs as the session has shuffle partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(FAN_BITS, math.ceil(math.log2(max(2, partitions * RUNS_PER_PARTITION))))


def tree_merge(rows: DataFrame, id_col: str, keys: list[str], keep: str = "min") -> DataFrame:
    """Add keep_id and group_size to rows: the smallest (or largest) id of equal keys, and their number.

    rows should be cheap to read twice (a written table). Null keys are equal to each other.
    Rows that repeat an id count each. An empty table gives an empty result.
    """
    best = F.min if keep == "min" else F.max

    def merged(run: DataFrame, kept: str, count: Column) -> DataFrame:
        """One row of equal keys of a run; a struct has no place in a hash aggregate, so that runs are sorted and merged."""
        out = run.groupBy(*keys, "_run").agg(best(F.struct(F.col(kept).alias("id"))).alias("_kept"), count.alias("group_size"))
        return out.select(*keys, "_run", F.col("_kept.id").alias("keep_id"), "group_size")

    bits = run_bits(rows)
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << bits)).cast("int")
    based = rows.withColumn("_run", spread)
    levels = [merged(based, id_col, F.count(F.lit(1)))]
    steps = [min(FAN_BITS, bits - done) for done in range(0, bits, FAN_BITS)]
    for step in steps:
        levels.append(merged(levels[-1].withColumn("_run", F.shiftright("_run", step)), "keep_id", F.sum("group_size")))
    answer = levels[-1]
    for level, step in zip(reversed(levels[:-1]), reversed(steps), strict=True):
        answer = _take(level.drop("keep_id", "group_size"), answer, keys, step)
    return _take(based, answer, keys, 0).drop("_run")


def _take(rows: DataFrame, above: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Join each row with the merged entry of its digest in the run above."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    above = above.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_run").alias("_above"), "keep_id", "group_size")
    same = F.shiftright(rows["_run"], step) == above["_above"]
    for k, n in names.items():
        same = same & rows[k].eqNullSafe(above[n])
    return rows.join(above, same).drop("_above", *names.values())


def text_digest(text: Column) -> list[Column]:
    """A text's key: SHA-256, byte length and an unrelated 64-bit hash, so that a match is verified by all three."""
    text = F.coalesce(text, F.lit(""))
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    ]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, so null and empty texts form
    one group. keep says whether the largest or smallest id of a group stays. Rows that repeat
    an id are rows of their own: each counts in group_size, and they are kept or dropped
    together. Rows with a null id count too; they are kept only where no copy has an id, and
    then keep_id is null. Other columns of docs are not read, whatever their names. No rows
    give no rows.
    """
    digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_digest(F.col(text_col)))
    merged = tree_merge(materialize(digests, "digests"), "doc_id", ["digest", "n_bytes", "check"], keep)
    return merged.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
