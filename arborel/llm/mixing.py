"""Mixing sources to target weights.

Words are counted per document and aggregated per source. Targets solve a water level: each
source gets weight times a common level, capped at CAP times its size; what a cap takes away
is shared again by weight until no source is above its cap. A source's repetition rate is
target over size; each document is taken floor(rate) times, and once more when a hash of its
id falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.scratch import materialize

#: Weights by the source's place in code-point order, repeating; the share of all words; the cap.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: The seed of the Bernoulli copies.
SEED = "mix-1"
#: Runs of bytes other than space and the control characters tab to carriage return.
WORDS = r"[^\x20\x09-\x0D]+"


def _ranked(sources: DataFrame) -> DataFrame:
    """Add place: 0, 1, ... by source in code-point order, null last; ranges are ranked apart and offset."""
    from pyspark.sql import Window

    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = materialize(spread, "mix-ranks")
    inner = spread.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    return inner.join(offsets, "_part").withColumn("place", F.col("_row") + F.col("_offset") - 1).drop("_part", "_row", "_offset")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target for the sources of sized(source, size).

    Only totals come to the driver: each round recomputes the common level over the sources
    not yet capped; capped sources stay capped, as the level only rises. When every source
    is at its cap, targets add up to less than the share.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = materialize(_ranked(totals).withColumn("weight", pick), "mix-sources")
    most = F.col("source_size") * F.lit(cap)
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        row = placed.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(above, most).otherwise(F.lit(0))).alias("fixed"),
            F.sum(F.when(~above, F.col("weight")).otherwise(F.lit(0))).alias("open"),
            F.count(F.when(above, 1)).alias("capped"),
        ).first()
        if row["words"] is None or row["capped"] == capped or not row["open"]:
            break
        level, capped = (share * row["words"] - row["fixed"]) / row["open"], row["capped"]
    target = F.least(F.col("weight") * F.lit(level), most.cast("double"))
    if row["words"] is not None and not row["open"]:
        target = most.cast("double")
    return placed.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def _rated(rows: DataFrame, source_col: str, targets: DataFrame) -> DataFrame:
    """rows with the source_size and target of their source, which may be null.

    Sources are few beside rows: Spark broadcasts their table while it is small, and splits
    the partitions of hot sources where it is not.
    """
    named = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    return rows.join(named, rows[source_col].eqNullSafe(named["_source"])).drop("_source")


def _copies(doc_id: Column, seed: str) -> Column:
    """floor(rate), and one more when the hash of seed and id falls below the rate's fraction, of rows of _rated."""
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.greatest(F.col("_source_size"), F.lit(1))).otherwise(0.0)
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), doc_id.cast("long").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs.

    Null and empty texts have size 0 and take 0 words; null sources are one source, ranked
    last. Rows that repeat an id share its coin, each with its own source's rate. A row with
    a null id has no coin and is taken floor(rate) times, as in the SQL. Sources without
    words have target 0 and no copies. No rows give no rows. The coin is a hash of the seed
    and the id, so reruns and retried tasks agree.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    rated = _rated(sized, "source", source_targets(sized, weights, share, cap)).withColumn("copies", _copies(F.col("doc_id"), seed))
    rated = rated.withColumnsRenamed({"_source_size": "source_size", "_target": "target"})
    return rated.withColumn("taken", F.col("copies").cast("long") * F.col("size"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """docs with each row repeated as mix() says of that row, columns unchanged; names that clash with mix()'s are kept.

    Every row computes its own copies from its source's target, so rows that repeat an id
    are told apart by nothing else and texts are not shuffled.
    """
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    rated = _rated(docs, source_col, source_targets(sized, weights, share, cap))
    again = F.explode(F.array_repeat(F.lit(1), _copies(F.col(id_col), seed))).alias("_copy")
    return rated.select(*[docs[c] for c in docs.columns], again).drop("_copy")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), placed AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed
), steps AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS step,
         sum(2 * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fixed,
         sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS words
  FROM weighted
), level AS (
  SELECT arg_min((1.5::DOUBLE * words - coalesce(fixed, 0)) / open, step) AS level
  FROM steps WHERE weight * ((1.5::DOUBLE * words - coalesce(fixed, 0)) / open) <= 2 * source_size
), targets AS (
  SELECT source, source_size, coalesce(least(weight * level.level, (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) AS target FROM weighted, level
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS coin
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
