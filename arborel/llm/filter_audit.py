"""How corpus filters overlap: what each removes, in every order in which they can run.

Every document becomes one mask, a bit for each filter that it fails, and documents are
counted by part and mask. A recursive common table expression then extends prefixes of
filters by the letters not used yet; each level joins the mask cells with the filters applied
so far and says of each cell what the step's filter does to it. Orders that begin alike share
their prefixes, so 325 prefixes stand for the 600 steps of 120 orders of five filters. The
recursion sees masks only, whose number does not depend on the corpus; counts are joined
after it. Texts are read once and whole, and only digests and masks are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.llm.exact_dedup import text_digest, tree_merge
from arborel.scratch import materialize

#: Most filters of an audit: the result has a row for each part, order and step.
MOST_FILTERS = 7


@dataclass(frozen=True)
class Thresholds:
    """Failures: A: under `words` words; B: distinct words under `distinct` % of words; C: capitals over
    `capitals` % of code points; D: a character of `signs`; E: a smaller id has the same text."""

    words: int = 50
    distinct: int = 65
    capitals: int = 5
    signs: str = r"[#$%&*|]"

    def of_text(self, text: Column) -> dict[str, Column]:
        """Failure of A to D; words are runs of bytes other than space and tab to carriage return."""
        words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
        count, different = F.size(words), F.size(F.array_distinct(words))
        return {
            "A": count < self.words,
            "B": 100 * different.cast("long") < self.distinct * count.cast("long"),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > self.capitals * F.length(text).cast("long"),
            "D": text.rlike(self.signs),
        }


def mask(failures: dict[str, Column]) -> Column:
    """Bit i is set where the i-th filter's condition of failure holds; null is no failure."""
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures.values())]
    return sum(bits[1:], bits[0]).cast("int")


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and counts for rows(part, mask, good, toxic), a bit of mask for each of letters.

    Counts are longs: kept after the step, removed by it, redundant (fails, but removed
    before), unique_fails (fails this filter only), good_lost and toxic_lost (removed by it and
    good, or toxic), shapley (removed by this filter, summed over all orders). Every order and
    step of every part has its row. Parts may be skewed: rows are counted by part and mask
    before anything else. No rows give no rows.
    """
    if not 1 <= len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} different letters, not {letters!r}")
    spark, k = rows.sparkSession, len(letters)
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    counts = materialize(counts, "audit-cells")
    filters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    walk = spark.sql(f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {filters}),
        cells(mask) AS (SELECT CAST(id AS INT) FROM range({1 << k})),
        walk(prefix, letter, step, applied, mask, kept, removed, redundant, unique_fails) AS (
          SELECT '', '', 0, 0, mask, true, false, false, false FROM cells
          UNION ALL
          SELECT concat(w.prefix, f.letter), f.letter, w.step + 1, w.applied | f.bit, w.mask,
                 w.mask & (w.applied | f.bit) = 0,
                 w.mask & w.applied = 0 AND w.mask & f.bit <> 0,
                 w.mask & w.applied <> 0 AND w.mask & f.bit <> 0,
                 w.mask = f.bit
          FROM walk w JOIN filters f ON w.applied & f.bit = 0
        )
        SELECT * FROM walk WHERE step > 0
    """)

    def total(value: str, flag: str, name: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(value)).otherwise(F.lit(0))).cast("long").alias(name)

    measures = [total("n", name, name) for name in ("kept", "removed", "redundant", "unique_fails")]
    measures += [total("good", "removed", "good_lost"), total("toxic", "removed", "toxic_lost")]
    steps = materialize(counts.join(walk, "mask").groupBy("part", "prefix", "letter", "step").agg(*measures), "audit-steps")
    # a prefix of s letters begins (k - s)! orders
    begun = F.element_at(F.array(*[F.lit(math.factorial(k - s)) for s in range(1, k + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * begun).cast("long").alias("shapley"))
    orders = steps.where(F.col("step") == k).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return orders.join(steps, ["part", "prefix", "step"]).join(shapley, ["part", "letter"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), *names, "shapley")


def masked_documents(
    docs: DataFrame, labels: DataFrame, thresholds: Thresholds = Thresholds(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """doc_id, part, mask, good, toxic: one row per row of docs.

    Null texts count as empty and null parts are the empty part. Equal texts are found by the
    tree merge of digests, however many copies there are; a row with a null id has no smaller
    id and is none, so it never fails E. Rows that repeat an id fail E together. An id is good or toxic
    where any of its labels says so; without labels it is neither. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        mask(thresholds.of_text(text)).alias("mask"),
        *text_digest(text),
    )
    rows = materialize(first, "audit-masks")
    merged = tree_merge(rows.where("doc_id is not null"), "doc_id", ["digest", "n_bytes", "check"], "min")
    copy = F.when(F.col("doc_id") > F.col("keep_id"), 16).otherwise(0)
    known = merged.select("doc_id", "part", (F.col("mask") + copy).cast("int").alias("mask"))
    flagged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flagged = flagged.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = known.join(flagged, "doc_id", "left")
    nameless = rows.where("doc_id is null").select("doc_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    sure = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return named.select("doc_id", "part", "mask", *sure).unionByName(nameless)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(masked_documents(docs, labels), "ABCDE")


OP12_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM worded GROUP BY t
), flags AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM worded JOIN firsts USING (t) LEFT JOIN flags USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, used) AS (
  SELECT '', 0 UNION ALL SELECT filter_order || letter, used | bit FROM orders JOIN filters ON used & bit = 0
), steps AS (
  SELECT filter_order, s.step::INT AS step, f.letter, f.bit,
         (SELECT coalesce(sum(g.bit), 0) FROM filters g WHERE contains(substr(filter_order, 1, (s.step - 1)::INT), g.letter)) AS applied
  FROM orders, range(1, 6) AS s(step), filters f WHERE length(filter_order) = 5 AND f.letter = substr(filter_order, s.step::INT, 1)
), told AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask::INT & (applied | bit)::INT = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask::INT & applied::INT = 0 AND mask::INT & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask::INT & applied::INT <> 0 AND mask::INT & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask::INT & applied::INT = 0 AND mask::INT & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask::INT & applied::INT = 0 AND mask::INT & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM told
"""
