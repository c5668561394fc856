"""A training corpus from raw documents: toxicity, exact and near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents. Rows
with a null id pass the two dedup stages, which decide by id; rows that repeat an id are kept or
dropped together there. Null and empty texts go through all stages, and an empty table gives no
pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborel.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from arborel.scratch import materialize

#: Only text scores, packing by vector bins and the like decide here; SQL cannot express them.
ORACLE_SQL = None


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs but those that decided(doc_id, kept) drops."""
    return docs.join(decided.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows outside the held-out share, does not reject."""
    return toxicity.keep_clean(docs, toxicity.fit_on_tables(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts; null and empty texts are one group."""
    return _without(docs, exact_dedup.exact_duplicates(docs, keep="max"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked by 80 % of their five-word shingles."""
    return _without(docs, near_dedup.near_duplicates(docs, width=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come near their target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", free_shuffles=True)
    return STAGES[-1][1](spark, docs, sf_dir)
