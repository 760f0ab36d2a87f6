"""From raw documents to token ids: rules, near duplicates, personal data, source weights, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and gives the documents it keeps or changes, with the columns
of ``documents``; the last gives ``doc_id, n_tokens, ids, decoded``. Stages work on all rows of their
predecessor, whose result is a Parquet table.

Defined cases: missing and empty texts have no words and go with the first stage; repeated rows and other copies
leave one row; ids may be missing or repeat. An empty table passes all stages empty. Columns beyond those of
``documents`` are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import encoding, mixing, near_duplicates, privacy, quality
from plumbline.llm.common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.quality_filter(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.one_of_each(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked."""
    return privacy.sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each as often as it takes them."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and their text."""
    return encoding.encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", duplicates_stage),
    ("personal data", privacy_stage),
    ("source weights", mixing_stage),
    ("encoding", encoding_stage),
]

# Rolling hashes, signatures and BPE merges are beyond SQL; a test holds run() row by row against a plain chain of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
