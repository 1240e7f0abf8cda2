"""Corpus pipeline: quality, exact and near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. Rows that repeat in id and text count as one
document. A document without an id stays in the near-duplicate stage unless a document
with an id is in its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import contamination
from millrace.llm.exact_dedup import dedup, keep_decided
from millrace.llm.packing import pack, tokenizer_file
from millrace.llm.quality import quality_scorer
from millrace.llm.simhash import near_groups
from millrace.session import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    score = quality_scorer(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", score("text")).where("__score >= 0.5").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_decided(docs, dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates."""
    groups = near_groups(docs)
    return keep_decided(docs, groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), prefix="__")
    return found.where(F.size("__spans") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_file(), derive={"ids_crc32": F.crc32("ids")}, keep_ids=False)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
