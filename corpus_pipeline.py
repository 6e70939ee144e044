"""A corpus pipeline of five stages; each reads what the one before it wrote.

Quality filter, near-duplicate removal, benchmark decontamination, mixing to
target weights, sharding. Every stage takes ``(spark, docs, sf_dir)`` and works
on all rows it gets; all but the last return the columns of ``documents``.

There is no SQL for the whole (compression, SimHash); tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontamination, mixing, quality, sharding, simhash
from ledgerline.llm.common import stored
from ledgerline.llm.queries import fold, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of good quality is under the threshold.

    Labels are learned from the same folds as in ``op4_quality``, so both decide alike.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality.filtered(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate component."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a phrase of a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the sources' targets, in training order."""
    return mixing.mixed_texts(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row its shard and its place in the shard."""
    return sharding.shard_documents(docs)[0]


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage),
          ("sharding", sharding_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
