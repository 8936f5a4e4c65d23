"""The corpus pipeline: five stages over documents, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import decontamination, jaccard, mixing, personal, toxicity
from furrow.llm.common import deleted, shared_dir, table
from furrow.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    ship(spark)
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    ship(spark)
    return jaccard.kept_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go; whole windows of items are cut out of the others."""
    ship(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), longest=decontamination.WINDOW - 1)


def personal_stage(spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows."""
    ship(spark)
    return personal.redacted_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, _sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them, numbered in mix_copy."""
    ship(spark)
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", personal_stage),
    ("mixing", mixing_stage),
]

#: The stages train models and sample, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    What each keeps is written to the shared folder, and deleted there once the next has been
    written; that of the last stays, as the result is read from it.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            deleted(spark, f"{folder}/{i - 1}")
    return docs
