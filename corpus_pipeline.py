"""From raw documents to packed training sequences.

Stages run in order, each on all rows that its predecessor kept; every result
is written as Parquet in the shared folder and read back as the next input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pedalytics.llm.common import materialize, table
from pedalytics.llm.exact_dedup import drop_exact
from pedalytics.llm.mixing import mixed_documents
from pedalytics.llm.near_dedup import drop_near
from pedalytics.llm.packing import pack
from pedalytics.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by weight: documents with the words that the mix takes of them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of at most 1024 tokens, one row per piece with its token ids."""
    return pack(docs, with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
