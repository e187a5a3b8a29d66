"""The corpus pipeline: quality, toxicity, near-duplicates, packing. Each stage takes all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskgraph.llm.bagminhash import keep_one
from riskgraph.llm.common import stored, table
from riskgraph.llm.packing import op4_vector_packing
from riskgraph.llm.quality import keep_good
from riskgraph.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer doesn't reject."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose decoded text scores below 0.7."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word weighted similarity 0.8 or more."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return op4_vector_packing(spark, sf_dir, docs)


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("MinHash near-dedup", near_duplicates), ("packing", packing)]

#: SQL can't express the trained stages. Tests: near-duplicates against brute force, quality and toxicity against labels,
#: packing by its round trip; of the whole pipeline, only that each stage takes what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
