"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing over the documents table.

Every stage but the last returns the columns of its input, whatever they are called. Null texts count as empty; an empty
table passes through all stages as one. What each stage does with nulls and repeated rows stands at its function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, near_dup, packing, quality
from tessera.llm.common import erase, scratch, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of their language and source accept.

    Null and empty texts have no words and go; repeated rows are judged alike; null languages and sources are groups.
    """
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the largest id.

    Of repeated rows of one id and text one stays; null ids lose to any other.
    """
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links join: five-word shingles, similarity 0.8 or more.

    The one with the smallest id stays, with all rows of that id; rows without words or without an id stay.
    """
    return near_dup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated whole, or left out, so that the sources come near their target weights.

    Repeated rows of one id and length are taken or left together; texts without words are never needed and may go; a
    null source is a source.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in full sequences; repeated rows are documents of their own, null ids stay null."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Packing needs a tokenizer, and mixing random numbers in a fixed order: not for SQL. The tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again by the next.

    Once a stage is stored, its input (but for the given table) and all tables that it made on the way are erased, so the folder
    holds two stages at a time.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        erase(spark, {"before": before}, "before")
        docs, before = spark.read.parquet(path), [path]
    return docs
