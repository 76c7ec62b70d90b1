"""Readers of the Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; columns are pruned and filters pushed by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
