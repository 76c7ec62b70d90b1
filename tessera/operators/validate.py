"""Data-quality rules: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import conflict_key


def not_exactly_one(*columns: Column) -> Column:
    filled = F.lit(0)
    for c in columns:
        filled = filled + c.isNotNull().cast("int")
    return filled != 1


def repeated(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Distinct keys of rows without a parent."""
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    return keys.join(parents.select(F.col(parent_key).alias("key")), "key", "left_anti").select(F.lit(rule).alias("rule"), F.col("key").cast("long").alias("key"))


def path_conflicts(rows: DataFrame, group: list[str], path: Column) -> DataFrame:
    """Paths of a group that agree but for case and Unicode form, or altogether."""
    keyed = rows.select(*group, conflict_key(path).alias("key"), path.alias("path"))
    return keyed.groupBy(*group, "key").agg(F.count_distinct("path").alias("spellings"), F.count("*").alias("n")).where("n > 1")


def known_prefix(applied: DataFrame, version: str, known: int) -> DataFrame:
    """Each applied version and whether the history up to it is 1, 2, 3, ... without a gap, within the known ones.

    A version v is in order exactly if v versions up to v are there; the known versions are a short fixed list.
    """
    upto = applied.select(F.col(version).alias("v")).where(F.col("v").between(1, known))
    steps = applied.join(F.broadcast(upto), F.col("v") <= F.col(version), "left").groupBy(version).agg(F.count_distinct("v").alias("n"))  # at most `known` rows
    return steps.select(version, (F.col("n") == F.col(version)).alias("known"))


def restage(plan: DataFrame, staged: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per planned file whether its staged copy can stay: only with every field equal."""
    held = staged.select(key, F.lit(True).alias("__s"), *[F.col(f).alias(f"s_{f}") for f in fields])
    same = F.col("__s").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"s_{f}"))
    return plan.join(held, key, "left").select(key, F.when(F.coalesce(same, F.lit(False)), "reuse").otherwise("copy").alias("step"))
