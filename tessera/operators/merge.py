"""Mutations as functions from old state and changes to new state, for tables without in-place updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], first: list[Column]) -> DataFrame:
    """Old rows, and new rows of keys that old lacks; of new rows with one key, the first."""
    w = Window.partitionBy(*keys).orderBy(*first)
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.unionByName(fresh)


def upgrade(old: DataFrame, new: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """Per key the row of the lowest priority; the old row where they are equal."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(priority, "__new")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key. new has one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_once(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Verdict per new row: inserted, same (the key holds equal values) or conflict."""
    held = old.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__held"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    verdict = F.when(F.col("__held").isNull(), "inserted").when(same, "same").otherwise("conflict")
    return new.join(held, keys, "left").select(*keys, *values, verdict.alias("verdict"))


def guarded_update(rows: DataFrame, column: str, guard: Column, value: Column) -> DataFrame:
    """column set to value where guard holds, with `affected` telling where."""
    hit = F.coalesce(guard, F.lit(False))
    return rows.withColumns({"affected": hit, column: F.when(hit, value).otherwise(F.col(column))})


def lease_verdict(now: Column, expires: Column, holder: Column, token: Column, owner: str, own_token: str) -> Column:
    """Whether a lease may be taken: free, expired, or held by the same owner or token."""
    return F.when(holder.isNull(), "acquired").when((expires <= now) | (holder == owner) | (token == own_token), "taken over").otherwise("refused")


def delta(old: DataFrame, new: DataFrame, id_col: str, signature: Column) -> DataFrame:
    """Change of an index per id: (id_col, change) with insert, update or unchanged, by signature."""
    o = old.select(id_col, signature.alias("was"))
    n = new.select(id_col, signature.alias("now"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("now"), "unchanged").otherwise("update")
    return n.join(o, id_col, "left").select(id_col, change.alias("change"))


def without_touching(edges: DataFrame, gone: DataFrame, id_col: str, ends: list[str]) -> DataFrame:
    """Edges none of whose ends is among the ids of gone."""
    for end in ends:
        edges = edges.join(gone.select(F.col(id_col).alias(end)), end, "left_anti")
    return edges
