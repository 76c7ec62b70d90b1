"""Import plans: exclusions, plan rows, roll-ups, edits, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_images(images: DataFrame, excluded: DataFrame, id_col: str, usable: Column) -> DataFrame:
    """Usable images whose id is not excluded."""
    return images.where(usable).join(excluded.select(id_col).distinct(), id_col, "left_anti")


def plan_rollup(images: DataFrame, kept: DataFrame, id_col: str, album: str, size: str) -> DataFrame:
    """Per album: images, included, skipped, included bytes, and whether the album is planned at all."""
    own = kept.groupBy(album).agg(F.count("*").alias("included"), F.sum(size).alias("bytes"))
    all_ = images.groupBy(album).agg(F.count("*").alias("images"))
    included = F.coalesce("included", F.lit(0).cast("long"))
    return all_.join(own, album, "left").select(
        album, "images", included.alias("included"), (F.col("images") - included).alias("skipped"),
        F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), (included > 0).alias("planned"),
    )


def edge_exclusions(edges: DataFrame) -> DataFrame:
    """Ids excluded by reviewed edges (source, candidate, decision, intra, is_library): one row per excluded id."""
    keep_source = (F.col("decision") == "keep_source") & F.col("intra") & ~F.col("is_library")
    keep_candidate = (F.col("decision") == "keep_candidate") & (F.col("intra") | F.col("is_library"))
    out = F.when(keep_source, F.col("candidate")).when(keep_candidate, F.col("source"))
    return edges.select(out.alias("id")).where("id IS NOT NULL").distinct()


def edited(plan: DataFrame, images: DataFrame, id_col: str, album: str, drop: DataFrame, add: DataFrame) -> DataFrame:
    """The plan without drop's ids and with those of add that its albums' images hold; empty albums go by themselves."""
    less = plan.join(drop.select(id_col), id_col, "left_anti")
    more = images.join(add.select(id_col), id_col, "left_semi").join(less.select(id_col), id_col, "left_anti")
    return less.unionByName(more.select(*less.columns))


def next_version(plans: DataFrame, run: str, version: str) -> DataFrame:
    return plans.groupBy(run).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))
