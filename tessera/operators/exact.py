"""Exact-duplicate edges in star form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_star_edges(rows: DataFrame, id_col: str, keys: list[str], group_col: str) -> DataFrame:
    """k-1 edges for k rows that agree on the keys, all to the row with the smallest id.

    The representative comes from an aggregate with map-side combining, so a hot key sends one row per
    map task instead of its whole group; the join back lets adaptive execution split a hot key.
    Rows with a null key have no duplicates (a null key joins nothing).
    """
    rep = (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(F.col(id_col).alias("rep"), F.col(group_col).alias("rep_group"))).alias("r"), F.count("*").alias("k"))
        .where("k > 1")
        .select(*keys, "r.rep", "r.rep_group")
    )
    return (
        rows.join(rep, keys)
        .where(F.col(id_col) != F.col("rep"))
        .select(
            id_col,
            "rep",
            F.when(F.col(group_col).eqNullSafe(F.col("rep_group")), "intra_album").otherwise("cross_album").alias("scope"),
        )
    )


def first_of_key(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The row ids with the lowest id of each key, as (keys..., id_col): an aggregate, so a hot key is combined map-side."""
    return rows.groupBy(*keys).agg(F.min(id_col).alias(id_col))


def content_classes(rows: DataFrame, id_col: str, file_keys: list[str], pixel_key: str) -> tuple[DataFrame, DataFrame]:
    """(classes, membership): rows that agree on file and pixel keys are one class, named by its smallest id.

    classes: representative and keys, one row a class. membership: (id_col, representative), one row a row. Null keys count
    as values here; edges come from keys that are there.
    """
    keys = [*file_keys, pixel_key]
    classes = rows.groupBy(*keys).agg(F.min(id_col).alias("representative"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    named = classes.select(*[F.col(k).alias(f"__{k}") for k in keys], "representative")
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return classes, rows.join(named, condition).select(id_col, "representative")


def library_class_edges(images: DataFrame, library: DataFrame, id_col: str, file_keys: list[str], pixel_key: str) -> DataFrame:
    """(image, library, match_type) between representatives of content classes: hot content gives one edge, not n x m.

    file_exact where the file keys agree, else pixel_exact. With the memberships of both sides this tells every pair.
    """
    left = content_classes(images, id_col, file_keys, pixel_key)[0].withColumnRenamed("representative", "image")
    right = content_classes(library, id_col, file_keys, pixel_key)[0]
    held = right.select(F.col("representative").alias("library"), F.col(pixel_key).alias("__p"), *[F.col(k).alias(f"__{k}") for k in file_keys])
    same_file = F.lit(True)
    for k in file_keys:
        same_file = same_file & F.coalesce(F.col(k) == F.col(f"__{k}"), F.lit(False))
    by_pixel = left.join(held, F.col(pixel_key) == F.col("__p")).select("image", "library", same_file.alias("file"))
    # Files that agree without a pixel key of their own.
    on = [F.col(k) == F.col(f"__{k}") for k in file_keys]
    by_file = left.join(held, on).where(~F.coalesce(F.col(pixel_key) == F.col("__p"), F.lit(False))).select("image", "library", F.lit(True).alias("file"))
    return by_pixel.unionByName(by_file).select("image", "library", F.when(F.col("file"), "file_exact").otherwise("pixel_exact").alias("match_type"))


def library_edges(images: DataFrame, library: DataFrame, id_col: str, file_keys: list[str], pixel_key: str) -> DataFrame:
    """library_class_edges with the classes' members spelled out: one edge per image and matching library image.

    Its result is as large as the pairs are many; what only needs to know which contents match takes the class edges.
    """
    edges = library_class_edges(images, library, id_col, file_keys, pixel_key)
    image_of = content_classes(images, id_col, file_keys, pixel_key)[1].withColumnRenamed("representative", "image")
    library_of = content_classes(library, id_col, file_keys, pixel_key)[1].select(F.col(id_col).alias("library_id"), F.col("representative").alias("library"))
    return edges.join(image_of, "image").join(library_of, "library").select(id_col, "library_id", "match_type")
