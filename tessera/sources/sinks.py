"""Plan rows, file operations, manifests and diagnostics on their way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import PATH_KEYS, SECRET_KEYS, redacted
from tessera.operators.verify import canonical_hash


def plan_rows(images: DataFrame, kept: Column, album: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(albums with at least one kept image and its count, one row per kept image)."""
    rows = images.where(kept)
    return rows.groupBy(album).agg(F.count("*").alias("expected_image_count")), rows.withColumn("target_relative_path", F.concat_ws("/", album, path))


def prewritten(plan: DataFrame, root: str, album: str, path: str, size: str, digest: str, move: bool) -> DataFrame:
    """File operations of a plan, one per image, and one cleanup row more each where sources are moved."""
    kinds = ["copy", "cleanup"] if move else ["copy"]
    staged = F.concat_ws("/", F.lit(root), F.lit(".staging"), album, path)
    return plan.select(
        F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), F.concat_ws("/", album, path).alias("source_path"), staged.alias("staging_path"),
        F.concat_ws("/", F.lit(root), album, path).alias("target_path"), F.col(size).alias("expected_size"), F.col(digest).alias("expected_hash"), F.lit("planned").alias("state"),
    )


def published(catalog: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog with rows that it lacks by key: publishing twice adds nothing."""
    return catalog.unionByName(rows.join(catalog.select(*keys), keys, "left_anti").dropDuplicates(keys))


def manifest_json(plan: DataFrame, album: str, path: str, size: str, digest: str, header: dict[str, Column]) -> DataFrame:
    """One JSON text per album: header fields, then its files in path order. A manifest is one file, so an album's rows meet in one value."""
    files = F.sort_array(F.collect_list(F.struct(F.col(path).alias("path"), F.col(size).alias("size"), F.col(digest).alias("hash"))))
    grouped = plan.groupBy(album).agg(files.alias("files"))
    return grouped.select(album, F.to_json(F.struct(*[c.alias(n) for n, c in header.items()], F.col(album).alias("album"), "files")).alias("json"))


#: Header fields of a commit marker, before its files. Fixed values of the format.
MARKER_HEADER = ["schema_version", "transaction_id", "plan_hash", "manifest_hash", "publish_strategy_version", "album_relative_path", "image_count"]


def commit_markers(plan: DataFrame, header: DataFrame, album: str, path: str, size: str, digest: str) -> DataFrame:
    """(album, marker): per album the struct that its commit marker has to hold, header fields and sorted files.

    header: one row per album with the header fields but for album_relative_path and image_count, which the plan gives. A
    marker is one file by definition, so an album's files meet in one value.
    """
    files = F.sort_array(F.collect_list(F.struct(F.col(path).alias("relative_path"), F.col(size).alias("size"), F.col(digest).alias("hash"))))
    rows = plan.groupBy(album).agg(files.alias("files"), F.count("*").alias("image_count")).join(header, album)
    fields = [F.col(album).alias(f) if f == "album_relative_path" else F.col(f) for f in MARKER_HEADER]
    return rows.select(album, F.struct(*fields, "files").alias("marker"))


def append_new(rows: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the Parquet table in folder lacks, and returns the table: a repeated append adds nothing."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        held = spark.read.schema(rows.schema).parquet(folder)
        rows = rows.join(held.select(*keys), keys, "left_anti").select(*rows.columns)
    rows.dropDuplicates(keys).write.mode("append").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def append_snapshot(files: DataFrame, folder: str, album: str, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(headers, files): a snapshot's files, then its header with the canonical hash, appended once each.

    The header comes last: a snapshot without one was interrupted, and appending it again completes it.
    """
    stored = append_new(files.select(album, path, *fields), f"{folder}/files", [album, path])
    hashed = canonical_hash(files, [album], [F.col(path), *[F.col(f) for f in fields]])
    return append_new(hashed.withColumnRenamed("rows", "files"), f"{folder}/headers", [album]), stored


def sanitized(key: Column, value: Column) -> Column:
    """A diagnostic value by its key: secrets and paths are hidden, other texts are redacted."""
    name = F.lower(key)
    return (
        F.when(name.rlike(SECRET_KEYS), "<redacted>")
        .when(name.rlike(PATH_KEYS), "<redacted-path>")
        .otherwise(redacted(value))
    )


def diagnostics(facts: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object of sanitized facts, keys in order. facts is a short list of settings and counts."""
    clean = facts.select(F.col(key).alias("k"), sanitized(F.col(key), F.col(value)).alias("v"))
    listed = F.sort_array(F.collect_list(F.struct("k", "v")))
    return clean.agg(F.to_json(F.map_from_entries(listed)).alias("json"))
