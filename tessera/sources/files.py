"""Directory trees, file contents, manifests and logs as tables; arrays and JSON as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import extension
from tessera.sources.tree_source import FILE, FOLDER, LINK, SPECIAL, entries

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
MANIFEST = (
    "version int, transaction_id string, plan_hash string, album string, source_file_mode string,"
    " files array<struct<path:string,size:long,hash:string,width:int,height:int,format:string>>"
)
MARKER = (
    "schema_version string, transaction_id string, plan_hash string, manifest_hash string, publish_strategy_version string,"
    " album_relative_path string, image_count long, files array<struct<relative_path:string,size:long,hash:string>>"
)


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file under root: relative_path (with '/'), file_size, modified_at."""
    return entries(spark, root).where(F.col("kind") == FILE).select("relative_path", "file_size", "modified_at")


def albums(spark: SparkSession, root: str) -> DataFrame:
    """First-level folders by name, with the number and bytes of their files at any depth; empty ones too."""
    rows = entries(spark, root).where((F.col("kind") == FOLDER) | F.contains("relative_path", F.lit("/")))
    name = F.split_part("relative_path", F.lit("/"), F.lit(1))
    return rows.groupBy(name.alias("album")).agg(F.count_if(F.col("kind") == FILE).alias("files"), F.sum("file_size").alias("bytes")).orderBy("album")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Image files by extension, in either case, with their album, in path order."""
    rows = tree(spark, root).where(extension(F.col("relative_path")).isin(IMAGE_EXTENSIONS))
    return rows.withColumn("album", F.split_part("relative_path", F.lit("/"), F.lit(1))).orderBy("relative_path")


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Path, type, size and content digest of every entry but folders. Links and special files have no digest: they are not followed."""
    rows = entries(spark, root, "sha256").where(F.col("kind") != FOLDER)
    return rows.select("relative_path", F.col("kind").alias("file_type"), "file_size", "hash")


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """Entries that no snapshot may hold: links, whose targets may lie elsewhere, and special files."""
    return entries(spark, root).where(F.col("kind").isin(LINK, SPECIAL)).select("relative_path", "kind")


def dimensions(spark: SparkSession, root: str) -> DataFrame:
    """Width and height of image files from their headers, null where there is none, and the bytes read for that."""
    rows = entries(spark, root, "size").where((F.col("kind") == FILE) & extension(F.col("relative_path")).isin(IMAGE_EXTENSIONS))
    return rows.select("relative_path", "width", "height", "bytes_read")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests or commit markers: path, the digest of their raw bytes, and their fields (null where JSON is unsound)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("raw_hash"), F.from_json(F.col("content").cast("string"), MANIFEST).alias("manifest"))


def markers(spark: SparkSession, path: str) -> DataFrame:
    """Commit markers with all their header fields: path and marker, null where JSON is unsound."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.from_json(F.col("content").cast("string"), MARKER).alias("marker"))


def source_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row: how many albums, images and bytes of images a source folder has, and its albums' names in order."""
    per_album = images(spark, root).where(F.contains("relative_path", F.lit("/"))).groupBy("album").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    names = albums(spark, root).select("album").join(per_album, "album", "left")
    return names.agg(
        F.count("*").alias("albums"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("images"), F.coalesce(F.sum("b"), F.lit(0).cast("long")).alias("bytes"), F.array_join(F.sort_array(F.collect_list("album")), ",").alias("names")
    )


def log_tail(spark: SparkSession, root: str, most_files: int = 3, most_lines: int = 200, of_each: int | None = None) -> DataFrame:
    """The last lines of the newest log files of a folder, in order: file_rank (0 the newest), line_number, line. A report's limits.

    Files are read backwards from their ends, as far as of_each (default: all) of the lines need.
    """
    logs = entries(spark, root).where((F.col("kind") == FILE) & F.col("relative_path").endswith(".log"))
    newest = [r[0] for r in logs.orderBy(F.desc("modified_at"), "relative_path").limit(most_files).select("relative_path").collect()]
    if not newest:
        return spark.createDataFrame([], "file_rank long, line_number int, line string")
    rank = F.array_position(F.array(*[F.lit(n) for n in newest]), F.col("relative_path")) - 1
    rows = entries(spark, root, "tail", lines=min(of_each or most_lines, most_lines), only=newest).where(rank >= 0)
    return rows.select(rank.alias("file_rank"), F.posexplode("lines").alias("line_number", "line")).orderBy("file_rank", "line_number").limit(most_lines)


def arrays_as_rows(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows; shorter ones give nulls."""
    return df.select(F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))


def json_as_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of objects as typed rows."""
    return df.select(F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))
