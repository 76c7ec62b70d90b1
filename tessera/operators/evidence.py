"""Verdicts over several sources of evidence: plan, manifest, disk, operations and catalog of one album."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.verify import reconcile


def all_evidence(plan: DataFrame, sources: dict[str, DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Disagreements of each source with the plan: (evidence, key, error). No rows: the evidence is complete."""
    out = None
    for name, rows in sources.items():
        found = reconcile(plan, rows, key, fields).select(F.lit(name).alias("evidence"), key, "error")
        out = found if out is None else out.unionByName(found)
    return out


def verdicts(errors: DataFrame, albums: DataFrame, album_of: DataFrame, key: str, album: str) -> DataFrame:
    """Per album: committed (no errors), resume (files are missing only) or conflict."""
    flags = errors.select(key, "error").join(album_of.select(key, album), key).groupBy(album).agg(F.bool_or(F.col("error") != "missing").alias("hard"))
    verdict = F.when(F.col("hard").isNull(), "committed").when(F.col("hard"), "conflict").otherwise("resume")
    return albums.select(album).distinct().join(flags, album, "left").select(album, verdict.alias("verdict"))


def contained(path, root):
    """Whether a path lies lexically under a root: absolute, below it, and without '..'."""
    inside = F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))
    return inside & ~F.array_contains(F.split(path, "[/\\\\]"), "..")


def derived_paths(root, transaction, album):
    """(staging, target) paths that a transaction has to have stored."""
    return F.concat_ws("/", root, F.lit(".staging"), transaction, album), F.concat_ws("/", root, album)


def marker_faults(stored: DataFrame, expected: DataFrame, album: str, fields: list[str], file_key: str, file_fields: list[str]) -> DataFrame:
    """(album, fault): where a stored commit marker is not the one rebuilt from the plan.

    Both sides are (album, marker). A fault is missing, extra, a header field's name with _mismatch, or files, where the
    file sets differ in any entry, told by keyed comparison and not by whole arrays.
    """
    header = lambda df: df.select(album, *[F.col("marker")[f].alias(f) for f in fields])
    listed = lambda df: df.select(album, F.explode("marker.files").alias("f")).select(album, F.struct(album, F.col("f")[file_key]).alias("key"), *[F.col("f")[f].alias(f) for f in file_fields])
    faults = reconcile(header(expected), header(stored), album, fields).withColumnRenamed("error", "fault")
    both = expected.select(album).join(stored.where("marker IS NOT NULL").select(album), album)
    files = reconcile(listed(expected), listed(stored), "key", file_fields).select(F.col("key")[album].alias(album)).distinct().join(both, album, "left_semi")
    return faults.unionByName(files.withColumn("fault", F.lit("files")))


def copy_verdict(expected_size, expected_hash, size, digest):
    """What a finished copy is: verified, absent, or differing in size or content."""
    return (
        F.when(digest.isNull() & size.isNull(), "absent").when(~size.eqNullSafe(expected_size), "size_mismatch").when(~digest.eqNullSafe(expected_hash), "hash_mismatch").otherwise("verified")
    )
