"""Reconciliation of keyed sets, canonical hashes and table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(stored: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per disagreement: (key, error) with missing, extra or <field>_mismatch. A key can have several."""
    s = stored.select(key, F.lit(True).alias("__s"), *[F.col(f).alias(f"s_{f}") for f in fields])
    a = actual.select(key, F.lit(True).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    there = F.col("__s").isNotNull() & F.col("__a").isNotNull()
    errors = [F.when(F.col("__a").isNull(), "missing"), F.when(F.col("__s").isNull(), "extra")]
    errors += [F.when(there & ~F.col(f"s_{f}").eqNullSafe(F.col(f"a_{f}")), f"{f}_mismatch") for f in fields]
    joined = s.join(a, key, "full_outer")
    return joined.select(key, F.explode(F.array_compact(F.array(*errors))).alias("error"))


def length_prefixed(*fields: Column) -> Column:
    """Fields as text, each after its length, so that no two lists of fields give one text."""
    return F.concat(*[F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields])


def merkle(rows: DataFrame, group: list[str], text: Column, depth: int | None = None) -> DataFrame:
    """(group..., hash, rows): a digest of each group's multiset of texts, in no order.

    Equal texts are counted first, with map-side combining, so a text that most rows share is one entry. Entries hash to
    md5 and form the leaves of a tree by the first `depth` hex digits; every inner node hashes its at most 16 children.
    By default the depth grows with the table, so that a leaf of the largest group holds about 256 entries: no task ever
    sees a whole group.
    """
    counted = rows.select(*group, F.md5(text).alias("h")).groupBy(*group, "h").agg(F.count("*").alias("n"))
    if depth is None:
        n = rows.count()
        depth = 0
        while n > 256 * 16**depth:
            depth += 1
    joined = lambda parts: F.md5(F.array_join(F.sort_array(F.collect_list(parts)), "\n"))
    level = counted.groupBy(*group, F.substring("h", 1, depth).alias("node")).agg(joined(F.concat("h", F.lit(":"), F.col("n").cast("string"))).alias("d"), F.sum("n").alias("rows"))
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(*group, F.substring("node", 1, k).alias("node")).agg(joined(F.concat("node", F.lit(":"), "d")).alias("d"), F.sum("rows").alias("rows"))
    return level.select(*group, F.col("d").alias("hash"), "rows")


def canonical_hash(rows: DataFrame, group: list[str], fields: list[Column], depth: int | None = None) -> DataFrame:
    """Digest of each group's records, of length-prefixed fields, whatever order they are stored in."""
    return merkle(rows, group, length_prefixed(*fields), depth)


def table_fingerprint(df: DataFrame, columns: list[str], depth: int | None = None) -> DataFrame:
    """Row count and content fingerprint of a table, independent of order; repeated rows count."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    found = merkle(df, [], text, depth)
    empty = F.md5(F.lit(""))
    return found.agg(F.coalesce(F.max("rows"), F.lit(0).cast("long")).alias("row_count"), F.coalesce(F.max("hash"), empty).alias("fingerprint"))
