"""A stored perceptual index: block hashes by lane, kept up by changes and probed without a rebuild.

A hash of n bytes is cut into lanes of two bytes; of hashes within a radius, at least one lane differs in at most
radius // lanes bits. The index has one posting (lane, value, id, hash) for each lane of each id, in buckets by (lane,
value). A probe reads the buckets of its own lanes' values, with that many bits flipped, and no others. Probes that are so many
that they would read all buckets are joined with the ids' hashes instead (near.binary_join).

Changes are appended: new postings, and tombstones where an id had a value that it no longer has; of a posting's
entries the last one holds. Buckets of many appended parts are rewritten now and then, without what is dead. The ids' hashes
are a second store, by id, which tells inserted, unchanged and updated ids apart from the batch's own buckets. It is
published last and names the version of the postings that belongs to it, so a change that fails in between never shows.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.expr import binary_lanes, hamming
from tessera.operators.graph import saved, scratch
from tessera.sources.store import BucketStore, Version

#: Appended parts of a bucket after which it is rewritten, and lookups for each bucket from which on postings are left aside.
MOST_PARTS, MANY_PROBES = 8, 50


class LaneIndex:
    def __init__(self, spark: SparkSession, folder: str, n_bytes: int, id_type: str = "bigint", buckets: int = 64):
        if n_bytes % 2:
            raise ValueError("lanes have two bytes each")
        self.n_bytes, self.lanes = n_bytes, n_bytes // 2
        of = lambda ddl: StructType.fromDDL(ddl)
        self.rows = BucketStore(spark, f"{folder}/rows", of(f"id {id_type}, hash binary"), ["id"], buckets)
        self.postings = BucketStore(spark, f"{folder}/postings", of(f"lane int, value int, id {id_type}, hash binary, live boolean, seq bigint"), ["lane", "value"], buckets)

    # Lanes

    def _cut(self, lanes64: Column, k: int) -> Column:
        return F.shiftrightunsigned(lanes64[k // 4], 48 - 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int")

    def _exploded(self, rows: DataFrame, hash_col: str) -> DataFrame:
        """rows with (lane, value) for each lane of their hash; hashes of other lengths, and null ones, have none."""
        known = rows.where(F.octet_length(hash_col) == self.n_bytes).withColumn("__lanes", binary_lanes(F.col(hash_col), self.n_bytes))
        return known.select("*", F.posexplode(F.array(*[self._cut(F.col("__lanes"), k) for k in range(self.lanes)])).alias("lane", "value"))

    def _live(self, postings: DataFrame) -> DataFrame:
        """Of each (lane, value, id) the last entry, if it is not a tombstone."""
        last = postings.groupBy("lane", "value", "id").agg(F.max(F.struct("seq", "live", "hash")).alias("m"))
        return last.where("m.live").select("lane", "value", "id", "m.hash", "m.live", "m.seq")

    # Changes

    def _base(self) -> Version:
        """The rows' version; postings that no version of the rows names are forgotten."""
        now = self.rows.version()
        self.postings.rollback(now.marks.get("postings", -1))
        return now

    def _write(self, postings: DataFrame, rows_change) -> None:
        made = self.postings.append(postings)
        rows_change({"postings": made.version})
        compacted = self.postings.compact(MOST_PARTS, self._live)
        if compacted:
            self.rows.mark({"postings": compacted.version})

    def upsert(self, batch: DataFrame) -> dict[str, int]:
        """Adds ids, skips those that have the same hash, replaces the hash of others: counts of each.

        batch has id and hash; a null hash (an ineligible image) is known but never found. Repeated equal rows count once; an
        id with two hashes is an error, and nothing is changed then.
        """
        with scratch(self.rows.spark):
            return self._upsert(batch)

    def _upsert(self, batch: DataFrame) -> dict[str, int]:
        base = self._base()
        seq = base.number + 1
        fresh = saved(batch.select("id", "hash").distinct(), "index-batch")
        twice = fresh.groupBy("id").count().where("count > 1").select("id").limit(1).collect()
        if twice:
            raise ValueError(f"the batch has conflicting rows for id {twice[0][0]}")
        touched = self.rows.touched(fresh)
        old = self.rows.read(touched, base).select("id", F.col("hash").alias("was"), F.lit(True).alias("known"))
        change = F.when(F.col("known").isNull(), "inserted").when(F.col("hash").eqNullSafe(F.col("was")), "unchanged").otherwise("updated")
        held = saved(fresh.join(old, "id", "left").withColumn("change", change), "index-change")
        counts = {r["change"]: r["count"] for r in held.groupBy("change").count().collect()}
        told = {k: counts.get(k, 0) for k in ("inserted", "unchanged", "updated")}
        if told["inserted"] + told["updated"] == 0:
            return told
        moved = held.where("change <> 'unchanged'")
        added = self._exploded(moved.select("id", "hash"), "hash").select("lane", "value", "id", "hash", F.lit(True).alias("live"))
        gone = self._exploded(moved.where("known").select("id", "was"), "was").select("lane", "value", "id").join(added.select("lane", "value", "id"), ["lane", "value", "id"], "left_anti")
        gone = gone.select("*", F.lit(None).cast("binary").alias("hash"), F.lit(False).alias("live"))
        replaced = lambda old_rows: old_rows.join(moved.select("id"), "id", "left_anti").unionByName(moved.select("id", "hash"))
        self._write(added.unionByName(gone).withColumn("seq", F.lit(seq).cast("long")), lambda marks: self.rows.change(moved, replaced, marks=marks))
        return told

    def remove(self, ids: DataFrame) -> int:
        """Takes ids out; the number of those that were there."""
        with scratch(self.rows.spark):
            return self._remove(ids)

    def _remove(self, ids: DataFrame) -> int:
        base = self._base()
        old = self.rows.read(self.rows.touched(ids), base).join(ids.select("id").distinct(), "id", "left_semi")
        old = saved(old, "index-removed")
        n = old.count()
        if n:
            gone = self._exploded(old, "hash").select("lane", "value", "id", F.lit(None).cast("binary").alias("hash"), F.lit(False).alias("live"))
            kept = lambda rows: rows.join(old.select("id"), "id", "left_anti")
            self._write(gone.withColumn("seq", F.lit(base.number + 1).cast("long")), lambda marks: self.rows.change(old, kept, marks=marks))
        return n

    # Probes

    def near(self, probes: DataFrame, radius: int, carry: list[str] | None = None) -> DataFrame:
        """(left_id, carried columns, right_id, distance): indexed ids within radius of the probes (id, hash, carried).

        Each pair counts at its first near lane, which needs no distinct. An id is found by itself too.
        """
        flips = radius // self.lanes
        if flips > 2:
            raise ValueError(f"a radius of {radius} of {8 * self.n_bytes} bits is too wide for lanes of 16 bits")
        from tessera.operators.near import _masks, binary_join

        now = self.rows.version()
        keep = carry or []
        known = saved(probes.select("id", *keep, "hash").where(F.octet_length("hash") == self.n_bytes), "index-probes")
        masks = _masks(16, flips)
        if known.count() * self.lanes * len(masks) > MANY_PROBES * self.postings.buckets:
            # All buckets would be read, and the stored hashes are fewer rows than their postings.
            found = binary_join(known, self.rows.read(None, now), "id", "hash", radius, 8 * self.n_bytes, keep)
            return found.select("left_id", *keep, "right_id", "distance")
        asked = self._exploded(known.select(F.col("id").alias("left_id"), *keep, F.col("hash").alias("left_hash")), "left_hash")
        asked = asked.select("left_id", *keep, "left_hash", "lane", "value")
        asked = asked.withColumn("value", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: m.bitwiseXOR(F.col("value")))))
        found = self._live(self.postings.read(self.postings.touched(asked), self.postings.version(now.marks.get("postings", -1))))
        pairs = asked.join(found.select("lane", "value", F.col("id").alias("right_id"), F.col("hash").alias("right_hash")), ["lane", "value"])
        a, b = binary_lanes(F.col("left_hash"), self.n_bytes), binary_lanes(F.col("right_hash"), self.n_bytes)
        pairs = pairs.withColumns({"__a": a, "__b": b})
        first = F.coalesce(*[F.when(F.bit_count(self._cut(F.col("__a"), k).bitwiseXOR(self._cut(F.col("__b"), k))) <= flips, F.lit(k)) for k in range(self.lanes)])
        distance = hamming(F.col("__a"), F.col("__b"))
        return pairs.where((F.col("lane") == first) & (distance <= radius)).select("left_id", *keep, "right_id", distance.cast("long").alias("distance"))
