"""A keyed table in the shared folder that is changed by whole buckets and published by versions.

    <folder>/data/<version>-<uuid>/__bucket=<b>/*.parquet    rows, cut by a hash of their key
    <folder>/log/<version>                                   one small text: which data folders hold each bucket, and marks

A change reads and writes the buckets of its own keys only; all others keep their files. Its rows are staged first,
counted and checked in the pass that writes them, and then published by one rename that fails if someone else was
faster, or discarded: readers see whole versions or nothing. Replaced folders stay until vacuum(), for readers of older
versions. The log names as many folders as there are buckets, at most a few each: a bounded text, read by the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer published this version."""


@dataclass
class Version:
    """What a version consists of: bucket -> data folders, oldest first; marks are the caller's, kept from version to version."""

    number: int = -1
    buckets: dict[int, list[str]] = field(default_factory=dict)
    marks: dict[str, object] = field(default_factory=dict)


@dataclass
class Outcome:
    """What became of a change: its counts, and the version it made if it was published."""

    published: bool
    version: int | None
    counts: dict[str, int]


class Folder:
    """The few file-system calls that a store needs, on whatever file system the folder is."""

    def __init__(self, spark: SparkSession, path: str):
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway, self.path = spark._sc._gateway, path.rstrip("/")

    def _at(self, name: str):
        place = self._fs.Path(f"{self.path}/{name}" if name else self.path)
        return place, place.getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        place, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def read(self, name: str) -> str:
        place, fs = self._at(name)
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """The whole file appears at once; Conflict if it is there already."""
        place, fs = self._at(name)
        part, _ = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self._fs, "Options$Rename")
        try:
            self._fs.FileContext.getFileContext(part.toUri(), self._conf).rename(part, place, self._gateway.new_array(rename, 0))
        except Exception as error:
            fs.delete(part, False)
            if fs.exists(place):
                raise Conflict(name) from error
            raise

    def delete(self, name: str) -> None:
        place, fs = self._at(name)
        fs.delete(place, True)


class BucketStore:
    """Rows of a schema by key. buckets is fixed when the store is made; a change reads at least one whole bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.schema, self.key, self.buckets = spark, schema, list(key), buckets
        self.folder = Folder(spark, folder)

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names("log") if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """The given version, or the last one; an empty one before the first."""
        if number is None:
            number = max(self.versions(), default=-1)
        if number < 0:
            return Version()
        told = json.loads(self.folder.read(f"log/{number:012d}"))
        return Version(number, {int(b): f for b, f in told["buckets"].items()}, told["marks"])

    # Reading

    def bucket_of(self, columns: Sequence[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or [F.col(k) for k in self.key])), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that rows' keys fall into: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.bucket_of()).distinct().collect()}

    def read(self, buckets: Iterable[int] | None = None, version: Version | None = None) -> DataFrame:
        """The rows of these buckets, or of all; only their files are read."""
        at = version or self.version()
        wanted = sorted(at.buckets if buckets is None else set(buckets) & set(at.buckets))
        paths = [f"{self.folder.path}/data/{f}/{BUCKET}={b}" for b in wanted for f in at.buckets[b]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # Writing

    def stage(self, rows: DataFrame, counts: Mapping[str, Column] | None = None) -> tuple[str, list[int], dict[str, int]]:
        """Writes rows beside the table: (data folder, buckets that got rows, counts).

        counts are aggregates over all rows (and may use columns that are not stored), taken in the pass that writes.
        """
        name = f"{uuid.uuid4().hex}"
        # Adaptive execution splits a bucket that a hot key makes large among tasks, and puts small ones together.
        dealt = rows.withColumn(BUCKET, self.bucket_of()).hint("rebalance", BUCKET)
        seen = Observation()
        # Observed behind the exchange: tasks of the last stage count once, even if they are tried again.
        dealt = dealt.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in (counts or {}).items()])
        dealt.select(*self.schema.names, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder.path}/data/{name}")
        got = sorted(int(n.split("=")[1]) for n in self.folder.names(f"data/{name}") if n.startswith(f"{BUCKET}="))
        return name, got, {k: int(v or 0) for k, v in seen.get.items()}

    def publish(self, base: Version, staged: str, got: Iterable[int], touched: Iterable[int], replace: bool, marks: Mapping[str, object] | None = None) -> Version:
        """Makes staged rows the next version after base: in place of the touched buckets' rows, or beside them."""
        buckets = {b: list(f) for b, f in base.buckets.items()}
        for b in touched if replace else ():
            buckets.pop(b, None)
        for b in got:
            buckets.setdefault(b, []).append(staged)
        new = Version(base.number + 1, buckets, {**base.marks, **(marks or {})})
        self.folder.write_once(f"log/{new.number:012d}", json.dumps({"buckets": new.buckets, "marks": new.marks}, sort_keys=True))
        return new

    def discard(self, staged: str) -> None:
        self.folder.delete(f"data/{staged}")

    def mark(self, marks: Mapping[str, object]) -> Version:
        """A version with the same rows and these marks."""
        return self.publish(self.version(), "", (), (), False, marks)

    def rollback(self, number: int) -> None:
        """Forgets the versions after this one: those that a writer of several stores left when it failed between them."""
        for n in self.versions():
            if n > number:
                self.folder.delete(f"log/{n:012d}")

    def append(self, rows: DataFrame, marks: Mapping[str, object] | None = None) -> Outcome:
        """Adds rows beside those of their buckets."""
        base = self.version()
        staged, got, counts = self.stage(rows)
        return self._published(base, staged, got, got, False, marks, counts)

    def change(
        self, keys: DataFrame, how: Callable[[DataFrame], DataFrame], counts: Mapping[str, Column] | None = None, allow: Callable[[dict[str, int]], bool] | None = None,
        marks: Mapping[str, object] | None = None,
    ) -> Outcome:
        """Puts how(old rows) in place of the rows of the buckets that keys fall into.

        how gets all rows of those buckets and gives all that are to be there; its rows keep to these buckets. counts are taken of
        its rows as they are written; if allow refuses them, the table stays as it was.
        """
        base = self.version()
        touched = self.touched(keys)
        staged, got, found = self.stage(how(self.read(touched, base)), counts)
        if not set(got) <= touched:
            self.discard(staged)
            raise ValueError("a change gave rows of buckets that its keys do not touch")
        if allow is not None and not allow(found):
            self.discard(staged)
            return Outcome(False, None, found)
        return self._published(base, staged, got, touched, True, marks, found)

    def _published(self, base, staged, got, touched, replace, marks, counts) -> Outcome:
        try:
            made = self.publish(base, staged, got, touched, replace, marks)
        except Conflict:
            self.discard(staged)
            raise
        return Outcome(True, made.number, counts)

    def compact(self, above: int = 8, how: Callable[[DataFrame], DataFrame] | None = None) -> Outcome | None:
        """Rewrites buckets of more than `above` folders as one, through how if given; None if there are none."""
        base = self.version()
        many = {b for b, f in base.buckets.items() if len(f) > above}
        if not many:
            return None
        rows = self.read(many, base)
        staged, got, counts = self.stage(how(rows) if how else rows)
        return self._published(base, staged, got, many, True, None, counts)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions, and the data that none of them has; nobody may be writing. The number of folders deleted."""
        numbers = self.versions()
        used = {f for n in numbers[-keep:] for folders in self.version(n).buckets.values() for f in folders}
        gone = [f for f in self.folder.names("data") if f not in used]
        for n in numbers[:-keep]:
            self.folder.delete(f"log/{n:012d}")
        for f in gone:
            self.folder.delete(f"data/{f}")
        return len(gone)


# Changes by key on a stored table


def upsert(store: BucketStore, new: DataFrame) -> Outcome:
    """New rows replace those of their key. new has one row per key."""
    return store.change(new, lambda old: old.join(new.select(*store.key), store.key, "left_anti").unionByName(new.select(*store.schema.names)))


def upgrade(store: BucketStore, new: DataFrame, priority: Column) -> Outcome:
    """Per key the row of the lowest priority; the stored row where they are equal."""

    def best(old: DataFrame) -> DataFrame:
        rows = old.withColumn("__new", F.lit(0)).unionByName(new.select(*store.schema.names).withColumn("__new", F.lit(1)))
        least = F.min(F.struct(priority.alias("p"), F.col("__new"), F.struct(*store.schema.names).alias("row")))
        return rows.groupBy(*store.key).agg(least.alias("m")).select("m.row.*")

    return store.change(new, best)


def remove(store: BucketStore, keys: DataFrame) -> Outcome:
    """Takes the rows of these keys away."""
    return store.change(keys, lambda old: old.join(keys.select(*store.key), store.key, "left_anti"))


def guarded_update(store: BucketStore, keys: DataFrame, column: str, guard: Column, value: Column, violations: Mapping[str, Column] | None = None, expected: int | None = None) -> Outcome:
    """Sets column to value in the rows of these keys where guard holds, if that breaks no rule.

    counts tell the rows affected and, for each rule, the rows of the touched buckets that would break it (a rule that is
    null is not broken). With any violation, or another number of affected rows than expected, nothing is changed.
    """
    rules = dict(violations or {})

    def updated(old: DataFrame) -> DataFrame:
        named = keys.select(*store.key).distinct().withColumn("__named", F.lit(True))
        hit = F.coalesce(F.col("__named") & guard, F.lit(False))
        return old.join(named, store.key, "left").withColumn("__hit", hit).withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column)))

    counts = {"affected": F.count_if("__hit"), **{name: F.count_if(F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}}
    return store.change(keys, updated, counts, lambda c: not any(c[name] for name in rules) and expected in (None, c["affected"]))
