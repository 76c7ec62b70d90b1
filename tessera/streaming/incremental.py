"""Incremental detection: new files are merged batch by batch into saved edges and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.graph import saved, scratch
from tessera.sources.store import BucketStore

#: Appended parts of a bucket of edges after which it is rewritten, and versions that stay for readers of older ones.
MOST_PARTS, VERSIONS = 8, 4


class ExactIndex:
    """Representatives of content keys over all batches so far, and the star edges that they gave.

    State lives in folder, as two stores: the smallest id of each key, by key, and edges, by id. A batch reads and replaces
    the buckets of its own keys only, so its cost follows its own size and not the history's, and adds its edges. Both
    stores name the last batch that they have: one that is told again changes nothing, and one that failed between them
    finds its edges there. A restarted stream goes on where the last one ended; nothing is held by the driver. Edges
    of later batches may point to another representative than one batch over everything would choose, but the
    components are the same. Replaced parts are deleted VERSIONS batches later.
    """

    def __init__(self, spark: SparkSession, id_col: str, keys: list[str], schema: StructType, folder: str, buckets: int = 64):
        self.spark, self.id_col, self.keys = spark, id_col, keys
        kind = schema[id_col]
        self._known = BucketStore(spark, f"{folder.rstrip('/')}/representatives", StructType([*[schema[k] for k in keys], kind]), keys, buckets)
        self._edges = BucketStore(spark, f"{folder.rstrip('/')}/edges", StructType([kind]).add("rep", kind.dataType), [id_col], buckets)

    def representatives(self) -> DataFrame:
        """(keys..., id): the smallest id of each key."""
        return self._known.read()

    def edges(self) -> DataFrame:
        """(id, rep) of all batches."""
        return self._edges.read().distinct()

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a batch; rows with a null key have no duplicates."""
        with scratch(self.spark):
            self._merge(batch, batch_id)

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        done = self._known.version()
        if done.marks.get("batch", -1) >= batch_id:
            return
        rows = batch.select(self.id_col, *self.keys).where(" AND ".join(f"{k} IS NOT NULL" for k in self.keys))
        least = saved(rows.groupBy(*self.keys).agg(F.min(self.id_col).alias("first")), "batch-keys")
        known = self._known.read(self._known.touched(least), done).withColumnRenamed(self.id_col, "known")
        now = saved(least.join(known, self.keys, "left").withColumn("rep", F.least("first", "known")), "batch-representatives")
        if self._edges.version().marks.get("batch", -1) < batch_id:
            fresh = rows.join(now.select(*self.keys, "rep"), self.keys).where(F.col(self.id_col) != F.col("rep")).select(self.id_col, "rep")
            moved = now.where("known <> rep").select(F.col("known").alias(self.id_col), "rep")
            self._edges.append(fresh.unionByName(moved).distinct(), {"batch": batch_id})
            self._edges.compact(MOST_PARTS, DataFrame.distinct)
        fresh = now.select(*self.keys, F.col("rep").alias(self.id_col))
        self._known.change(least, lambda old: old.join(least, self.keys, "left_anti").unionByName(fresh), marks={"batch": batch_id})
        self._known.vacuum(VERSIONS)
        self._edges.vacuum(VERSIONS)


def detect_stream(spark: SparkSession, folder: str, schema: StructType, id_col: str, keys: dict[str, str], checkpoint: str, files_per_batch: int = 1) -> ExactIndex:
    """Runs a file stream to its end through an ExactIndex beside its checkpoint. keys: name -> SQL of each content key.

    Stopped at any point and started again with the same checkpoint, it gives what one run would have.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    shaped = stream.select(id_col, *[F.expr(sql).alias(k) for k, sql in keys.items()])
    index = ExactIndex(spark, id_col, list(keys), shaped.schema, f"{checkpoint.rstrip('/')}-index")
    query = shaped.writeStream.foreachBatch(index.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return index
