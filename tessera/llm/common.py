"""Helpers shared by the corpus operators: shared-folder tables, checked broadcasts, text normalisation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Used only where a local session names no spark.checkpoint.dir (tests, a laptop).
LOCAL_SHARED_DIR = "/tmp/checkpoints"
#: What Python workers get at a time, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session may leave it out."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_SHARED_DIR
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, Python workers get BATCH_ROWS rows and BATCH_BYTES bytes at a time: texts are long, and a batch is held several times over."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Erases the tables that written() made within it, for work whose result is stored by then. One driver thread at a time."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        erase(spark, {"own": own}, "own")


def written(df: DataFrame, name: str, log: dict[str, list[str]] | None = None) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    Lineage ends there: a lost executor costs a reread of files, never a recomputation of what came before,
    and what follows sees one fixed set of rows even where it scans them twice. The folder may be emptied once a
    query's result is stored; with log, an operator erases tables that nothing will read again itself, and within
    scratch() all go at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    with small_batches(spark):
        df.write.parquet(path)
    if log is not None:
        log.setdefault(name, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(spark: SparkSession, log: dict[str, list[str]], *names: str) -> None:
    """Deletes the logged tables of these names, on whatever file system they are."""
    for path in [p for n in names for p in log.pop(n, [])]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fitted(small: DataFrame, most_rows: int) -> DataFrame:
    """small with a broadcast hint if it has at most most_rows rows, else as it is (a shuffle join follows).

    Counts at most most_rows + 1 rows; small should be a written table, so that this reads no more than metadata.
    """
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small


def joined(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", most_rows: int = 20_000) -> DataFrame:
    """Null-safe equi-join of rows with a table that has one row per key; small's other columns must be new to rows."""
    side = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(fitted(side, most_rows), on, how).drop(*[f"__{k}" for k in keys])


def whole_row(docs: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row's columns (default all) as one struct, so that none can clash with an operator's own; select("__row.*") undoes it."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in (columns or docs.columns)]).alias("__row")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. All-ASCII text takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(column):
    """The UTF-8 bytes of an Arrow text column, one by one, without making Python strings of them."""
    import pyarrow as pa

    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return (x.as_py() for x in raw)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the parts and the seed: the first 52 bits of an md5, so that other engines can repeat it."""
    word = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return (F.conv(F.substring(F.md5(word), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
