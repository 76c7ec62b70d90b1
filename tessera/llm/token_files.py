"""Token-id files in Simple-8b, in ascending order of document ids.

A file holds blocks of whole documents. A document's ids are coded in 64-bit words, the first at the word that the
block's offset table names: 4 bits of selector, 60 bits of ids of one width. Selector 0 is an escape, for ids of 60 bits
or more: its low 60 bits count the raw 64-bit words that follow. The words of one selector decode together with
a few shifts, and any document decodes alone from its offset. Files are Parquet, one row per block, so that Spark's
commit protocol makes their writing safe against lost executors on any file system; the columns are the format:

  shard, block       place of the block; shards are in id order and blocks are in order within a shard
  shard_start        ids in the shard before this block
  n_docs, n_ids      documents in the block, and their ids
  doc_ids            the documents' ids, ascending, nulls first
  lengths, offsets   little-endian unsigned 32-bit: ids of each document, and its first word
  words              little-endian unsigned 64-bit words
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fitted, shared_dir, small_batches, text_or_empty, utf8, written

#: selector -> (ids in a word, bits of each). Fixed values of the format.
SELECTORS = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8),
    9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
ESCAPE = 0
#: A block ends with the document that brings it to so many ids; readers hold thousands of blocks at a time.
BLOCK_IDS = 1 << 12
#: Ids that are coded, or words that are decoded, in one go.
GROUP = 1 << 16
END_ID = 1
#: Text bytes of a shard, what a row counts beside its text, and the most shards: an exchange of many more costs more than it moves.
SHARD_BYTES, ROW_BYTES, MOST_SHARDS = 128 << 20, 16, 20_000


def encode(ids, ends):
    """Words of consecutive documents and each document's first word. ids: uint64 array; ends: end positions."""
    import numpy as np

    n = len(ids)
    ends = np.asarray(ends, dtype=np.int64)
    lengths = np.diff(ends, prepend=0)
    left = np.repeat(ends, lengths) - np.arange(n)  # ids up to the document's end
    # The first selector whose width holds each id: a byte each, so the passes below are cheap.
    limits = np.array([1 << bits for _, bits in SELECTORS.values()], dtype=np.uint64)
    need = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)[np.minimum(ids, (1 << 16) - 1)] if n > 1 << 12 else None
    if need is None or ids.max() >= 1 << 16:
        need = np.searchsorted(limits, ids, side="right").astype(np.uint8)
    best = np.full(n, 14, dtype=np.uint8)
    free = np.ones(n, dtype=bool)
    left = np.minimum(left, 255).astype(np.uint8)
    for s in range(1, 14):
        count = SELECTORS[s][0]
        if n < count:
            continue
        wide, size = need >= s, 1  # whether any of the next `size` ids is too wide, for sizes that double up to count
        while 2 * size <= count:
            wide = wide[:-size] | wide[size:]
            size *= 2
        if count > size:
            wide = wide[: size - count] | wide[count - size :]
        fits = ~wide
        if fits.any():
            fits &= free[: len(fits)] & (left[: len(fits)] >= count)
            best[: len(fits)][fits] = s
            free[: len(fits)] &= ~fits
    best[ids >= (1 << 60)] = ESCAPE
    step = np.array([1, *[SELECTORS[s][0] for s in range(1, 15)]])[best].tolist()
    at, i = [], 0
    put = at.append
    while i < n:
        put(i)
        i += step[i]
    at = np.array(at, dtype=np.int64)
    chosen = best[at]
    extra = np.cumsum(chosen == ESCAPE)  # an escaped id takes a selector word and a raw one
    place = np.arange(len(at)) + extra - (chosen == ESCAPE)
    words = np.zeros(len(at) + int(extra[-1] if len(at) else 0), dtype=np.uint64)
    for s in range(1, 15):
        mine = chosen == s
        if mine.any():
            count, bits = SELECTORS[s]
            from_, word = at[mine], np.full(int(mine.sum()), s << 60, dtype=np.uint64)
            for j in range(count):
                word |= ids[from_ + j] << np.uint64(j * bits)
            words[place[mine]] = word
    raw = chosen == ESCAPE
    words[place[raw]] = 1
    words[place[raw] + 1] = ids[at[raw]]
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    # A document without ids would start where the next one does.
    which = np.minimum(np.searchsorted(at, starts), max(len(at) - 1, 0))
    return words, np.where(starts < n, place[which] if len(at) else 0, len(words))


def decode(words):
    """All ids of the words, in order."""
    import numpy as np

    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    i, escapes = 0, np.flatnonzero(selector == ESCAPE)
    while i < len(escapes):
        at, n = escapes[i], int(words[escapes[i]])
        raw[at + 1 : at + 1 + n] = True
        i = int(np.searchsorted(escapes, at + 1 + n))
    counts = np.array([0, *[SELECTORS[s][0] for s in range(1, 15)], 0])[selector]
    counts[raw] = 1
    to = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(selector[~raw]):
        if s != ESCAPE:
            count, bits = SELECTORS[int(s)]
            mine = (selector == s) & ~raw
            w, start, mask = words[mine], to[mine], np.uint64((1 << bits) - 1)
            for j in range(count):
                out[start + j] = (w >> np.uint64(j * bits)) & mask
    out[to[raw]] = words[raw]
    return out


def _coder(path: str | None, end_id: int, block_ids: int):
    def code(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import encoder

        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        shard, number, before = TaskContext.get().partitionId(), 0, 0

        def blocks(docs, texts, id_type):
            """Codes a group of documents, and cuts it into blocks."""
            nonlocal number, before
            ids = np.frombuffer(b"".join(texts), dtype=enc.dtype).astype(np.uint64)
            lengths = np.array([len(t) // enc.dtype.itemsize for t in texts], dtype=np.int64)
            ends = np.cumsum(lengths)
            words, offsets = encode(ids, ends)
            offsets = np.append(offsets, len(words))
            cols: dict[str, list] = {c: [] for c in ("block", "shard_start", "n_docs", "n_ids", "doc_ids", "lengths", "offsets", "words")}
            i = 0
            while i < len(docs):
                start = ends[i] - lengths[i]
                j = min(len(docs), int(np.searchsorted(ends, start + block_ids)) + 1)
                n = int(ends[j - 1] - start)
                own = words[offsets[i] : offsets[j]].astype("<u8").tobytes()
                row = (number, before, j - i, n, docs[i:j], lengths[i:j].astype("<u4").tobytes(), (offsets[i:j] - offsets[i]).astype("<u4").tobytes(), own)
                for c, v in zip(cols, row):
                    cols[c].append(v)
                number, before, i = number + 1, before + n, j
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array([shard] * len(cols["block"]), pa.int32()), *[pa.array(v, k) for v, k in zip(cols.values(), kinds)]]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", *cols])

        docs, texts, held = [], [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0), utf8(batch.column(1))):
                docs.append(i.as_py())
                texts.append(enc.encode(t) + end)
                held += len(texts[-1]) // enc.dtype.itemsize
                if held >= GROUP:
                    yield blocks(docs, texts, id_type)
                    docs, texts, held = [], [], 0
        if texts:
            yield blocks(docs, texts, id_type)

    return code


def shard_starts(sizes: DataFrame, shards: int) -> list:
    """The first id of every shard but the first, so that shards of ids in order have about the same number of bytes each.

    sizes has id and bytes, one row per document. Running totals are taken within ranges of ids, and the totals of the
    earlier ranges are added; the driver gets one row per range and one per shard. An id is never cut, however many
    rows it has, so a shard may be larger by what one id holds. Null ids belong to the first shard.
    """
    of_id = sizes.where("id IS NOT NULL").groupBy("id").agg(F.sum("bytes").alias("bytes"))
    ranged = written(of_id.repartitionByRange(F.col("id")).withColumn("range", F.spark_partition_id()), "token-ranges")
    totals = ranged.groupBy("range").agg(F.sum("bytes").alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    upto = F.col("before") + F.sum("bytes").over(Window.partitionBy("range").orderBy("id")) - F.col("bytes")
    placed = ranged.join(F.broadcast(before), "range").select("id", upto.alias("at"))
    each = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // shards))
    firsts = placed.groupBy(F.floor(F.col("at") / each).alias("shard")).agg(F.min("id").alias("id")).where("shard > 0")
    # By way of Arrow, as the ids that they are compared with come.
    return firsts.orderBy("shard").select("id").toArrow().column(0).to_pylist()


def _shard_of(starts: list):
    @F.arrow_udf("int")
    def shard(ids):
        import pyarrow as pa

        return pa.array([0 if i is None else bisect_right(starts, i) for i in ids.to_pylist()], pa.int32())

    return shard


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encodes every text, adds end_id to each, and writes the files under path in ascending id order.

    Shards hold about shard_bytes of text each; small tables have more and smaller ones, to keep all cores at work, and
    beyond MOST_SHARDS they grow instead. Null and empty texts have the end id alone. Null ids come first; rows that
    share an id are ordered by text, so reruns agree; other columns are not read. An empty table writes a readable
    folder without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sizes = written(rows.select("id", (F.octet_length("text") + ROW_BYTES).cast("long").alias("bytes")), "token-sizes")
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least = min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024))
    shards = max(1, least, min(MOST_SHARDS, -(-total // shard_bytes)))
    shard = _shard_of(shard_starts(sizes, shards) if shards > 1 else [])
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"shard int, block int, shard_start long, n_docs int, n_ids long, doc_ids array<{kind}>, lengths binary, offsets binary, words binary"
    with small_batches(spark):
        dealt = rows.repartitionById(shards, shard("id")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
        dealt.mapInArrow(_coder(tokenizer, end_id, block_ids), schema).write.option("compression", "zstd").parquet(path)


def _reader(id_field: str):
    def read_blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            i = 0
            while i < batch.num_rows:  # as many blocks as make up a group; their words follow on each other
                j, held, lengths, words, starts = i, 0, [], [], []
                while j < batch.num_rows and held < GROUP:
                    own = np.frombuffer(batch.column("lengths")[j].as_buffer(), dtype="<u4").astype(np.int64)
                    words.append(np.frombuffer(batch.column("words")[j].as_buffer(), dtype="<u8"))
                    starts.append(np.cumsum(own) - own + batch.column("shard_start")[j].as_py())
                    lengths.append(own)
                    held += len(words[-1])
                    j += 1
                n = np.concatenate(lengths)
                ends = np.cumsum(n)
                data = memoryview(decode(np.concatenate(words)).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                shard = np.repeat(batch.column("shard").slice(i, j - i).to_numpy(), [len(x) for x in lengths])
                ids = batch.column("doc_ids").slice(i, j - i).flatten()
                columns = [ids, pa.array(shard, pa.int32()), pa.array(np.concatenate(starts)), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_field, "shard", "in_shard", "n_tokens", "ids_crc32"])
                i = j

    return read_blocks


def read_documents(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    # One row per file; the running total over them is the only ordered step.
    shards = blocks.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("n"))
    shards = shards.select(F.col("shard").alias("of"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    docs = blocks.select("shard", "shard_start", "doc_ids", "lengths", "words").mapInArrow(
        _reader("id"), f"id {kind}, shard int, in_shard long, n_tokens long, ids_crc32 long"
    )
    docs = written(docs, "token-documents")
    placed = docs.join(fitted(shards, 20_000), F.col("shard") == F.col("of"))
    return placed.select(F.col("id").alias(id_col), (F.col("in_shard") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, id_col, **options)
    return read_documents(spark, path, id_col)
