"""Hierarchical multi-length packing of token sequences.

Each task packs the documents that it reads, in shards of SHARD_TOKENS tokens, so no row is shuffled and memory is
bounded. Documents longer than the window give whole windows first; what is left of every document is routed to the
smallest context tier that holds it. From the longest item down, an item opens a window of its tier, and the gap is
filled from the shorter tiers: best fits whole, then one cut of the next longer item, whose rest is routed again. Every
window is thus full. What remains when a shard runs out is cut at powers of two, so no sequence is padded. A shard's
sequences are dealt to step groups of equal token counts, largest first to the lightest group.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, utf8, written

WINDOW = 4096
TIERS = (256, 512, 1024, 2048, 4096)
SHARD_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
END_ID = 2
#: Chunks that the encoder remembers here: workers outlive the stage, beside whatever else runs on their machine.
CHUNKS = 250_000
PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
)


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (length, pieces) for documents of these lengths; a piece is (document's index, start, length)."""
    window = tiers[-1]
    done: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
    for k, n in enumerate(lengths):
        whole = n // window
        done += [(window, [(k, i * window, window)]) for i in range(whole)]
        if n % window:
            pool.append((n % window, k, whole * window))
    pool.sort()
    while pool:
        n, k, start = pool.pop()
        tier = next(t for t in tiers if t >= n)
        pieces, gap = [(k, start, n)], tier - n
        while gap and pool:
            at = bisect_right(pool, (gap, len(lengths), 0))
            if at:
                n, k, start = pool.pop(at - 1)
                pieces.append((k, start, n))
                gap -= n
            else:
                n, k, start = pool.pop(0)
                pieces.append((k, start, gap))
                insort(pool, (n - gap, k, start + gap))
                gap = 0
        done += [(tier, pieces)] if not gap else powers_of_two(pieces)
    return done


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The same pieces as sequences whose lengths are powers of two, largest first."""
    left, out = sum(p[2] for p in pieces), []
    queue = list(reversed(pieces))
    while left:
        size = 1 << (left.bit_length() - 1)
        own, room = [], size
        while room:
            k, start, n = queue.pop()
            take = min(n, room)
            own.append((k, start, take))
            room -= take
            if n > take:
                queue.append((k, start + take, n - take))
        out.append((size, own))
        left -= size
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence; groups hold about step_tokens tokens and differ by less than one window."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (load + sizes[i], g))
    return out


def _packer(id_field, path: str | None, end_id: int, tiers: tuple[int, ...], shard_tokens: int, step_tokens: int):
    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import encoder

        enc = encoder(path, CHUNKS)
        width, end = enc.dtype.itemsize, np.array([end_id], dtype=enc.dtype).tobytes()
        # Fixed by the partition, which a retried task shares: sequence and group numbers survive lost executors.
        first = TaskContext.get().partitionId() << 36
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
        numbered = grouped = first

        def packed(ids: list, texts: list[bytes]):
            nonlocal numbered, grouped
            sequences = plan([len(t) // width for t in texts], tiers)
            group_of = step_groups([s[0] for s in sequences], step_tokens)
            docs, cols = [], {c: [] for c in names}
            for (size, pieces), g in zip(sequences, group_of):
                offset = 0
                for k, start, n in pieces:
                    part = np.frombuffer(texts[k], dtype=enc.dtype, count=n, offset=start * width)
                    docs.append(ids[k])
                    row = (start, n, zlib.crc32(part.astype("<u4").tobytes()), len(texts[k]) // width, numbered, offset, size, grouped + g)
                    for c, v in zip(names, row):
                        cols[c].append(v)
                    offset += n
                numbered += 1
            grouped += max(group_of, default=-1) + 1
            out = [pa.array(docs, type=id_type), *[pa.array(cols[c], type=pa.int64()) for c in names]]
            return pa.RecordBatch.from_arrays(out, names=[id_field, *names])

        ids, texts, held, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0), utf8(batch.column(1))):
                tokens = enc.encode(t) + end
                ids.append(i.as_py())
                texts.append(tokens)
                held += len(tokens) // width
                if held >= shard_tokens:
                    yield packed(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield packed(ids, texts)

    return pack


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    shard_tokens: int = SHARD_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group.

    Every id of every document lies in one piece. Null and empty texts give the end id alone. Repeated rows are
    separate documents, null ids stay null, other columns are not read, and an empty table gives an empty result.
    tokenizer: a path that exists on the executors; default the word_bpe_49k vocabulary.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = rows.mapInArrow(_packer("id", tokenizer, end_id, tuple(tiers), shard_tokens, step_tokens), f"id {kind}, {PIECES}")
    return written(packed, "packed").withColumnRenamed("id", id_col)
