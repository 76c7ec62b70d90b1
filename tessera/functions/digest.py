"""BLAKE3-256 of binary columns, from the published specification, over all rows of an Arrow batch at once.

A message is cut into chunks of 1,024 bytes and these into blocks of 64; chunks chain their blocks, and a binary tree of
parents joins the chunks. All chunks of a batch go through the compression together, as arrays of 32-bit words, and so do all
parents of a level. (SHA-256 is Spark's own and needs no Python; this is for stores that know their files by BLAKE3.)
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# Fixed values of the specification.
IV = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Bytes that go through the compression together.
AT_ONCE = 16 << 20


def _compress(chain, words, counter, length, flags):
    """One compression each of n states: chain (8, n), words (16, n), the rest (n,). The first eight words of the outputs."""
    import numpy as np

    n = words.shape[1]
    full = lambda x: np.broadcast_to(np.asarray(x, dtype=np.uint64), n)
    low, high = (full(counter) & np.uint64(0xFFFFFFFF)).astype(np.uint32), (full(counter) >> np.uint64(32)).astype(np.uint32)
    v = [*chain.copy(), *[np.full(n, x, np.uint32) for x in IV[:4]], low, high, full(length).astype(np.uint32), full(flags).astype(np.uint32)]
    turn = lambda x, k: (x >> np.uint32(k)) | (x << np.uint32(32 - k))
    m = list(words)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
            for word, first, second in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = turn(v[d] ^ v[a], first)
                v[c] = v[c] + v[d]
                v[b] = turn(v[b] ^ v[c], second)
        m = [m[k] for k in PERMUTATION]
    return np.stack([v[k] ^ v[k + 8] for k in range(8)])


def _digests(messages: list[bytes]) -> list[bytes]:
    import numpy as np

    sizes = np.array([len(x) for x in messages], np.int64)
    chunks = np.maximum(1, -(-sizes // CHUNK))
    first = np.cumsum(chunks) - chunks
    row = np.repeat(np.arange(len(messages)), chunks)
    number = np.arange(len(row)) - first[row]
    # Every chunk on its own 1,024 bytes, padded with zeros.
    room = np.zeros(len(row) * CHUNK, np.uint8)
    for message, k in zip(messages, first):
        room[k * CHUNK : k * CHUNK + len(message)] = np.frombuffer(message, np.uint8)
    words = room.view("<u4").reshape(len(row), CHUNK // BLOCK, 16)
    length = np.minimum(sizes[row] - number * CHUNK, CHUNK)
    blocks = np.maximum(1, -(-length // BLOCK))
    alone = chunks[row] == 1
    chain = np.repeat(np.array(IV, np.uint32)[:, None], len(row), axis=1)
    for k in range(CHUNK // BLOCK):
        on = np.flatnonzero(blocks > k)
        if not len(on):
            break
        last = blocks[on] == k + 1
        flags = (CHUNK_START if k == 0 else 0) + np.where(last, CHUNK_END + np.where(alone[on], ROOT, 0), 0)
        chain[:, on] = _compress(chain[:, on], words[on, k].T, number[on], np.minimum(length[on] - BLOCK * k, BLOCK), flags)
    # Neighbours are joined level by level; an odd last one moves up as it is.
    nodes, of = chain, row
    while len(of) > len(messages):
        n = np.bincount(of, minlength=len(messages))
        start = np.cumsum(n) - n
        place = np.arange(len(of)) - start[of]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < n[of]))
        joined = _compress(np.repeat(np.array(IV, np.uint32)[:, None], len(left), axis=1), np.concatenate([nodes[:, left], nodes[:, left + 1]]), 0, BLOCK, np.where(n[of[left]] == 2, PARENT + ROOT, PARENT))
        nodes = nodes.copy()
        nodes[:, left] = joined
        stay = np.flatnonzero(place % 2 == 0)
        nodes, of = nodes[:, stay], of[stay]
    return [nodes[:, k].astype("<u4").tobytes() for k in range(len(messages))]


def blake3_bytes(messages: list[bytes]) -> list[bytes]:
    """Digests of messages, AT_ONCE bytes or one message at a time."""
    out, held, size = [], [], 0
    for message in messages:
        if held and size + len(message) + CHUNK > AT_ONCE:
            out += _digests(held)
            held, size = [], 0
        held.append(message)
        size += len(message) + CHUNK
    return out + (_digests(held) if held else [])


@F.pandas_udf(BinaryType())
def blake3(content: pd.Series) -> pd.Series:
    """BLAKE3-256 of a binary column; null for null."""
    known = content.dropna()
    found = pd.Series(blake3_bytes([bytes(x) for x in known]), index=known.index, dtype=object)
    return found.reindex(content.index).where(content.notna(), None)
