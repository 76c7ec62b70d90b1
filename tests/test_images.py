"""Digests and image files against published values and plain Python."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import digest
from tessera.operators import fingerprint
from tessera.plans import registry
from tessera.sources import png, tree_source

SF = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


def plain_blake3(data):
    """The specification word by word, with its recursive tree."""

    def compress(chain, block, counter, length, flags):
        m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        v = [*chain, *digest.IV[:4], counter & MASK, counter >> 32, length, flags]
        turn = lambda x, k: (x >> k | x << 32 - k) & MASK
        for _ in range(7):
            for k, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
                for word, r, s in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + word) & MASK
                    v[d] = turn(v[d] ^ v[a], r)
                    v[c] = (v[c] + v[d]) & MASK
                    v[b] = turn(v[b] ^ v[c], s)
            m = [m[k] for k in digest.PERMUTATION]
        return [v[k] ^ v[k + 8] for k in range(8)]

    def node(data, at, root):
        if len(data) <= 1024:
            chain, blocks = list(digest.IV), [data[k : k + 64] for k in range(0, max(1, len(data)), 64)]
            for k, block in enumerate(blocks):
                chain = compress(chain, block, at, len(block), (k == 0) * 1 + (k == len(blocks) - 1) * (2 + 8 * root))
            return chain
        left = 1024
        while 2 * left < len(data):
            left *= 2
        joined = node(data[:left], at, False) + node(data[left:], at + left // 1024, False)
        return compress(digest.IV, struct.pack("<16I", *joined), 0, 64, 4 + 8 * root)

    return struct.pack("<8I", *node(data, 0, True))


def test_blake3_of_published_inputs():
    known = {
        0: "af1349b9f5f9a1a6a0404dea36dcc949", 1024: "42214739f095a406f3fc83deb889744a", 1025: "d00278ae47eb27b34faecf67b4fe263f", 2048: "e776b6028c7cd22a4d0ba182a8bf6220",
        2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3", 3072: "b98cb0ff3623be03326b373de6b90952",
    }
    inputs = [bytes(k % 251 for k in range(n)) for n in known]
    assert [d.hex()[:32] for d in digest.blake3_bytes(inputs)] == list(known.values())
    assert digest.blake3_bytes([b"abc"])[0].hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_blake3_of_any_batch(spark):
    rng = random.Random(3)
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 5000, 7 * 1024, 8 * 1024, 9 * 1024 + 1, 40_000]
    texts = [rng.randbytes(rng.choice(sizes)) for _ in range(60)] + [None, b""]
    df = spark.createDataFrame([(k, None if t is None else bytearray(t)) for k, t in enumerate(texts)], "id int, content binary")
    got = {r.id: r.d for r in df.select("id", digest.blake3("content").alias("d")).collect()}
    assert all(got[k] is None if t is None else bytes(got[k]) == plain_blake3(t) for k, t in enumerate(texts))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r.blake3 for r in registry.queries()["f18_blake3"](spark, SF).collect()}
    assert found == {i: None if t is None else plain_blake3(t.encode()).hex() for i, t in docs.items()}


def filtered(pixels, kinds):
    """A PNG file whose lines use the given filters by turns."""
    height, width, n = pixels.shape
    lines, above = [], np.zeros((width, n), int)
    for y in range(height):
        line, kind = pixels[y].astype(int), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros((1, n), int), line[:-1]])
        corner = np.concatenate([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        nearest = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, nearest][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(b"".join(lines))
    return png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 2: 4, 4: 6}[n], 0, 0, 0)) + part(b"tEXt", b"x") + part(b"IDAT", packed[:9]) + part(b"IDAT", packed[9:]) + part(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png_of_every_filter(samples):
    pixels = np.random.default_rng(samples).integers(0, 256, (13, 9, samples), dtype=np.uint8)
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (png.decode(filtered(pixels, kinds)) == pixels).all()
    for bad in (b"", b"GIF89a", png.encode(pixels[..., 0])[:-20], png.encode(pixels[..., 0]).replace(b"IDAT", b"IDAX")):
        with pytest.raises((ValueError, zlib.error)):
            png.decode(bad)


def test_probe_of_a_folder(spark, tmp_path):
    y, x = np.mgrid[0:64, 0:64]
    sample = (np.stack([4 * x, 4 * y, 2 * (x + y)], axis=-1) % 256).astype(np.uint8)
    turned = np.ascontiguousarray(np.rot90(sample))
    files = [("a/one.png", png.encode(sample)), ("a/two.PNG", png.encode(turned)), ("b/cut.png", png.encode(sample)[:-30]), ("c.jpg", b"\xff\xd8"), ("notes.txt", b"no image")]
    tree_source.write_tree(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "relative_path string, content binary"), str(tmp_path / "in"))
    got = {r.relative_path: r for r in png.probe(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a/one.png", "a/two.PNG", "b/cut.png", "c.jpg"}
    assert [got[k].error for k in ("a/one.png", "b/cut.png", "c.jpg")] == [None, "cut or damaged", "not a PNG file"]
    small = fingerprint.resized(png.gray(sample), 16)
    assert bytes(got["a/one.png"].block_hash) == fingerprint.block_hash(small)
    assert got["a/one.png"].eligible is False  # a plain gradient tells too little
    assert bytes(got["a/two.PNG"].block_hash) == fingerprint.block_hash(fingerprint.transformed(small, "rot270"))
    assert got["b/cut.png"].block_hash is None
    assert png.probe(spark, str(tmp_path / "in")).where(F.col("error").isNull()).count() == 2
