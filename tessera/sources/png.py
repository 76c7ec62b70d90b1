"""PNG images as pixel arrays: enough of the format for 8-bit gray and colour images, so that files can be fingerprinted.

The standard library inflates; JPEG and WebP need codecs that are not here, and are reported as such.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import extension
from tessera.operators import fingerprint
from tessera.operators.graph import saved
from tessera.sources.files import IMAGE_EXTENSIONS

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Colour type -> samples a pixel: gray, RGB, gray with alpha, RGB with alpha.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels that one image may have.
MOST_PIXELS = 100_000_000
#: Gray from red, green and blue, in ten thousandths (ITU-R BT.709).
LUMA = (2126, 7152, 722)


def encode(pixels) -> bytes:
    """A (height, width) or (height, width, 3) array of bytes as a PNG file."""
    import numpy as np

    p = np.asarray(pixels, np.uint8)
    height, width = p.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), p.reshape(height, -1)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if p.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def decode(data: bytes):
    """The (height, width, samples) array of a PNG file; ValueError says what is wrong with it."""
    import numpy as np

    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed = 8, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("cut or damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        packed += [body] if kind == b"IDAT" else []
        at += 12 + size
        if kind == b"IEND":
            break
    else:
        raise ValueError("cut or damaged")
    width, height, depth, colour, _, _, interlaced = head or (0,) * 7
    if depth != 8 or colour not in SAMPLES or interlaced or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("a kind of PNG that is not read here")
    n = SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width * n + 1):
        raise ValueError("cut or damaged")
    lines = raw.reshape(height, width * n + 1)
    out = np.zeros((height, width, n), np.int64)
    above = np.zeros((width, n), np.int64)
    for k in range(height):
        out[k] = above = _unfiltered(int(lines[k, 0]), lines[k, 1:].reshape(width, n).astype(np.int64), above)
    return out.astype(np.uint8)


def _unfiltered(kind: int, line, above):
    """A line's samples from their differences to the left (1), above (2), the mean of both (3), or the nearest of three (4)."""
    import numpy as np

    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0) % 256
    if kind == 2:
        return (line + above) % 256
    if kind not in (3, 4):
        raise ValueError("cut or damaged")
    left, corner, out = np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64), np.empty_like(line)
    for x in range(len(line)):
        up = above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left, corner = (line[x] + guess) % 256, up
        out[x] = left
    return out


def gray(pixels):
    """(height, width) gray levels; alpha is left out."""
    import numpy as np

    p = np.asarray(pixels, np.int64)
    return (p[..., 0] if p.shape[-1] < 3 else p[..., :3] @ np.array(LUMA) // 10_000).astype(np.uint8)


def _decoded(batches):
    import hashlib

    import pandas as pd

    for batch in batches:
        rows = []
        for path, content in zip(batch["relative_path"], batch["content"]):
            try:
                p = decode(content)
                digest = hashlib.sha256(struct.pack(">QQ", p.shape[1], p.shape[0]) + p.tobytes()).hexdigest()
                rows.append((path, p.shape[1], p.shape[0], gray(p).tobytes(), digest, None))
            except (ValueError, zlib.error) as error:
                rows.append((path, None, None, None, None, "cut or damaged" if isinstance(error, zlib.error) else str(error)))
        found = pd.DataFrame(rows, columns=["id", "width", "height", "pixels", "pixel_hash", "error"])
        yield found.astype({"width": "Int32", "height": "Int32"})


def probe(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of a folder's image files, and what keeps the others from having one.

    relative_path, width, height, pixel_hash (of size and samples), block_hash, fine_hash, eligible, error. Whole files are
    read, 2 GB each at most, a few at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    files = files.withColumns({"base": base, "place": F.regexp_replace("path", "^[a-z]+:/*", "/")})
    files = files.select(F.expr("substring_index(place, concat(base, '/'), -1)").alias("relative_path"), "content").where(extension(F.col("relative_path")).isin(IMAGE_EXTENSIONS))
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        read = saved(files.mapInPandas(_decoded, "id string, width int, height int, pixels binary, pixel_hash string, error string"), "decoded-images")
        prints = saved(fingerprint.fingerprints(read.where("error IS NULL")).drop("pixel_hash", "variants"), "probe-prints")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch") if few is None else spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    return read.join(prints, "id", "left").select(F.col("id").alias("relative_path"), "width", "height", "pixel_hash", "block_hash", "fine_hash", "eligible", "error")


def _gradients(batches):
    import numpy as np
    import pandas as pd

    y, x = np.mgrid[0:64, 0:64]
    base = np.stack([4 * x, 4 * y, 2 * (x + y)], axis=-1)
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "content": [encode((base + int(k)) % 256) for k in batch["shift"]]})


def gradient_samples(rows: DataFrame) -> DataFrame:
    """(id, shift) -> (id, content): 64 x 64 colour gradients as PNG files, each shifted in level by its own number."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "shift").mapInPandas(_gradients, f"id {kind}, content binary")
