"""Image fingerprints on gray arrays: dihedral transforms, block and double-gradient hashes, eligibility.

No imaging library is at hand, so decoding stays outside: inputs are gray arrays (rows of bytes, width x height). Digests
are sha2-256, of the same width as those that the workflow stores; the kernels keep the hashes' shapes (256 and 544
bits) but not another implementation's bits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Images, and pixels, that go through the kernels together.
AT_ONCE, PIXELS_AT_ONCE = 512, 4 << 20
# Eligibility.
MIN_STDDEV, MIN_BINS, MIN_EDGE = 8.0, 4, 2.0


def transformed(gray, transform: str):
    """The eight dihedral transforms of (..., height, width) arrays."""
    import numpy as np

    turned = lambda g, k: np.rot90(g, k, axes=(-2, -1))
    return {
        "identity": lambda g: g, "rot90": lambda g: turned(g, -1), "rot180": lambda g: turned(g, 2), "rot270": lambda g: turned(g, 1),
        "flip_h": lambda g: g[..., ::-1], "flip_v": lambda g: g[..., ::-1, :], "transpose": lambda g: np.swapaxes(g, -2, -1), "transverse": lambda g: np.swapaxes(turned(g, 2), -2, -1),
    }[transform](gray)


def _overlaps(n: int, side: int):
    """How far each of side cells covers each of n pixels, in units of 1 / (n side): integers."""
    import numpy as np

    at, k = np.arange(side + 1) * n, np.arange(n) * side
    return np.clip(np.minimum(at[1:, None], k + side) - np.maximum(at[:-1, None], k), 0, None)


def resized(gray, side: int):
    """Area-weighted resampling of (..., height, width) arrays to side x side."""
    import numpy as np

    def weights(n):
        over = _overlaps(n, side)
        return over / over.sum(1, keepdims=True)

    g = np.asarray(gray, dtype=np.float64)
    return weights(g.shape[-2]) @ g @ weights(g.shape[-1]).T


def block_hash(gray16):
    """256 bits: each cell of a 16 x 16 thumbnail against the median of its quarter of rows. A list for a stack."""
    import numpy as np

    g = np.asarray(gray16, dtype=np.float64)
    bands = g.reshape(*g.shape[:-2], 4, -1)
    return _packed((bands > np.median(bands, axis=-1, keepdims=True)).reshape(*g.shape[:-2], -1))


def reduced17(gray32):
    """The 17 x 17 reduction of whole gray levels, in whole units, so that equal cells are equal.

    Sums of integers below 2^53 are exact in floating point too, where products of matrices are much faster.
    """
    import numpy as np

    g = np.asarray(gray32, dtype=np.float64)
    return (_overlaps(g.shape[-2], 17).astype(np.float64) @ g @ _overlaps(g.shape[-1], 17).T.astype(np.float64)).astype(np.int64)


def double_gradient_hash(gray32):
    """544 bits: signs of horizontal, then vertical, differences over a 17 x 17 reduction (17 x 16 each). A list for a stack."""
    return gradients(reduced17(gray32))


def gradients(cells):
    """The hash of a reduction; that of a transformed image is that of its transformed reduction."""
    import numpy as np

    flat = lambda d: (d > 0).reshape(*cells.shape[:-2], -1)
    return _packed(np.concatenate([flat(np.diff(cells, axis=-1)), flat(np.diff(cells, axis=-2))], axis=-1))


def _packed(bits):
    import numpy as np

    found = np.packbits(bits, axis=-1)
    return found.tobytes() if found.ndim == 1 else [row.tobytes() for row in found]


def information(hashes: list[bytes]):
    """Of each hash the ones or the zeros, whichever are fewer."""
    import numpy as np

    own = np.frombuffer(b"".join(hashes), np.uint8).reshape(len(hashes), -1)
    ones = np.bitwise_count(own).sum(1, dtype=np.int64)
    return np.minimum(ones, 8 * own.shape[1] - ones)


def eligible(gray32, blocks: list[bytes], fines: list[bytes]):
    """Whether the thumbnails of a stack have enough contrast, levels, edges and hash information to be compared at all.

    All bounds are compared in integers: a standard deviation of exactly MIN_STDDEV is enough.
    """
    import numpy as np

    g = np.asarray(gray32, dtype=np.int64)
    n = g.shape[-1] * g.shape[-2]
    if not n:
        return np.zeros(len(g), bool)
    contrast = n * (g * g).sum((1, 2)) - g.sum((1, 2)) ** 2 >= MIN_STDDEV**2 * n * n
    bins = g // 16
    levels = sum(((bins == k).sum((1, 2)) >= max(n // 200, 2)).astype(np.int64) for k in range(16))
    steps = sum(np.abs(np.diff(g, axis=k)).sum((1, 2)) for k in (1, 2))
    n_steps = 2 * n - g.shape[-1] - g.shape[-2]
    edges = (steps >= MIN_EDGE * n_steps) & (n_steps > 0)
    told = [information(h) >= max(8 * len(h[0]) // 64, 1) for h in (blocks, fines)]
    return contrast & (levels >= MIN_BINS) & edges & told[0] & told[1]


def _fingerprints(batches: Iterator) -> Iterator:
    for batch in batches:
        # Images of one size go through the kernels as one array, some at a time.
        for (height, width), own in batch.groupby(["height", "width"], sort=False):
            step = max(1, min(AT_ONCE, PIXELS_AT_ONCE // max(1, height * width)))
            for at in range(0, len(own), step):
                yield _of_one_size(own.iloc[at : at + step], height, width)


def _of_one_size(own, height: int, width: int):
    import hashlib

    import numpy as np
    import pandas as pd

    from tessera.schemas import TRANSFORMS

    g = np.stack([np.frombuffer(p, dtype=np.uint8) for p in own["pixels"]]).reshape(-1, height, width)
    small, large = resized(g, 16), np.rint(resized(g, 32)).astype(np.uint8)
    blocks = {t: block_hash(transformed(small, t)) for t in TRANSFORMS}
    cells = reduced17(large)
    fines = {t: gradients(transformed(cells, t)) for t in TRANSFORMS}
    variants = [[{"transform": t, "hash": blocks[t][k], "fine_hash": fines[t][k]} for t in TRANSFORMS] for k in range(len(own))]
    block, fine = blocks["identity"], fines["identity"]
    size = int(width).to_bytes(8, "big") + int(height).to_bytes(8, "big")
    digests = [hashlib.sha256(size + p).hexdigest() for p in own["pixels"]]
    return pd.DataFrame({"id": own["id"].array, "block_hash": block, "fine_hash": fine, "variants": variants, "eligible": eligible(large, block, fine), "pixel_hash": digests})


def fingerprints(images: DataFrame) -> DataFrame:
    """images (id, width, height, pixels binary) -> hashes, the eight variants of both, eligibility, pixel digest."""
    kind = images.schema["id"].dataType.simpleString()
    schema = f"id {kind}, block_hash binary, fine_hash binary, variants array<struct<transform:string,hash:binary,fine_hash:binary>>, eligible boolean, pixel_hash string"
    return images.select("id", "width", "height", "pixels").mapInPandas(_fingerprints, schema)
