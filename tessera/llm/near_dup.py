"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation, sigma, scatters a set over a circle
of 2^32 places; a second one, pi, shifted by k places, gives coordinate k of the signature: the least pi(sigma(x) - k).
Two permutations so yield all coordinates. Bands of ROWS coordinates make buckets.

Documents with one set are one class from the start, so exact copies never meet each other again, and the sets of one
id are linked. In a bucket every class is compared with the bucket's smallest class, its head (a star, not all pairs),
links are confirmed on the full sets, and components are formed. In buckets whose other members then still belong to
several components, every one outside the largest component is compared with all members of other components, block
by block, on signatures alone; of pairs that are not surely below the threshold, each told by the first bucket it shares,
the ends' full sets are sent once to each block that needs them, and decide. Rows leave a block, and links that join
components, never all pairs. So no link between two components that share a
bucket is lost, nothing is capped, and a bucket with most of the corpus in it costs one pair a member as long as its
members are linked.

Only the documents that share a bucket have their sets built again and kept, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import erase, fitted, text_or_empty, utf8, whole_row, written
from tessera.llm.components import components

BANDS, ROWS = 24, 4
#: Elements that one numpy pass works on: fits a core's cache.
BATCH = 1 << 16
BLOCK = 256
#: Six standard errors of the estimate below 0.8 at BANDS * ROWS coordinates.
SURELY_BELOW = 0.24
WORD_CACHE = 100_000
_M1, _M2, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


class _Words(dict):
    """word -> 64-bit hash, for a bounded number of words at a time."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def _mix(x):
    """A permutation of the 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int):
    """Sorted distinct hashes of the UTF-8 text's width-word shingles; of all its words as one if they are fewer; none of none."""
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(h))
    n = len(h) - span + 1
    seed = (span * _STEP) & 0xFFFFFFFFFFFFFFFF
    out = np.full(n, seed, dtype=np.uint64)
    for j in range(span):
        out = _mix((out ^ h[j : j + n]) * np.uint64(_STEP) + np.uint64(j + 1))
    return np.unique(out)


def signatures(sets: list, bands: int = BANDS, rows: int = ROWS):
    """Circulant MinHash of non-empty sets: uint32 array (len(sets), bands * rows)."""
    import numpy as np

    coordinates = bands * rows
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    if not sets:
        return out
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    places = (_mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)  # sigma
    buffer = np.empty_like(places)
    shifted = np.empty_like(places)
    for k in range(coordinates):
        np.subtract(places, np.uint32(k), out=shifted)  # the circle turns by one place
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):  # pi, a permutation of 32-bit numbers
            np.right_shift(shifted, np.uint32(shift), out=buffer)
            np.bitwise_xor(shifted, buffer, out=shifted)
            if factor is not None:
                np.multiply(shifted, np.uint32(factor), out=shifted)
        out[:, k] = np.minimum.reduceat(shifted, starts)
    return out


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        def made(ids, sets, id_type):
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, bands, rows))
            data = [next(sig).tobytes() if len(s) else None for s in sets]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(data, pa.binary())],
                names=["id", "n_shingles", "digest", "sig"],
            )

        for batch in batches:
            ids, sets, held, id_type = [], [], 0, batch.schema.field(0).type
            for i, t in zip(batch.column(0), utf8(batch.column(1))):
                ids.append(i.as_py())
                sets.append(shingles(t, width))
                held += len(sets[-1])
                if held >= BATCH:
                    yield made(ids, sets, id_type)
                    ids, sets, held = [], [], 0
            if ids:
                yield made(ids, sets, id_type)

    return sign


def _bander(bands: int, rows: int):
    def band(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(_STEP)
            key = np.broadcast_to(key, sig.shape[:2])
            for j in range(rows):
                key = _mix((key ^ sig[:, :, j]) * np.uint64(_STEP) + np.uint64(j + 1))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            band_ = np.tile(np.arange(bands, dtype=np.int16), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), ids, pa.array(band_)], names=["bucket", "cls", "band"])

    return band


def _keeper(width: int):
    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, data, held = [], [], 0
            for i, t in zip(batch.column(0), utf8(batch.column(1))):
                ids.append(i)
                data.append(shingles(t, width).tobytes())
                held += len(data[-1])
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(data, pa.binary())], names=["cls", "set"])
                    ids, data, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(data, pa.binary())], names=["cls", "set"])

    return keep


def _confirmer(percent: int):
    def confirm(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            linked, last, other = [], None, None
            for a, b, x, y in zip(*[batch.column(c) for c in ("a", "b", "set_a", "set_b")]):
                x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                if other is None or last != b:  # rows come in order of b
                    last, other = b, np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(other)) < percent * max(len(x), len(other)):
                    linked.append(False)
                    continue
                at = np.searchsorted(other, x)
                at[at == len(other)] = 0
                both = int((other[at] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(other) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["u", "v"])

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as (u, v)."""
    kind = sets.schema["cls"].dataType.simpleString()
    rows = pairs.select("a", "b").distinct()
    rows = rows.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
    rows = rows.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(_confirmer(percent), f"u {kind}, v {kind}")


def _units(batches: Iterator, keys: list[str]) -> Iterator:
    """Tables of the rows that agree on keys, from batches in the order of keys; a unit may cross batches."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            col = batch.column(k)
            cuts[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[0] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(starts[:-1], starts[1:]):
            held.append(batch.slice(i, j - i))
            if j < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _likely(unit, bands: int, rows: int, least: float):
    """(left row, right rows) of one unit, a block of a bucket against a block of it, that are not surely below the threshold.

    A pair is told by the first bucket that it shares, so once in all. own: 1 outside the largest component, in block i; 2 in
    block j; 3 both.
    """
    import numpy as np

    own = unit.column("own").to_numpy()
    sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), dtype=np.uint32).reshape(len(own), bands * rows)
    label = np.unique(unit.column("label").to_numpy(), return_inverse=True)[1]
    band = int(unit.column("band")[0].as_py())
    left, right = np.flatnonzero(own & 1), np.flatnonzero(own & 2)
    for k in left.tolist():
        same = sig[right] == sig[k]
        near = np.flatnonzero((label[right] != label[k]) & (same.mean(axis=1) >= least))
        if len(near):
            first = same[near].reshape(len(near), bands, rows).all(axis=2).argmax(axis=1)
            near = right[near[first == band]]
        if len(near):
            yield k, near


def _blocks(bands: int, rows: int, least: float):
    """The rows of each unit that have a likely pair in it: rows leave, never pairs."""

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for unit in _units(batches, ["bucket", "i", "j"]):
            keep = np.zeros(unit.num_rows, dtype=bool)
            for k, near in _likely(unit, bands, rows, least):
                keep[k] = keep[near] = True
            if keep.any():
                yield from unit.filter(pa.array(keep)).combine_chunks().to_batches()

    return compare


def _deciders(bands: int, rows: int, least: float, percent: int):
    """Links of each unit, by the full sets of its rows. Of links that join what others joined already, none is told."""

    def decide(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for unit in _units(batches, ["bucket", "i", "j"]):
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in unit.column("set")]
            sizes = np.array([len(x) for x in sets])
            cls, kind = unit.column("cls").to_pylist(), unit.schema.field("cls").type
            of = np.unique(unit.column("label").to_numpy(), return_inverse=True)[1]  # component of each row, so far
            linked = []
            for k, near in _likely(unit, bands, rows, least):
                x = sets[k]
                near = near[(of[near] != of[k]) & (100 * np.minimum(sizes[near], len(x)) >= percent * np.maximum(sizes[near], len(x)))]
                if not len(near):
                    continue
                other = np.concatenate([sets[h] for h in near])
                at = np.minimum(np.searchsorted(x, other), len(x) - 1)
                both = np.add.reduceat((x[at] == other).astype(np.int64), np.cumsum([0, *sizes[near][:-1]]))
                for h in near[100 * both >= percent * (len(x) + sizes[near] - both)].tolist():
                    if of[h] != of[k]:
                        linked.append((cls[k], cls[h]))
                        of[of == of[h]] = of[k]
            yield pa.RecordBatch.from_arrays([pa.array([p[side] for p in linked], kind) for side in (0, 1)], names=["u", "v"])

    return decide


def spread(rows: DataFrame, side: DataFrame, hot_from: int) -> DataFrame:
    """rows joined with side, one row a bucket with its number of rows n: large buckets by broadcast, the others by a shuffle.

    There are at most len(rows) / hot_from large buckets; callers choose hot_from so that these are few.
    """
    hot = side.where(F.col("n") >= hot_from)
    if hot.isEmpty():
        return rows.join(side, "bucket")
    large = rows.join(F.broadcast(hot), "bucket")
    rest = rows.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti").join(side.where(F.col("n") < hot_from), "bucket")
    return large.unionByName(rest)


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Texts are compared by distinct width-word shingles after lower-casing A-Z; a link needs
    100 * intersection >= percent * union of the full sets. Texts without words (null and empty too) have no set and
    link with nothing. Rows that repeat an id count as one document, so what links one links all. Rows with a null id
    stand alone: component_id null, kept true. Other columns are not read; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    spark, log = docs.sparkSession, {}
    signed = written(base.mapInArrow(_signer(width, bands, rows), f"id {kind}, n_shingles long, digest binary, sig binary"), "near-signed", log)
    of_class = signed.where("id IS NOT NULL AND n_shingles > 0").groupBy("digest").agg(F.min("id").alias("cls"), F.first("sig").alias("sig"))
    of_class = written(of_class, "near-classes", log)
    entries = written(of_class.select("cls", "sig").mapInArrow(_bander(bands, rows), f"bucket long, cls {kind}, band short"), "near-entries", log)
    heads = entries.groupBy("bucket").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = written(heads, "near-heads", log)
    # At most 20,000 buckets can hold so large a part of the entries.
    hot_from = max(1000, entries.count() // 20_000)
    shared = written(spread(entries, heads, hot_from).select("bucket", "band", "cls", "head"), "near-shared", log)
    erase(spark, log, "near-entries", "near-heads")
    wanted = written(shared.select("cls").distinct(), "near-wanted", log)
    # One long per document that shares a bucket: a broadcast of at most 1,000,000 of them, else a shuffle join.
    again = base.join(fitted(wanted.withColumnRenamed("cls", "id"), 1_000_000), "id", "left_semi")
    sets = written(again.mapInArrow(_keeper(width), f"cls {kind}, set binary"), "near-sets", log)

    # Stars from each bucket's smallest class.
    pairs = shared.where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    # Ids with several sets: these are one document's.
    several = signed.where("id IS NOT NULL AND n_shingles > 0").groupBy("id").agg(F.min(F.xxhash64("digest")).alias("d"), F.max(F.xxhash64("digest")).alias("e")).where("d <> e").select("id")
    several = written(several, "near-several", log)
    found = confirmed(pairs, sets, percent)
    if not several.isEmpty():
        own = signed.where("n_shingles > 0").join(fitted(several, 1_000_000), "id").select("id", "digest").distinct()
        own = own.join(of_class.select("digest", "cls"), "digest").select("id", "cls")
        found = found.unionByName(own.join(own.groupBy("id").agg(F.min("cls").alias("v")), "id").where("cls <> v").select(F.col("cls").alias("u"), "v"))
    links = written(found, "near-links", log)
    labels = written(components(links, log), "near-labels", log)

    def extended(more: DataFrame) -> DataFrame:
        """Labels after further links: components of the components."""
        at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        moved = more.join(at("u"), "u", "left").join(at("v"), "v", "left")
        moved = moved.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        merged = components(moved, log)
        joined_ = labels.unionByName(merged.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        joined_ = joined_.join(merged.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        return written(joined_.select("node", F.coalesce("root", "label").alias("label")), "near-labels", log)

    # What stars cannot tell: buckets whose members beside the head, which has met them all, are of several components.
    # Those outside a bucket's largest component are compared with all, in units of two blocks.
    rows_ = shared.where("cls <> head").select("bucket", "band", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rows_ = written(rows_.select("bucket", "band", "cls", F.coalesce("label", "cls").alias("label")), "near-rows", log)
    sizes = rows_.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("k").alias("n"), F.max(F.struct("k", "label")).alias("m")).where("labels > 1")
    main = main.select(
        "bucket", "n", F.col("m.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil((F.col("n") - F.col("m.k")) / BLOCK).alias("own_parts")
    )
    main = written(main, "near-open", log)
    if not main.isEmpty():
        placed = spread(rows_, main, hot_from).join(of_class.select("cls", "sig"), "cls")
        up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        # A row goes to the units of its block i, if it is outside the largest component, and of its block j.
        outside = F.col("label") != F.col("main")
        placed = placed.withColumns({"pi": F.pmod(F.xxhash64("cls"), "own_parts"), "pj": F.pmod(F.xxhash64("cls"), "parts")})
        right = F.transform(up_to("own_parts"), lambda i: F.struct(i.alias("i"), F.col("pj").alias("j")))
        left = F.when(outside, F.transform(up_to("parts"), lambda j: F.struct(F.col("pi").alias("i"), j.alias("j")))).otherwise(F.slice(right, 1, 0))
        units = placed.withColumn("unit", F.explode(F.array_union(left, right)))
        own = F.when(outside & (F.col("unit.i") == F.col("pi")), 1).otherwise(0) + F.when(F.col("unit.j") == F.col("pj"), 2).otherwise(0)
        units = units.select("bucket", "unit.i", "unit.j", "band", own.alias("own"), "cls", "label", "sig")
        key = ["bucket", "i", "j"]
        least = max(0.0, percent / 100 - SURELY_BELOW)
        fields = f"bucket long, i long, j long, band short, own int, cls {kind}, label {kind}, sig binary"
        likely = written(units.repartition(*key).sortWithinPartitions(*key).mapInArrow(_blocks(bands, rows, least), fields), "near-likely", log)
        # Sets go once to each unit that has a likely pair with them, however many pairs that are.
        full = likely.join(sets, "cls").select(*likely.columns, "set").repartition(*key).sortWithinPartitions(*key)
        more = written(full.mapInArrow(_deciders(bands, rows, least, percent), f"u {kind}, v {kind}").distinct(), "near-links", log)
        if not more.isEmpty():
            labels = extended(more)

    # From classes to rows. A digest's class is narrow and unique; hot digests are many rows of one key, which
    # adaptive execution splits.
    named = of_class.select("digest", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = written(named.select("digest", F.coalesce("label", "cls").alias("label")), "near-named", log)
    erase(spark, log, *[n for n in log if n not in ("near-signed", "near-named")])
    out = signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
    found = F.when(F.col("id").isNull(), F.col("id")).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("label"))
    return out.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay, with docs' own columns: the document with the smallest id of each component.

    All rows of that id stay, repeated ones too; rows with null id or without words stay.
    """
    marks = near_components(docs, id_col, **options)
    gone = written(marks.where("NOT kept").select(F.col(id_col).alias("gone_id")).distinct(), "near-gone")
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"))
    return rows.join(fitted(gone, 1_000_000), F.col("id") == F.col("gone_id"), "left_anti").select("__row.*")
