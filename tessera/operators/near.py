"""Perceptual near-duplicates: Hamming recall by pigeonhole lanes, fine verification, classification, best evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import hamming64, recall_radius


#: Comparing two 64-bit hashes costs about this part of carrying one more row through a shuffle.
COMPARISON = 1 / 64
#: Hashes of a block where blocks are compared, balls of one comparison, and masks that a probe may try on one lane.
BLOCK, MOST_BALLS, MOST_MASKS = 4096, 64, 4096
#: Pairs that a task holds before it keeps the nearest of each image.
HELD_PAIRS = 1 << 20
#: Pairs that the comparison of two blocks holds before it hands them on.
FOUND_PAIRS = 1 << 18
#: Comparing two binary hashes, by the same measure as COMPARISON: 2.4 ns of 256 bits, where a row takes over a microsecond.
WIDE_COMPARISON = 1 / 512
#: Hashes a side of a square of binary hashes, comparisons of one step (which then stay in cache), and tasks for all squares.
SQUARE, STRIP, MOST_SQUARE_TASKS = 16384, 1 << 18, 10_000


def _edges(lanes: int, bits: int) -> list[int]:
    return [bits * k // lanes for k in range(lanes + 1)]


def _masks(width: int, flips: int) -> list[int]:
    """All masks of a lane with at most so many bits set, fewest first."""
    from itertools import combinations

    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)]


def _tried(width: int, flips: int) -> int:
    from math import comb

    return sum(comb(width, k) for k in range(flips + 1))


def lane_plan(n_left: int, n_right: int, radius: int, bits: int) -> int | None:
    """The number of lanes that makes the join cheapest, None where comparing all pairs is cheaper than any.

    Of m lanes, one differs in at most radius // m bits, so each left hash is looked up with that many bits flipped. More
    lanes mean fewer flips but narrower lanes, which agree by chance more often.
    """
    all_pairs = n_left * n_right * COMPARISON
    best, least = None, all_pairs
    for m in range(1, min(radius + 1, bits) + 1):
        flips, widths = radius // m, [b - a for a, b in zip(_edges(m, bits), _edges(m, bits)[1:])]
        tried = [_tried(w, flips) for w in widths]
        if max(tried) > MOST_MASKS:
            continue
        cost = n_left * sum(tried) + n_right * m + n_left * n_right * COMPARISON * sum(t / 2**w for t, w in zip(tried, widths))
        if cost < least:
            best, least = m, cost
    return best


def lane_join(left: DataFrame, right: DataFrame, id_col: str, hash_col: str, radius: int, bits: int = 64, lanes: int | None = None) -> DataFrame:
    """Pairs (left_id, right_id, distance) within radius of 64-bit hashes, without comparing all pairs.

    Cut into lanes (default: radius + 1), two hashes within radius differ on one of them in at most radius // lanes bits,
    so the join is on (lane, value), with the left side's values tried with that many bits flipped. A pair that comes
    near on several lanes is kept at the first of them only, which needs no distinct.
    """
    lanes = lanes or min(radius + 1, bits)
    edges, flips = _edges(lanes, bits), radius // lanes

    def cut(column: Column, k: int) -> Column:
        width = edges[k + 1] - edges[k]
        return F.shiftrightunsigned(column, edges[k]).bitwiseAND(F.lit((1 << width) - 1))

    def exploded(df: DataFrame, side: str) -> DataFrame:
        own = df.select(F.col(id_col).alias(f"{side}_id"), F.col(hash_col).alias(f"{side}_hash"))
        return own.select("*", F.posexplode(F.array(*[cut(F.col(f"{side}_hash"), k) for k in range(lanes)])).alias("lane", "value"))

    probes = exploded(left, "left")
    if flips:
        by_width = {w: F.array(*[F.lit(x).cast("long") for x in _masks(w, flips)]) for w in {b - a for a, b in zip(edges, edges[1:])}}
        wide = max(by_width)
        masks = by_width[wide] if len(by_width) == 1 else F.when(F.col("lane").isin([k for k in range(lanes) if edges[k + 1] - edges[k] == wide]), by_width[wide]).otherwise(by_width[min(by_width)])
        probes = probes.withColumn("mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    pairs = probes.join(exploded(right, "right"), ["lane", "value"])
    first = F.coalesce(
        *[F.when(F.bit_count(cut(F.col("left_hash").bitwiseXOR(F.col("right_hash")), k)) <= flips, F.lit(k)) for k in range(lanes)]
    )
    distance = hamming64(F.col("left_hash"), F.col("right_hash"))
    return pairs.where((F.col("lane") == first) & (distance <= radius)).select("left_id", "right_id", distance.cast("long").alias("distance"))


def _compared(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one cell: at most BLOCK hashes or so a side, in strips; found pairs go out before they are many."""
        import numpy as np

        cell = pa.Table.from_batches(batches)
        left, right = (cell.filter(cell.column(f"{side}_hash").is_valid()) for side in ("left", "right"))
        a, b = (t.column(f"{side}_hash").to_numpy().view(np.uint64) for t, side in ((left, "left"), (right, "right")))
        found, n = [], 0

        def pairs():
            i, j, d = (np.concatenate(x) for x in zip(*found))
            rows = pa.table({"left_id": left.column("left_id").take(pa.array(i)), "right_id": right.column("right_id").take(pa.array(j)), "distance": pa.array(d)})
            return rows.combine_chunks().to_batches()

        for at in range(0, len(a), 64):
            apart = np.bitwise_count(a[at : at + 64, None] ^ b[None, :])
            i, j = np.nonzero(apart <= radius)
            found.append((i + at, j, apart[i, j].astype(np.int64)))
            n += len(i)
            if n >= FOUND_PAIRS:
                yield from pairs()
                found, n = [], 0
        if n:
            yield from pairs()

    return compare


def ball_join(left: DataFrame, right: DataFrame, id_col: str, hash_col: str, radius: int, block: int = BLOCK, most_balls: int = MOST_BALLS) -> DataFrame:
    """lane_join's pairs for wide radii: right hashes lie in balls around pivots, and left ones go to the balls they can reach.

    Each right hash belongs to its nearest pivot. By the triangle inequality, a left hash at distance d of a pivot has no
    partner in its ball unless d is within radius of the distances that the ball holds. What a ball and its callers
    hold is cut into squares of about `block` hashes a side, one task each, so neither side is whole in a task; each
    pair is compared in one square. Pivots are fixed by a hash of the values; they and the balls' sizes are all that the
    driver gets. Null hashes have no pairs.
    """
    from tessera.operators.graph import saved

    side = lambda df, name: saved(df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias(f"{name}_id"), F.col(hash_col).alias(f"{name}_hash")), f"{name}-hashes")
    l, r = side(left, "left"), side(right, "right")  # noqa: E741
    balls = max(1, min(most_balls, -(-r.count() // block)))
    pivots = [p[0] for p in r.select("right_hash").distinct().orderBy(F.xxhash64("right_hash"), "right_hash").limit(balls).collect()]
    if not pivots:
        return l.join(r, F.lit(False)).select("left_id", "right_id", F.lit(0).cast("long").alias("distance"))
    away = lambda c: F.array(*[hamming64(F.col(c), F.lit(p).cast("long")) for p in pivots])
    r = r.withColumn("away", away("right_hash")).withColumn("far", F.array_min("away"))
    r = r.withColumn("ball", F.array_position("away", F.col("far")).cast("int") - 1).drop("away")
    held = {x.ball: x for x in r.groupBy("ball").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # at most most_balls rows
    reach = [(k, held[k].near - radius, held[k].far + radius) for k in held]
    wanted = F.filter(F.array(*[F.when(F.col("away")[k].between(least, most), F.lit(k)) for k, least, most in reach]), lambda k: k.isNotNull())
    l = l.withColumn("away", away("left_hash")).select("left_id", "left_hash", F.explode(wanted).alias("ball"))  # noqa: E741
    asking = {x.ball: x["count"] for x in l.groupBy("ball").count().collect()}  # as many
    per_ball = lambda n: F.element_at(F.create_map(*[F.lit(v) for k in held for v in (k, max(1, -(-n.get(k, 0) // block)))]), F.col("ball"))
    rows, columns = per_ball(asking), per_ball({k: x.n for k, x in held.items()})
    own = lambda side, n: F.pmod(F.xxhash64(f"{side}_id", f"{side}_hash"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = l.select("left_id", "left_hash", "ball", own("left", rows).alias("i"), all_of(columns).alias("j"))  # noqa: E741
    r = r.select("right_id", "right_hash", "ball", all_of(rows).alias("i"), own("right", columns).alias("j"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    cells = l.unionByName(r, allowMissingColumns=True).groupBy("ball", "i", "j")
    return cells.applyInArrow(_compared(radius), f"left_id {kind(l, 'left_id')}, right_id {kind(r, 'right_id')}, distance bigint")


def radius_join(left: DataFrame, right: DataFrame, id_col: str, hash_col: str, radius: int, bits: int = 64) -> DataFrame:
    """Pairs within radius, by the lanes that lane_plan finds cheapest for the sides' sizes, or by balls as the last resort.

    A wide radius (a third of the bits) takes in so large a part of all pairs that no lanes tell them apart.
    """
    n_left, n_right = left.count(), right.count()
    lanes = lane_plan(n_left, n_right, radius, bits)
    if lanes is None:
        return ball_join(left, right, id_col, hash_col, radius)
    return lane_join(left, right, id_col, hash_col, radius, bits, lanes)


def _square(radius: int, n_bytes: int, carry: list[str]):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one cell of binary hashes: about SQUARE a side, in strips; found pairs go out before they are many."""
        import numpy as np

        cell = pa.Table.from_batches(batches)
        left, right = (cell.filter(cell.column(f"{side}_hash").is_valid()) for side in ("left", "right"))
        if not len(left) or not len(right):
            return
        a, b = (_words(t.column(f"{side}_hash"), n_bytes) for t, side in ((left, "left"), (right, "right")))
        b_words = np.ascontiguousarray(b.T)
        # The first words tell nearly all far pairs; their distance fits a byte.
        first = max(1, min(3, a.shape[1] // 2))
        found, n = [], 0

        def pairs():
            i, j, d = (np.concatenate(x) for x in zip(*found))
            rows = {"left_id": left.column("left_id").take(pa.array(i)), "right_id": right.column("right_id").take(pa.array(j))}
            rows |= {c: left.column(c).take(pa.array(i)) for c in carry}
            return pa.table(rows | {"distance": pa.array(d)}).combine_chunks().to_batches()

        strip = max(1, STRIP // len(b))
        for at in range(0, len(a), strip):
            own = a[at : at + strip]
            apart = np.bitwise_count(own[:, :1] ^ b_words[0])
            for k in range(1, first):
                apart += np.bitwise_count(own[:, k : k + 1] ^ b_words[k])
            i, j = np.divmod(np.flatnonzero(apart <= radius), len(b))
            d = apart[i, j] + np.bitwise_count(own[i, first:] ^ b[j, first:]).sum(1, dtype=np.int64)
            near = d <= radius
            found.append((i[near] + at, j[near], d[near]))
            n += len(found[-1][0])
            if n >= FOUND_PAIRS:
                yield from pairs()
                found, n = [], 0
        if n:
            yield from pairs()

    return compare


def _words(hashes: pa.ChunkedArray, n_bytes: int):
    """Binary hashes as rows of 64-bit words, the last one filled up with zero bits."""
    import numpy as np

    own = np.frombuffer(b"".join(hashes.to_pylist()), np.uint8).reshape(-1, n_bytes)
    return np.pad(own, ((0, 0), (0, -n_bytes % 8))).view(np.uint64)


def _scattered(bits: int):
    """The bits of each 16-bit lane: one of every bits / 16 in a row, each five further on than the one before.

    Neighbours of a thumbnail, which are often alike, so lie in different lanes: 16 bits of a 16 x 16 thumbnail are of 16
    rows and 16 columns.
    """
    import numpy as np

    lanes, row = bits // 16, np.arange(16)
    return lanes * row + (5 * row + np.arange(lanes)[:, None]) % lanes


def _with_words(df: DataFrame, side: str, n_bytes: int, lanes: bool = False) -> DataFrame:
    """df with its hashes as 64-bit words instead of bytes, and their scattered lanes if asked for."""
    other = [f for f in df.schema.fields if f.name != f"{side}_hash"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), kind))
        for batch in batches:
            words = _words(batch.column(f"{side}_hash"), n_bytes)
            out = {f.name: batch.column(f.name) for f in other} | {f"{side}_words": listed(words.view(np.int64), pa.int64())}
            if lanes:
                ones = np.unpackbits(words.view(np.uint8), axis=1)[:, _scattered(8 * n_bytes)]
                out[f"{side}_lanes"] = listed(np.packbits(ones, axis=-1).view(">u2")[..., 0].astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_pydict(out)

    held = [f"`{f.name}` {f.dataType.simpleString()}" for f in other] + [f"{side}_words array<bigint>"] + [f"{side}_lanes array<int>"] * lanes
    return df.mapInArrow(cut, ", ".join(held))


def _apart(kind: str, n: int) -> Column:
    """The distance of both sides' words, written out: no function is called for each of them."""
    each = [F.bit_count(F.col(f"left_{kind}")[k].bitwiseXOR(F.col(f"right_{kind}")[k])) for k in range(n)]
    return sum(each[1:], each[0])


def _lane_values(df: DataFrame, side: str) -> DataFrame:
    return df.select("*", F.posexplode(f"{side}_lanes").alias("lane", "value"))


def _tried_values(df: DataFrame, flips: int) -> DataFrame:
    """Each (lane, value) with up to `flips` bits flipped."""
    masks = F.array(*[F.lit(m) for m in _masks(16, flips)])
    return df.withColumn("__mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("__mask"))).drop("__mask")


def lanes_pay(left: DataFrame, right: DataFrame, n_left: int, n_right: int, radius: int, bits: int) -> bool:
    """Whether looking the left hashes up by 16-bit lanes costs less than comparing all pairs.

    The pairs that lanes bring together are counted from how often each value of a lane occurs, as hashes of alike images
    agree far more often than random ones.
    """
    lanes = bits // 16
    if bits % 16 or radius // lanes > 2:
        return False
    flips, all_pairs = radius // lanes, n_left * n_right * WIDE_COMPARISON
    looked_up = n_left * lanes * _tried(16, flips) + n_right * lanes
    if looked_up >= all_pairs:
        return False
    often = lambda df, side: _lane_values(_with_words(df, side, bits // 8, True), side).groupBy("lane", "value").agg(F.count("*").cast("double").alias(f"n_{side}"))
    met = _tried_values(often(left, "left"), flips).join(often(right, "right"), ["lane", "value"]).agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0]
    return looked_up + (met or 0) < all_pairs


def _by_lanes(left: DataFrame, right: DataFrame, radius: int, bits: int, carry: list[str]) -> DataFrame:
    """Pairs by their lanes, each at the first lane on which it is near, which needs no distinct."""
    lanes = bits // 16
    flips = radius // lanes
    l, r = _with_words(left, "left", bits // 8, True), _with_words(right, "right", bits // 8, True)  # noqa: E741
    pairs = _tried_values(_lane_values(l, "left"), flips).join(_lane_values(r, "right"), ["lane", "value"])
    near = lambda k: F.bit_count(F.col("left_lanes")[k].bitwiseXOR(F.col("right_lanes")[k])) <= flips
    first = F.coalesce(*[F.when(near(k), F.lit(k)) for k in range(lanes)])
    distance = _apart("words", -(-bits // 64))
    return pairs.where(distance <= radius).where(F.col("lane") == first).select("left_id", "right_id", *carry, distance.cast("long").alias("distance"))


def _by_squares(left: DataFrame, right: DataFrame, n_left: int, n_right: int, radius: int, bits: int, carry: list[str]) -> DataFrame:
    """Pairs by comparing all: both sides are dealt by a hash, and each square of about SQUARE rows a side is one group."""
    rows, columns = (max(1, -(-n // SQUARE)) for n in (n_left, n_right))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = left.select("*", own(rows, "left_id", *carry, "left_hash").alias("__i"), all_of(columns).alias("__j"))  # noqa: E741
    r = right.select("*", own(columns, "right_id", "right_hash").alias("__j"), all_of(rows).alias("__i"))
    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    found = ", ".join([kind(l, "left_id"), kind(r, "right_id"), *[kind(l, c) for c in carry], "distance bigint"])
    # As many partitions as squares: they are small and take long, so their bytes must not decide how many a task gets.
    cells = l.unionByName(r, allowMissingColumns=True).repartition(min(rows * columns, MOST_SQUARE_TASKS), "__i", "__j")
    return cells.groupBy("__i", "__j").applyInArrow(_square(radius, bits // 8, carry), found)


def binary_join(left: DataFrame, right: DataFrame, id_col: str, hash_col: str, radius: int, bits: int, carry: list[str] | None = None) -> DataFrame:
    """Pairs (left_id, right_id, left's carried columns, distance) within radius of binary hashes of `bits` bits.

    Either hashes are looked up by lanes of 16 bits with some flipped, or all pairs are compared, a few nanoseconds each,
    in squares that are one task's: whichever costs less by the sides' sizes and values. Both give the same pairs. Null
    hashes and hashes of another length have no pairs.
    """
    from tessera.operators.graph import saved

    if bits % 8:
        raise ValueError(f"{bits} bits are no whole bytes")
    keep = carry or []

    def side(df: DataFrame, name: str, carried: list[str]) -> DataFrame:
        own = df.where(F.octet_length(hash_col) == bits // 8)
        return saved(own.select(F.col(id_col).alias(f"{name}_id"), *carried, F.col(hash_col).alias(f"{name}_hash")), f"{name}-hashes")

    l, r = side(left, "left", keep), side(right, "right", [])  # noqa: E741
    n_left, n_right = l.count(), r.count()
    if lanes_pay(l, r, n_left, n_right, radius, bits):
        return _by_lanes(l, r, radius, bits, keep)
    return _by_squares(l, r, n_left, n_right, radius, bits, keep)


def recalled_images(probes: DataFrame, stored: DataFrame, bits: int = 256) -> DataFrame:
    """(left_id, right_id, least, transforms): stored images whose block hash any variant of a probe comes near.

    Both are rows of fingerprint.fingerprints(); ineligible images take no part, nor does an image against itself. The
    distance is the least over the eight variants of the probe, with all transforms tied at it.
    """
    variants = probes.where("eligible").select("id", F.inline("variants"))
    held = stored.where("eligible").select("id", F.col("block_hash").alias("hash"))
    pairs = binary_join(variants, held, "id", "hash", recall_radius(bits), bits, ["transform"])
    return tied_transforms(pairs.where("left_id <> right_id"), ["left_id", "right_id"], "distance", "transform")


def verified_images(probes: DataFrame, stored: DataFrame, tied: DataFrame, bits: int = 256, fine_bits: int = 544) -> DataFrame:
    """(left_id, right_id, fine, block, transform, match_type): the best tied transform of each recalled pair, and its class.

    tied has (left_id, right_id, least, transforms); of the transforms the one with the least fine distance counts, then
    the least block distance, then the first name. Pairs that are neither near nor similar have a null match_type.
    """
    left = probes.where("eligible").select(F.col("id").alias("left_id"), F.inline("variants")).select("left_id", "transform", F.col("fine_hash").alias("left_hash"))
    right = stored.where("eligible").select(F.col("id").alias("right_id"), F.col("fine_hash").alias("right_hash"))
    # Hashes are cut into words once an image, not once a pair.
    left, right = _with_words(left, "left", fine_bits // 8), _with_words(right, "right", fine_bits // 8)
    tried = tied.select("left_id", "right_id", F.col("least").alias("block"), F.explode("transforms").alias("transform"))
    tried = tried.join(left, ["left_id", "transform"]).join(right, "right_id")
    apart = _apart("words", -(-fine_bits // 64)).cast("long")
    best = best_fine(tried.withColumn("fine", apart), ["left_id", "right_id"], "fine", "block", "transform")
    # Recall took eligible images only, so both sides are.
    return best.withColumn("match_type", classify(F.lit(True), F.col("block") / bits, F.col("fine") / fine_bits))


def without_exact(pairs: DataFrame, rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Pairs whose ends differ in every exact key; each end's keys are looked up, no pairs are made."""
    for side in ("left", "right"):
        pairs = pairs.join(rows.select(F.col(id_col).alias(f"{side}_id"), *[F.col(k).alias(f"{side}_{k}") for k in keys]), f"{side}_id")
    same = F.lit(False)
    for k in keys:
        same = same | F.coalesce(F.col(f"left_{k}") == F.col(f"right_{k}"), F.lit(False))
    return pairs.where(~same).drop(*[f"{s}_{k}" for s in ("left", "right") for k in keys])


def tied_transforms(recalled: DataFrame, keys: list[str], distance: str, transform: str) -> DataFrame:
    """Per pair the least distance and all transforms tied at it, in order. Both aggregates combine before they shuffle."""
    tied = recalled.groupBy(*keys, F.col(distance).alias("least")).agg(F.sort_array(F.collect_set(transform)).alias("transforms"))
    return tied.groupBy(*keys).agg(F.min(F.struct("least", "transforms")).alias("m")).select(*keys, "m.*")


def best_fine(tied: DataFrame, keys: list[str], fine: str, block: str, transform: str) -> DataFrame:
    """Per pair the tied transform with the least (fine distance, block distance, name)."""
    return tied.groupBy(*keys).agg(F.min(F.struct(F.col(fine).alias("fine"), F.col(block).alias("block"), F.col(transform).alias("transform"))).alias("m")).select(*keys, "m.*")


def classify(eligible: Column, block_ratio: Column, fine_ratio: Column) -> Column:
    """match_type of perceptual evidence; null for none. Bounds are inclusive."""
    return (
        F.when(~eligible, None)
        .when((block_ratio <= 0.04) & (fine_ratio <= 0.04), "near")
        .when((block_ratio <= 0.12) & (fine_ratio <= 0.08), "similar")
    )


def _nearest(image: str, other: str, distance: str, most: int, held_rows: int):
    def nearest(batches: Iterator) -> Iterator:
        """Of the pairs held, each image's nearest; the first of them tells how many there were."""
        import numpy as np
        import pyarrow as pa

        def kept(held):
            rows = pa.Table.from_batches(held).sort_by([(image, "ascending"), (distance, "ascending"), (other, "ascending")])
            code = rows.column(image).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sizes = np.diff(np.r_[heads, len(rows)])
            place = np.arange(len(rows)) - np.repeat(heads, sizes)
            found = np.where(place == 0, np.repeat(sizes, sizes), 0)
            few = np.flatnonzero(place < most)
            return rows.take(pa.array(few)).append_column("__found", pa.array(found[few], pa.int64())).to_batches()

        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= held_rows:
                yield from kept(held)
                held, n = [], 0
        if held:
            yield from kept(held)

    return nearest


def top_recall(pairs: DataFrame, image: str, other: str, distance: str, most: int = 256, held_rows: int = HELD_PAIRS) -> DataFrame:
    """The nearest `most` of each image, and whether there were more. This is the operator's own report limit.

    Every task first keeps its own nearest of each image, with their number, so an image that a third of all pairs have
    reaches the ranking with `most` rows for every held_rows pairs. Images and distances are not null.
    """
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    near = pairs.mapInArrow(_nearest(image, other, distance, most, held_rows), f"{held}, __found bigint")
    w = Window.partitionBy(image)
    ranked = near.withColumns({"place": F.row_number().over(w.orderBy(distance, other)), "__all": F.sum("__found").over(w)})
    return ranked.where(F.col("place") <= most).withColumn("truncated", F.col("__all") > most).drop("__found", "__all")


def best_per_pair(edges: DataFrame, keys: list[str], priority: Column, order: list[Column]) -> DataFrame:
    """One edge per pair: the strongest, the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(priority, *order)
    return edges.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
