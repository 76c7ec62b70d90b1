"""What one task holds stays bounded: pairs of a cell, images of a batch, files of a stream."""

from __future__ import annotations

import glob
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import fingerprint, near
from tessera.operators.graph import shared_folder
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def test_pairs_of_equal_hashes_go_out_in_parts(monkeypatch):
    monkeypatch.setattr(near, "FOUND_PAIRS", 5000)
    side = lambda own, other: pa.record_batch({f"{own}_id": pa.array(range(1000)), f"{own}_hash": pa.array([7] * 1000), f"{other}_id": pa.nulls(1000, pa.int64()), f"{other}_hash": pa.nulls(1000, pa.int64())})
    names = ["left_id", "left_hash", "right_id", "right_hash"]
    sizes = [len(b) for b in near._compared(0)(iter([side("left", "right").select(names), side("right", "left").select(names)]))]
    assert sum(sizes) == 1_000_000 and max(sizes) <= 5000 + 64 * 1000


def test_equal_hashes_are_dealt_to_many_cells(spark, monkeypatch):
    def sizes(cell):
        n = [len(cell) - cell.column(f"{side}_hash").null_count for side in ("left", "right")]
        return pa.table({"left_id": pa.array(n[:1]), "right_id": pa.array(n[1:]), "distance": pa.array([0])})

    monkeypatch.setattr(near, "_compared", lambda radius: sizes)
    rows = spark.range(1000).select("id", F.lit(5).cast("long").alias("hash"))
    cells = near.ball_join(rows, rows, "id", "hash", 20, block=100).collect()
    assert len(cells) == 100 and max(max(c.left_id, c.right_id) for c in cells) < 200


def test_images_go_through_the_kernels_some_at_a_time():
    rng = np.random.default_rng(3)
    images = pd.DataFrame({"id": range(1300), "width": 8, "height": 8, "pixels": [rng.integers(0, 256, 64, dtype=np.uint8).tobytes() for _ in range(1300)]})
    found = list(fingerprint._fingerprints(iter([images])))
    assert [len(f) for f in found] == [512, 512, 276]
    one = pd.concat(fingerprint._fingerprints(iter([images.iloc[k : k + 1]])).__next__() for k in (0, 511, 512, 1299))
    assert one.equals(pd.concat(found).iloc[[0, 511, 512, 1299]].set_axis([0] * 4))


def test_streams_have_three_batches_of_many_files(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    written = lambda name: set(glob.glob(f"{shared_folder(spark)}/{name}-*/in/*.parquet"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 8000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        before = written("progress")
        assert registry.queries()["streaming_progress"](spark, SF).first().batches == 3
        assert len(written("progress") - before) > 3
        before = written("stream")
        registry.queries()["streaming_exact_components"](spark, SF)
        assert len(written("stream") - before) > 3
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def wide(spark, hashes):
    return spark.createDataFrame([(k, bytearray(h.to_bytes(32, "big"))) for k, h in enumerate(hashes)], "id int, hash binary")


def few_bytes(rng, n):
    """Hashes whose bytes have two values only, as those of small or plain images have few, some of them near others."""
    base = [sum(rng.choice((0x0F, 0xF0)) << 8 * k for k in range(32)) for _ in range(n // 2)]
    return base + [h ^ sum(1 << k for k in rng.sample(range(256), rng.randrange(40))) for h in base]


def near_pairs(left, right, radius):
    return [(a, b, d) for a, x in enumerate(left) for b, y in enumerate(right) if (d := (x ^ y).bit_count()) <= radius]


def test_alike_hashes_are_not_joined_by_bytes(spark, monkeypatch):
    rng = random.Random(5)
    hashes = few_bytes(rng, 300)
    df = wide(spark, hashes)
    monkeypatch.setattr(near, "SQUARE", 70)
    monkeypatch.setattr(near, "STRIP", 1000)
    monkeypatch.setattr(near, "FOUND_PAIRS", 50)
    found = near.binary_join(df, df, "id", "hash", 31, 256)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == near_pairs(hashes, hashes, 31)


def test_lanes_and_squares_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(6)
    hashes = [rng.getrandbits(256) for _ in range(40)]
    hashes += [h ^ sum(1 << k for k in rng.sample(range(256), rng.randrange(36))) for h in hashes for _ in range(3)]
    df, want = wide(spark, hashes), near_pairs(hashes, hashes, 31)
    carried = df.withColumn("name", F.concat(F.lit("x"), F.col("id").cast("string")))
    for dear, joined in ((1, False), (1000, True)):
        monkeypatch.setattr(near, "WIDE_COMPARISON", dear)
        found = near.binary_join(carried, df, "id", "hash", 31, 256, ["name"])
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == joined
        assert sorted((r.left_id, r.right_id, r.distance) for r in found.collect()) == want
        assert found.where(F.col("name") != F.concat(F.lit("x"), F.col("left_id").cast("string"))).count() == 0
    # Values that all hashes share bring all pairs together: lanes are counted, and left.
    same = spark.createDataFrame([(k, bytearray(32)) for k in range(300)], "left_id int, left_hash binary")
    monkeypatch.setattr(near, "WIDE_COMPARISON", 16)
    assert not near.lanes_pay(same, same.toDF("right_id", "right_hash"), 300, 300, 31, 256)
    spread = [(k, bytearray(rng.getrandbits(256).to_bytes(32, "big"))) for k in range(300)]
    spread = spark.createDataFrame(spread, "left_id int, left_hash binary")
    assert near.lanes_pay(spread, spread.toDF("right_id", "right_hash"), 300, 300, 31, 256)


def test_no_hashes_have_no_pairs(spark):
    df, none = wide(spark, [1, 2, 3]), spark.createDataFrame([(7, None), (8, bytearray(31))], "id int, hash binary")
    for a, b in ((df, none), (none, df), (none, none)):
        assert near.binary_join(a, b, "id", "hash", 31, 256).count() == 0


def test_a_lane_takes_a_bit_of_each_row_and_column():
    at = near._scattered(256)
    assert sorted(at.reshape(-1)) == list(range(256))
    assert all(sorted(lane // 16) == sorted(lane % 16) == list(range(16)) for lane in at)
    assert sorted(near._scattered(544).reshape(-1)) == list(range(544))
