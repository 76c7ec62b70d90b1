"""Stored tables changed by buckets, and the indexes that are built on them: every change equals a rebuild."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.component_index import ComponentIndex
from tessera.operators.graph import connected_components
from tessera.operators.lane_index import LaneIndex
from tessera.sources import store as S


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("string").alias("state"))
    made = S.BucketStore(spark, str(tmp_path), rows.schema, ["id"], 16)
    made.append(rows)
    return made


def rows_of(store, version=None):
    return sorted(tuple(r) for r in store.read(version=version).collect())


def test_untouched_buckets_keep_their_files(spark, table):
    before = table.version()
    S.upsert(table, spark.createDataFrame([(5, "new"), (2000, "x")], "id long, state string"))
    after = table.version()
    assert 1 <= len({b for b in after.buckets if after.buckets[b] != before.buckets.get(b)}) <= 2
    want = {k: str(k % 7) for k in range(200)} | {5: "new", 2000: "x"}
    assert rows_of(table) == sorted(want.items())
    assert rows_of(table, before) == [(k, str(k % 7)) for k in range(200)]  # readers of the older version still have it
    assert table.vacuum() == 1 or len(table.folder.names("data")) <= 2
    assert rows_of(table) == sorted(want.items())


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    name, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 40_000
    rows = spark.range(60_000).repartition(8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    made = S.BucketStore(spark, str(tmp_path), rows.schema, ["part"], 8)
    spark.conf.set(name, str(size))
    try:
        got = made.append(rows)
    finally:
        spark.conf.unset(name)
    assert got.counts == {"rows": 60_000}
    hot = spark.range(1).select(made.bucket_of([F.lit(7).cast("long")])).first()[0]
    at = made.version(0)
    files = [n for n in made.folder.names(f"data/{at.buckets[hot][0]}/{S.BUCKET}={hot}") if n.endswith(".parquet")]
    assert len(files) > 1
    assert made.read().count() == 60_000 and made.read().where("part = 7").count() == 20_001  # 7 itself too


def test_upgrade_keeps_the_stored_row_of_equals(spark, table):
    order = F.col("state").cast("int")
    S.upgrade(table, spark.createDataFrame([(6, "1"), (5, "5"), (5, "9"), (300, "4"), (300, "2")], "id long, state string"), order)
    got = dict(rows_of(table))
    assert (got[6], got[5], got[300], len(got)) == ("1", "5", "2", 201)


def test_guarded_update_decides_in_the_writing_pass(spark, table):
    keys = spark.range(10)
    before, files = rows_of(table), table.folder.names("data")
    out = S.guarded_update(table, keys, "state", F.col("state") != "3", F.lit("done"), {"odd": F.col("__hit") & (F.col("id") == 4)})
    assert (out.published, out.counts["affected"], out.counts["odd"]) == (False, 9, 1)
    assert rows_of(table) == before and table.folder.names("data") == files  # a violating batch leaves nothing behind
    assert not S.guarded_update(table, keys, "state", F.col("state") != "3", F.lit("done"), expected=10).published
    out = S.guarded_update(table, keys, "state", F.col("state") != "3", F.lit("done"), {"null": F.col("state").isNull()}, expected=9)
    assert out.published and rows_of(table) == [(k, "done" if k < 10 and k % 7 != 3 else str(k % 7)) for k in range(200)]
    assert S.guarded_update(table, spark.range(5000, 5002), "state", F.lit(True), F.lit("x")).counts["affected"] == 0


def test_the_slower_writer_loses(spark, table):
    base = table.version()
    staged, got, _ = table.stage(spark.createDataFrame([(1000, "mine")], "id long, state string"))
    table.append(spark.createDataFrame([(1001, "theirs")], "id long, state string"))
    with pytest.raises(S.Conflict):
        table.publish(base, staged, got, got, False)
    table.discard(staged)
    assert dict(rows_of(table)).get(1000) is None and dict(rows_of(table))[1001] == "theirs"


def test_remove_compact_and_strays(spark, table):
    for k in range(4):
        table.append(spark.createDataFrame([(500 + k, "a"), (600 + k, "b")], "id long, state string"))
    S.remove(table, spark.createDataFrame([(501,), (7,)], "id long"))
    want = rows_of(table)
    assert table.compact(0) is not None and all(len(f) == 1 for f in table.version().buckets.values())
    assert rows_of(table) == want and (501, "a") not in want and (7, "0") not in want
    assert table.compact(1) is None
    with pytest.raises(ValueError, match="buckets"):
        table.change(spark.createDataFrame([(1,)], "id long"), lambda old: spark.range(200).select("id", F.lit("z").alias("state")))
    assert rows_of(table) == want


def flipped(rng, h, most):
    return h ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(most)))


def test_lane_index_equals_a_rebuild(spark, tmp_path):
    """Random inserts, updates and removals: recall as over an index made anew, and as over all pairs."""
    rng = random.Random(11)
    centres = [rng.getrandbits(256) for _ in range(6)]
    as_rows = lambda hashes: spark.createDataFrame([(k, None if h is None else bytearray(h.to_bytes(32, "big"))) for k, h in hashes.items()], "id long, hash binary")
    index, held = LaneIndex(spark, str(tmp_path / "kept"), 32, buckets=32), {}
    assert index.near(as_rows({1: 5}), 31).count() == 0
    for _ in range(4):
        batch = {k: (None if rng.random() < 0.1 else flipped(rng, rng.choice(centres), 24)) for k in rng.sample(range(60), 20)}
        batch |= {k: held[k] for k in rng.sample(sorted(held), min(5, len(held)))}
        want = {"inserted": len(batch.keys() - held.keys()), "unchanged": sum(k in held and held[k] == h for k, h in batch.items())}
        got = index.upsert(as_rows(batch).unionByName(as_rows(batch)))
        assert got == want | {"updated": len(batch) - sum(want.values())}
        held |= batch
        gone = rng.sample(sorted(held), 4)
        assert index.remove(spark.createDataFrame([(k,) for k in [*gone, 999]], "id long")) == 4
        for k in gone:
            del held[k]
    probes = {k: flipped(rng, c, 20) for k, c in enumerate(centres)}
    found = sorted((r.left_id, r.right_id, r.distance) for r in index.near(as_rows(probes), 31).collect())
    assert found == sorted((a, b, d) for a, x in probes.items() for b, y in held.items() if y is not None and (d := (x ^ y).bit_count()) <= 31) and found
    anew = LaneIndex(spark, str(tmp_path / "anew"), 32, buckets=32)
    anew.upsert(as_rows(held))
    assert found == sorted((r.left_id, r.right_id, r.distance) for r in anew.near(as_rows(probes), 31).collect())
    # What is there already is not written again, and a contradictory batch changes nothing.
    version = index.rows.version().number
    assert index.upsert(as_rows(held)) == {"inserted": 0, "unchanged": len(held), "updated": 0} and index.rows.version().number == version
    with pytest.raises(ValueError, match="conflicting"):
        index.upsert(as_rows({1: 5}).unionByName(as_rows({1: 6})))
    assert index.rows.version().number == version
    # A writer that failed between the two stores left postings that never show.
    index.postings.append(spark.createDataFrame([(0, 0, 77, bytearray(32), True, 999)], index.postings.schema))
    assert 77 not in {r.right_id for r in index.near(as_rows({0: 0}), 31).collect()}
    index.upsert(as_rows({900: centres[0]}))
    assert 77 not in {r.right_id for r in index.near(as_rows({0: 0}), 31).collect()}
    assert 900 in {r.right_id for r in index.near(as_rows(probes), 31).collect()}


def test_many_probes_leave_postings_aside(spark, tmp_path, monkeypatch):
    """Many probes meet the stored hashes, few the postings of their lanes; both find what all pairs give, of the last version."""
    from tessera.operators import lane_index

    rng = random.Random(12)
    centres = [rng.getrandbits(256) for _ in range(5)]
    as_rows = lambda hashes: spark.createDataFrame([(k, bytearray(h.to_bytes(32, "big"))) for k, h in hashes.items()], "id long, hash binary")
    held = {k: flipped(rng, rng.choice(centres), 30) for k in range(40)}
    index = LaneIndex(spark, str(tmp_path / "kept"), 32, buckets=4)
    index.upsert(as_rows(held | {k: rng.getrandbits(256) for k in range(0, 40, 3)}))
    index.upsert(as_rows(held))
    index.remove(spark.range(0, 40, 8))
    probes = {100 + k: flipped(rng, c, 10) for k, c in enumerate(centres)}
    want = sorted((a, "n", b, d) for a, x in probes.items() for b, y in held.items() if b % 8 and (d := (x ^ y).bit_count()) <= 31)
    near = lambda: sorted(map(tuple, index.near(as_rows(probes).withColumn("note", F.lit("n")), 31, ["note"]).collect()))
    monkeypatch.setattr(lane_index, "MANY_PROBES", 1 << 30)
    assert near() == want and len(want) > 20
    monkeypatch.setattr(lane_index, "MANY_PROBES", 50)
    monkeypatch.setattr(index.postings, "read", lambda *a: pytest.fail("read postings"))
    assert near() == want


def test_components_after_random_edits(spark, tmp_path):
    rng = random.Random(4)
    index, held = ComponentIndex(spark, str(tmp_path), buckets=32), set()
    frame = lambda edges: spark.createDataFrame(sorted(edges), "a long, b long")
    for step in range(5):
        removed = set(rng.sample(sorted(held), len(held) // 4))
        added = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(8)}
        index.change(frame(added | {(3, 3)}), frame({(b, a) for a, b in removed} | {(1000, 1001)}) if step else None)
        held = (held - removed) | added
        want = {(r.node, r.component) for r in connected_components(frame(held)).collect()}
        assert {(r.node, r.component) for r in index.components().collect()} == want
    index.change(frame({(5, 6)}), frame(held))
    assert {(r.node, r.component) for r in index.components().collect()} == {(5, 5), (6, 5)}


def test_components_read_what_they_touch(spark, tmp_path):
    index = ComponentIndex(spark, str(tmp_path), buckets=64)
    chains = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 400).alias("b"))
    index.change(chains)
    before = {n: s.version().buckets for n, s in (("edges", index.edges), ("labels", index.labels))}
    told = index.change(spark.createDataFrame([(3, 4)], "a long, b long"), spark.createDataFrame([(9, 409)], "a long, b long"))
    assert told["nodes"] == 6 and told["components_before"] == 3 and told["edge_buckets"] <= 6
    for name, store in (("edges", index.edges), ("labels", index.labels)):
        now = store.version().buckets
        assert sum(now.get(b) != f for b, f in before[name].items()) <= 6
    got = {r.node: r.component for r in index.components().where("node IN (3, 4, 403, 404, 9, 409, 10)").collect()}
    assert got == {3: 3, 4: 3, 403: 3, 404: 3, 10: 10}


def test_tree_written_by_many_tasks_and_forced_once_each(spark, tmp_path):
    """Rows of one partition are dealt to all cores, and a task forces its files to disk together."""
    from contextlib import contextmanager

    from tessera.sources import tree_source

    rows = spark.range(0, 400, 1, 1).selectExpr("concat('d', id % 3, '/f', id) AS relative_path", "cast(id AS string) AS text").select("relative_path", F.col("text").cast("binary").alias("content"))
    spark.sparkContext.setJobGroup("tree-write", "")
    try:
        tree_source.write_tree(rows, str(tmp_path / "tree"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("tree-write") for s in told.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= spark.sparkContext.defaultParallelism
    assert tree_source.entries(spark, str(tmp_path / "tree")).where("kind = 'file'").count() == 400

    forced = []

    class Told(tree_source.Local):
        @contextmanager
        def forced(self, folder):
            with super().forced(folder):
                yield
            forced.append(sorted(p for p, kind, _, _ in self.entries(f"{folder}/d") if kind == tree_source.FILE))

    writer = tree_source.TreeWriter({"path": str(tmp_path / "one")}, rows.schema)
    writer._parent = lambda: (Told(str(tmp_path)), "one")
    assert writer.write(iter([(f"d/{k}", b"x") for k in range(50)])).files == 50
    assert [len(f) for f in forced] == [50] and not any(p.endswith(".part") for p in forced[0])
