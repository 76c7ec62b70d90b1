"""Operators on small cases whose outcome is known: graphs, groups, Hamming joins, merges, paths, state machines, files."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import expr as X
from tessera.functions import paths
from tessera.functions import states as S
from tessera.operators import cover, fingerprint, graph, matching, merge, near, paging, planning, verify
from tessera.sources import files, sinks, tree_source


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components_of_chains_and_cliques(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + list(itertools.combinations(range(100, 106), 2)) + [(200, 200), (301, 300)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 106)} | {300: 300, 301: 300}
    assert got == want


def test_components_of_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representative_prefers_library_then_identical_then_lowest(spark):
    data = [(1, 10, False, True), (1, 11, True, False), (1, 12, True, True), (2, 20, False, False), (2, 21, False, True), (3, 31, False, False), (3, 30, False, False)]
    members = spark.createDataFrame(data, "g int, id int, lib boolean, same boolean")
    got = graph.representatives(members, "g", "id", F.col("lib"), F.col("same"))
    assert rows(got.select("g", "representative")) == [(1, 12), (2, 21), (3, 30)]


def test_initial_action_table(spark):
    data = [(lib, manual, group, rep) for lib in (True, False) for manual in (True, False) for group in (True, False) for rep in (True, False)]
    df = spark.createDataFrame(data, "lib boolean, manual boolean, grp boolean, rep boolean")
    for r in df.withColumn("x", graph.initial_action(F.col("lib"), F.col("manual"), F.col("grp"), F.col("rep"))).collect():
        assert r.x == ("keep" if r.lib or r.manual or (not r.grp and r.rep) else "exclude")


def test_group_reconciliation_by_signature(spark):
    old = spark.createDataFrame([("a", "s1"), ("b", "s2")], "group_id string, signature string")
    new = spark.createDataFrame([("c", "s2"), ("d", "s3")], "group_id string, signature string")
    assert rows(graph.reconcile_groups(old, new)) == sorted([("s1", "a", None, "delete"), ("s2", "b", "c", "keep"), ("s3", None, "d", "insert")], key=repr)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_lane_join_is_exact(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(30)]
    for h in list(base):
        for flips in (1, 3, 6, 9):
            for bit in rng.sample(range(63), flips):
                h ^= 1 << bit
            base.append(h)
    df = spark.createDataFrame(list(enumerate(base)), "id long, hash long")
    got = {(r.left_id, r.right_id): r.distance for r in near.lane_join(df, df, "id", "hash", radius, 63).collect()}
    want = {(i, j): (a ^ b).bit_count() for i, a in enumerate(base) for j, b in enumerate(base) if (a ^ b).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("radius", [8, 20, 22])
@pytest.mark.parametrize(("block", "balls"), [(4096, 64), (7, 5), (16, 64)])
def test_ball_join_is_exact(spark, radius, block, balls):
    """Any cut into balls and squares gives all pairs once, and no square has many more rows than its block."""
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(40)]
    base += [h ^ sum(1 << b for b in rng.sample(range(63), k % 30)) for k, h in enumerate(base)] + base[:3]
    df = spark.createDataFrame([*enumerate(base), (999, None)], "id long, hash long")
    got = sorted((r.left_id, r.right_id, r.distance) for r in near.ball_join(df.where("id % 3 > 0 OR id = 999"), df, "id", "hash", radius, block, balls).collect())
    assert got == sorted((i, j, d) for i, a in enumerate(base) if i % 3 for j, b in enumerate(base) if (d := (a ^ b).bit_count()) <= radius)
    assert near.ball_join(df.where("false"), df, "id", "hash", radius).count() == near.ball_join(df, df.where("false"), "id", "hash", radius).count() == 0


def test_balls_tell_far_clusters_apart(spark):
    """Where hashes lie in clusters, a left hash meets its own cluster's squares only."""
    rng = random.Random(2)
    centres = [0, (1 << 62) - 1, int("10" * 31, 2)]
    near_ = lambda c: c ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(4)))
    df = spark.createDataFrame([(k, near_(centres[k % 3])) for k in range(300)], "id long, hash long")
    joined = near.ball_join(df, df, "id", "hash", 8, block=100, most_balls=3)
    assert joined.count() == 3 * 100 * 100


@pytest.mark.parametrize("held", [1, 10, 1000])
def test_top_recall_keeps_the_nearest(spark, held):
    rng = random.Random(held)
    pairs = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randrange(5)) for k in range(400)]
    df = spark.createDataFrame(pairs, "image int, other int, distance int").repartition(3)
    got = sorted((r.image, r.other, r.place, r.truncated) for r in near.top_recall(df, "image", "other", "distance", 7, held).collect())
    want = []
    for image in (1, 2, 3):
        own = sorted((d, o) for i, o, d in pairs if i == image)
        want += [(image, o, k + 1, len(own) > 7) for k, (_, o) in enumerate(own[:7])]
    assert got == sorted(want)


def test_radius_join_in_blocks_is_exact(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(20) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(base)), "id long, hash long")
    got = {(r.left_id, r.right_id) for r in near.radius_join(df, df, "id", "hash", 12, 63).collect()}
    assert got == {(i, j) for i, a in enumerate(base) for j, b in enumerate(base) if (a ^ b).bit_count() <= 12}


@pytest.mark.parametrize("radius", [6, 20, 22])
@pytest.mark.parametrize("lanes", [None, 2, 3, 5, 9])
def test_probed_lanes_are_exact(spark, radius, lanes):
    """However many lanes: what lanes miss by their value, flipped bits find."""
    rng = random.Random(radius)
    base = [rng.getrandbits(24) for _ in range(40)]
    base += [h ^ sum(1 << b for b in rng.sample(range(24), k % 12)) for k, h in enumerate(base)]
    df = spark.createDataFrame(list(enumerate(base)), "id long, hash long")
    radius = radius // 3  # of 24 bits here
    rows = near.radius_join(df, df, "id", "hash", radius, 24) if lanes is None else near.lane_join(df, df, "id", "hash", radius, 24, lanes)
    got = [(r.left_id, r.right_id, r.distance) for r in rows.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(base) for j, b in enumerate(base) if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("radius", [6, 20, 22])
def test_radius_join_of_63_bits_is_exact(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(63) for _ in range(60)]
    base += [h ^ sum(1 << b for b in rng.sample(range(63), k % 30)) for k, h in enumerate(base)]
    df = spark.createDataFrame(list(enumerate(base)), "id long, hash long")
    got = sorted((r.left_id, r.right_id) for r in near.radius_join(df, df, "id", "hash", radius, 63).collect())
    assert got == sorted((i, j) for i, a in enumerate(base) for j, b in enumerate(base) if (a ^ b).bit_count() <= radius)


def test_lane_plan_follows_sizes():
    """Few rows are compared; many go by lanes with flipped bits; a wide radius stays with blocks of its own number."""
    assert near.lane_plan(50, 50, 8, 63) is None
    many = near.lane_plan(10**7, 10**7, 8, 63)
    assert many is not None and many < 9
    assert near.lane_plan(10**5, 10**5, 6, 63) is not None


def test_library_classes_tell_every_pair(spark):
    """Hot content: n x m pairs are one edge between classes and n + m memberships."""
    from tessera.operators.exact import content_classes, library_class_edges, library_edges

    rows = [(k, "same", 4, "p") for k in range(60)] + [(100, "other", 5, "p"), (101, None, None, "p"), (102, "x", 1, None), (103, "x", 1, None), (104, None, None, None)]
    df = spark.createDataFrame(rows, "id long, h string, n long, p string")
    left, right = df.where("id % 2 = 1"), df.where("id % 2 = 0")
    edges = library_class_edges(left, right, "id", ["n", "h"], "p")
    assert {(r.image, r.library, r.match_type) for r in edges.collect()} == {(1, 0, "file_exact"), (1, 100, "pixel_exact"), (101, 0, "pixel_exact"), (101, 100, "pixel_exact"), (103, 102, "file_exact")}
    assert library_edges(left, right, "id", ["n", "h"], "p").count() == 30 * 30 + 30 + 30 + 1 + 1
    assert content_classes(right, "id", ["n", "h"], "p")[1].count() == right.count()


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    """Stopped after a batch and started by a new index on the same checkpoint: the same components as one batch."""
    from tessera.streaming.incremental import ExactIndex, detect_stream

    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    schema = spark.createDataFrame([], "id long, key string").schema
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: detect_stream(spark, source, schema, "id", {"content": "key"}, checkpoint)
    add((5, "a"), (2, "a"), (9, "b"), (7, None))
    assert {tuple(r) for r in run().edges().collect()} == {(5, 2)}
    add((3, "a"), (8, "b"))
    index = run()
    assert {tuple(r) for r in index.edges().collect()} == {(5, 2), (3, 2), (9, 8)}
    assert {(r.content, r.id) for r in index.representatives().collect()} == {("a", 2), ("b", 8)}
    add((1, "a"))
    index = run()
    found = {r.node: r.component for r in graph.connected_components(index.edges(), "id", "rep").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 1, 8: 8, 9: 8}
    # A batch that is told twice changes nothing, and compaction neither.
    keyed = spark.createDataFrame([(1, "a")], "id long, content string")
    before = sorted(map(tuple, index.edges().collect()))
    index.merge(keyed, 2)
    assert sorted(map(tuple, index.edges().collect())) == before
    for k in range(3, 9):
        index.merge(spark.createDataFrame([(100 + k, f"k{k % 3}")], "id long, content string"), k)
    again = ExactIndex(spark, "id", ["content"], keyed.schema, f"{checkpoint}-index")
    assert {(r.content, r.id) for r in again.representatives().collect()} == {("a", 1), ("b", 8), ("k0", 103), ("k1", 104), ("k2", 105)}
    # A batch touches the buckets of its own keys; others keep their files, and old parts go.
    held = dict(again._known.version().buckets)
    again.merge(spark.createDataFrame([(500, "k1")], "id long, content string"), 9)
    changed = {b for b, f in again._known.version().buckets.items() if held.get(b) != f}
    assert len(changed) == 1 and len(again._known.folder.names("data")) <= 9


def test_classification_bounds_are_inclusive(spark):
    data = [(True, 0.04, 0.04, "near"), (True, 0.0401, 0.04, "similar"), (True, 0.12, 0.08, "similar"), (True, 0.12, 0.0801, None), (True, 0.1201, 0.01, None), (False, 0.0, 0.0, None)]
    df = spark.createDataFrame(data, "ok boolean, b double, f double, want string")
    assert df.where(~near.classify(F.col("ok"), F.col("b"), F.col("f")).eqNullSafe(F.col("want"))).count() == 0


def test_binary_lanes_and_hamming(spark):
    rng = random.Random(2)
    a, b = rng.randbytes(68), rng.randbytes(68)
    df = spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary")
    want = sum((x ^ y).bit_count() for x, y in zip(a, b))
    assert df.select(X.hamming(X.binary_lanes(F.col("a"), 68), X.binary_lanes(F.col("b"), 68))).first()[0] == want
    assert (X.recall_radius(256), X.recall_radius(64)) == (31, 8)


def test_merges_keep_the_documented_row(spark):
    old = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "k int, v string, p int")
    new = spark.createDataFrame([(2, "new", 0), (1, "new", 1), (3, "b", 5), (3, "a", 5)], "k int, v string, p int")
    assert rows(merge.insert_or_ignore(old, new, ["k"], [F.col("v")])) == [(1, "old", 1), (2, "old", 1), (3, "a", 5)]
    assert rows(merge.upgrade(old, new.where("v <> 'b'"), ["k"], F.col("p"))) == [(1, "old", 1), (2, "new", 0), (3, "a", 5)]
    assert rows(merge.upsert(old, new.where("k < 3"), ["k"])) == [(1, "new", 1), (2, "new", 0)]
    assert rows(merge.insert_once(old, new.where("v <> 'b'"), ["k"], ["p"]).select("k", "verdict")) == [(1, "same"), (2, "conflict"), (3, "inserted")]


def test_reconcile_reports_every_error_of_a_key(spark):
    s = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, None)], "k int, size int, hash string")
    a = spark.createDataFrame([(2, 6, "c"), (3, 5, None), (4, 1, "z")], "k int, size int, hash string")
    assert rows(verify.reconcile(s, a, "k", ["size", "hash"])) == sorted([(1, "missing"), (2, "hash_mismatch"), (2, "size_mismatch"), (4, "extra")], key=repr)


def test_fingerprint_ignores_order_but_not_repetition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    f = lambda d: tuple(verify.table_fingerprint(d, ["k", "v"]).first())
    assert f(df) == f(df.orderBy(F.desc("k"))) and f(df) != f(df.union(df)) and f(df) != f(df.na.fill("", ["v"]))
    assert f(df.where("false"))[0] == 0


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_merkle_digest_is_of_the_multiset(spark, depth):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t")).repartition(7)
    f = lambda d: {r.g: (r.hash, r.rows) for r in verify.merkle(d, ["g"], F.col("t"), depth).collect()}
    assert f(df) == f(df.orderBy(F.desc("t"))) and len(set(f(df).values())) == 2
    assert f(df)[0] != f(df.where("NOT (g = 0 AND t = '2')"))[0]


def test_length_prefix_tells_fields_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert df.select(verify.length_prefixed(F.col("x"), F.col("y"))).distinct().count() == 2


def test_matchings_equal_brute_force(spark):
    """Many random graphs at once, sparse and dense, some of which need long augmenting paths."""
    rng = random.Random(12)
    graphs = {k: {(rng.randrange(6), 10 + rng.randrange(6)) for _ in range(rng.choice([2, 6, 9, 14]))} for k in range(60)}
    # A path that only augmenting by its whole length completes: every left node but the last likes its left neighbour's.
    graphs[100] = {(k, 100 + k) for k in range(12)} | {(k, 101 + k) for k in range(11)}
    graphs[101] = {(k, 100 + k) for k in range(11)} | {(k + 1, 100 + k) for k in range(11)}
    graphs[102] = {(k, 500) for k in range(40)} | {(k, 501) for k in range(3)}
    edges = [(g, a, b) for g, pairs in graphs.items() for a, b in pairs]
    found = matching.maximum_matching(spark.createDataFrame(edges + edges[:9], "graph int, left int, right int")).collect()
    for g, pairs in graphs.items():
        own = [(r.left, r.right) for r in found if r.graph == g]
        assert set(own) <= pairs and len({a for a, _ in own}) == len({b for _, b in own}) == len(own)
        of: dict = {}

        def augment(a, tried):
            for b in [y for x, y in pairs if x == a and y not in tried]:
                tried.add(b)
                if b not in of or augment(of[b], tried):
                    of[b] = a
                    return True
            return False

        assert len(own) == sum(augment(a, set()) for a in {a for a, _ in pairs})
    assert matching.maximum_matching(spark.createDataFrame([], "graph int, left int, right int")).count() == 0


def test_reconcile_keeps_what_was_decided(spark):
    """Same members: id, state and user decisions stay; changed members: a new group that inherits what users decided."""
    stored = spark.createDataFrame([("s1", "submitted", True), ("s2", "pending", True), ("s3", "resolved", False), ("s4", "submitted", False), ("s5", "submitted", True)], "group_id string, state string, manual boolean")
    old = [("s1", 1, "exclude", "user"), ("s1", 2, "keep", "automatic"), ("s2", 3, "exclude", "user"), ("s2", 4, "exclude", "user"), ("s3", 5, "keep", "automatic"), ("s3", 6, "keep", "automatic"), ("s4", 7, "keep", "user"), ("s4", 8, "keep", "automatic"), ("s5", 9, "keep", "user"), ("s5", 10, "keep", "automatic")]
    stored_members = spark.createDataFrame([(g, "import", i, a, d) for g, i, a, d in old], "group_id string, source string, image long, action string, decided_by string")
    fresh = spark.createDataFrame([("f1", True, 1), ("f2", False, 3), ("f3", False, 5), ("f4", True, 7), ("f6", True, 20)], "group_id string, manual boolean, representative long")
    new = [("f1", 1, "keep"), ("f1", 2, "exclude"), ("f2", 3, "exclude"), ("f2", 4, "exclude"), ("f2", 11, "exclude"), ("f3", 5, "keep"), ("f3", 6, "exclude"), ("f4", 7, "exclude"), ("f4", 8, "exclude"), ("f6", 20, "keep"), ("f6", 9, "exclude")]
    fresh_members = spark.createDataFrame([(g, "import", i, a) for g, i, a in new], "group_id string, source string, image long, initial string")
    groups, members = graph.reconciled_review(stored, stored_members, fresh, fresh_members)
    assert rows(groups) == [("new:f2", "resolved", False), ("new:f6", "pending", True), ("s1", "submitted", True), ("s3", "resolved", False), ("s4", "pending", True)]
    assert rows(members.select("group_id", "image", "action", "decided_by")) == sorted(
        [
            ("s1", 1, "exclude", "user"), ("s1", 2, "exclude", "automatic"), ("s3", 5, "keep", "automatic"), ("s3", 6, "exclude", "automatic"), ("s4", 7, "keep", "user"), ("s4", 8, "exclude", "automatic"),
            ("new:f2", 3, "keep", "automatic"), ("new:f2", 4, "exclude", "user"), ("new:f2", 11, "exclude", "automatic"), ("new:f6", 20, "keep", "automatic"), ("new:f6", 9, "keep", "user"),
        ],
        key=repr,
    )


def test_covered_albums(spark):
    images = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "d"), (7, "d")], "id int, album string")
    edges = spark.createDataFrame([(1, 3), (4, 6), (5, 7), (1, 4)], "a int, b int")
    assert rows(cover.covered_albums(edges, images, "id", "album")) == [("b",), ("d",)]


def test_covered_by_content_equals_matching(spark):
    rng = random.Random(4)
    data = [(k, f"al{rng.randrange(25)}", rng.choice("aabcdefghij")) for k in range(70)]
    images = spark.createDataFrame(data, "id int, album string, h string")
    keys = images.select("h", F.col("id").alias("a"))
    edges = keys.join(keys.withColumnRenamed("a", "b"), "h").where("a < b")
    want = rows(cover.covered_albums(edges, images, "id", "album"))
    assert rows(cover.covered_by_content(images, "album", "h")) == want and want


def test_plan_edit_and_rollup(spark):
    images = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5), (4, "c", 1)], "id long, album string, size long")
    gone = spark.createDataFrame([(3,), (9,)], "id long")
    kept = planning.plan_images(images, gone, "id", F.col("size") > 1)
    assert rows(planning.plan_rollup(images, kept, "id", "album", "size")) == [("a", 2, 2, 0, 30, True), ("b", 1, 0, 1, 0, False), ("c", 1, 0, 1, 0, False)]
    back = planning.edited(kept, images, "id", "album", spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(3,), (2,)], "id long"))
    assert rows(back.select("id")) == [(2,), (3,)]


PATHS = {
    "a/./b.png": ("a/b.png", None), "a\\b": ("a/b", None), "../x": (None, "escapes its root"), "/abs": (None, "absolute"), "C:/x": (None, "drive prefix"),
    ".": (None, "empty"), "": (None, "empty"), "a/con.txt": (None, "reserved name"), "lpt9": (None, "reserved name"), "a /b": (None, "ends with space or dot"),
    "a./b": (None, "ends with space or dot"), "x" * 241: (None, "component too long"), "/".join(["y" * 200] * 3): (None, "too long"), "console/a": ("console/a", None),
}


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = {r.p: (r.n, r.f) for r in df.select("p", paths.normal_path(F.col("p")).alias("n"), paths.path_fault(F.col("p")).alias("f")).collect()}
    assert got == PATHS
    keys = spark.createDataFrame([("\u00c9a",), ("E\u0301A",), ("\u00e9a",), (None,)], "p string").select(paths.conflict_key(F.col("p")).alias("k"))
    assert keys.where("k IS NOT NULL").distinct().count() == 1


def test_every_transition(spark):
    for transitions, states in ((schemas.RUN_TRANSITIONS, schemas.RUN_STATES), (schemas.FILE_TRANSITIONS, schemas.FILE_STATES), (schemas.TRANSACTION_TRANSITIONS, schemas.TRANSACTION_STATES)):
        table = {(r.state, r.action): r.next_state for r in S.transition_table(spark, transitions, states).collect()}
        actions = sorted({a for _, a, _ in transitions}) + ["unknown"]
        df = spark.createDataFrame([(s, a) for s in states for a in actions], "s string, a string").withColumn("n", S.next_state(F.col("s"), F.col("a"), transitions))
        for r in df.collect():
            assert r.n == table.get((r.s, r.a))


def test_recovery_bytes_and_verdicts(spark):
    df = spark.createDataFrame([("planned", 5), ("published", 5)], "s string, n long")
    assert rows(df.select(S.recovery_write_bytes(F.col("s"), F.col("n")))) == [(0,), (1024 * 1024 + 5,)]
    facts = spark.createDataFrame([(1, 1, 1, "cancelled"), (0, 1, 1, "failed"), (0, 0, 1, "review_required"), (0, 0, 0, "ready_to_commit")], "u int, f int, p int, w string")
    assert facts.where(S.scan_verdict(F.col("u"), F.col("f"), F.col("p")) != F.col("w")).count() == 0


def test_paging_never_repeats_or_omits(spark):
    data = [(k % 7, f"n{k % 3}", k) for k in range(120)]
    df = spark.createDataFrame(data, "a int, b string, k int")
    order = [("a", True), ("b", False), ("k", False)]
    seen, after = [], None
    while True:
        got = [tuple(r) for r in paging.page(df, order, 17, after).collect()]
        seen += got[:17]
        if len(got) <= 17:
            break
        cursor = paging.encode_cursor("albums", dict(zip("abk", got[16])))
        after = tuple(paging.decode_cursor(cursor, "albums").values())
    assert seen == sorted(data, key=lambda r: (-r[0], r[1], r[2]))


@pytest.mark.parametrize("bad", ["%%%", "x" * 5000, paging.encode_cursor("images", {"k": 1}), paging.encode_cursor("albums", {"k": 1}, "other")])
def test_cursors_are_checked(bad):
    with pytest.raises(ValueError):
        paging.decode_cursor(bad, "albums")
    with pytest.raises(ValueError):
        paging.page(None, [], 0)


def test_redaction(spark):
    text = "open postgres://me:pw@host/db password=abc, token: x; see C:\\a\\b.txt and photo.PNG or \\\\srv\\s fine"
    got = spark.createDataFrame([(text,)], "t string").select(X.redacted(F.col("t"))).first()[0]
    assert got == "open postgres://<redacted>@host/db password=<redacted>, token:<redacted> x; see <redacted-path> and <redacted-path> or <redacted-path> fine"
    out = sinks.diagnostics(spark.createDataFrame([("api_token", "zzz"), ("log_path", "/x"), ("note", "ok")], "k string, v string"), "k", "v").first()[0]
    assert out == '{"api_token":"<redacted>","log_path":"<redacted-path>","note":"ok"}'


def test_tree_images_snapshot_and_manifest(spark, tmp_path):
    (tmp_path / "b" / "deep").mkdir(parents=True)
    (tmp_path / "a").mkdir()
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    (tmp_path / "a" / "x.PNG").write_bytes(png)
    (tmp_path / "b" / "deep" / "y.jpeg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x08\x08\x00\x05\x00\x06")
    (tmp_path / "b" / "n.txt").write_text("no")
    root = str(tmp_path)
    assert rows(files.albums(spark, root).select("album", "files")) == [("a", 1), ("b", 2)]
    assert [r.relative_path for r in files.images(spark, root).collect()] == ["a/x.PNG", "b/deep/y.jpeg"]
    assert files.snapshot(spark, root).where("length(hash) = 64").count() == 3
    assert rows(files.dimensions(spark, root).select("relative_path", "width", "height")) == [("a/x.PNG", 7, 9), ("b/deep/y.jpeg", 6, 5)]
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "none" / "deeper").mkdir(parents=True)
    os.mkfifo(tmp_path / "b" / "pipe")
    assert rows(files.rejected(spark, root)) == [("b/pipe", "special"), ("link", "link")]
    assert rows(files.albums(spark, root).select("album", "files")) == [("a", 1), ("b", 2), ("none", 0)]
    assert files.snapshot(spark, root).where("hash IS NULL").count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text('{"version":1,"album":"a","files":[{"path":"x","size":3,"hash":"h"}]}')
    got = files.manifests(spark, str(tmp_path / "m")).first()
    assert got.manifest.files[0].size == 3 and len(got.raw_hash) == 64


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_trees_are_walked_once_at_any_cut(spark, tmp_path, levels):
    want = []
    for k in range(12):
        path = tmp_path / f"a{k % 2}" / f"b{k % 3}" / f"c{k}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(str(k))
        want.append(str(path.relative_to(tmp_path)))
    (tmp_path / "top.txt").write_text("t")
    found = tree_source.entries(spark, str(tmp_path), levels=levels)
    assert sorted(r.relative_path for r in found.where("kind = 'file'").collect()) == sorted([*want, "top.txt"])
    assert found.where("kind = 'folder'").count() == 2 + 6


def test_reads_do_not_grow_with_files(spark, tmp_path):
    """Sizes and last lines cost the same of short and long files; a digest reads all."""
    head = b"\xff\xd8" + b"\xff\xe1\xff\xfe" + bytes(65532) + b"\xff\xe2\xff\xfe" + bytes(65532) + b"\xff\xc0\x00\x11\x08\x00\x05\x00\x06"
    (tmp_path / "short.jpg").write_bytes(head)
    (tmp_path / "long.jpg").write_bytes(head + bytes(3_000_000))
    read = {r.relative_path: (r.width, r.height, r.bytes_read) for r in files.dimensions(spark, str(tmp_path)).collect()}
    assert read["long.jpg"] == read["short.jpg"] == (6, 5, 57)
    text = "".join(f"line {k}\r\n" for k in range(200_000))
    (tmp_path / "long.txt").write_text(text)
    (tmp_path / "cut.txt").write_text("é" * 50_000 + "\nend")
    (tmp_path / "none.txt").write_text("")
    tails = {r.relative_path: r for r in tree_source.entries(spark, str(tmp_path), "tail", lines=3).collect()}
    assert tails["long.txt"].lines == ["line 199997", "line 199998", "line 199999"] and tails["long.txt"].bytes_read <= 1 << 15
    assert tails["cut.txt"].lines == ["é" * 50_000, "end"] and tails["none.txt"].lines == []
    assert {r.relative_path: r.bytes_read for r in tree_source.entries(spark, str(tmp_path), "sha256").collect()}["long.txt"] == len(text)


def test_copies_are_whole_or_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("d%s/f%s", F.col("id") % 4, "id").alias("relative_path"), F.repeat(F.col("id").cast("string"), 1000).cast("binary").alias("content")).repartition(4)
    tree_source.write_tree(rows, str(tmp_path / "tree"))
    plan = tree_source.entries(spark, str(tmp_path / "tree"), "sha256").where("kind = 'file'").select("relative_path", F.concat(F.lit(f"{tmp_path}/tree/"), "relative_path").alias("source"), F.col("file_size").alias("size"), "hash")
    for column, wrong in (("hash", "x"), ("size", 5), ("source", f"{tmp_path}/nowhere/f"), ("relative_path", "../out")):
        with pytest.raises(PythonException):
            tree_source.write_tree(plan.withColumn(column, F.when(F.col("relative_path") == "d3/f7", F.lit(wrong)).otherwise(F.col(column))), str(tmp_path / "copy"))
        assert not (tmp_path / "copy").exists() and not (tmp_path / "out").exists()
    tree_source.write_tree(plan, str(tmp_path / "copy"))
    read = lambda name: {(r.relative_path, r.hash) for r in tree_source.entries(spark, str(tmp_path / name), "sha256").where("kind = 'file'").collect()}
    assert read("copy") == read("tree") and len(read("copy")) == 40
    with pytest.raises(Exception, match="already"):
        tree_source.write_tree(plan.where("false"), str(tmp_path / "copy"))
    assert read("copy") == read("tree")


def test_tasks_that_are_tried_again_write_the_same(tmp_path):
    """An attempt that dies half way leaves its own part file; the next one's files are whole and the commit takes them."""
    from pyspark.sql.types import StructType

    writer = tree_source.TreeWriter({"path": str(tmp_path / "out")}, StructType.fromDDL("relative_path string, content binary"))

    def dies():
        yield ("a/1", b"one")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert writer.write(iter([("a/1", b"one"), ("a/2", b"two"), ("b", None)])).files == 2
    assert not (tmp_path / "out").exists()
    writer.commit([])
    assert (tmp_path / "out" / "a" / "1").read_bytes() == b"one" and (tmp_path / "out" / "b").is_dir()
    assert sorted(p.name for p in (tmp_path / "out" / "a").iterdir()) == ["1", "2"]


def test_log_tail(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.log").write_text("".join(f"{k}-{i}\n" for i in range(5)))
        os.utime(tmp_path / f"{k}.log", (1000 + k, 1000 + k))
    got = [r.line for r in files.log_tail(spark, str(tmp_path), 3, 7).collect()]
    assert got == ["3-0", "3-1", "3-2", "3-3", "3-4", "2-0", "2-1"]


def test_dihedral_group():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 255, (4, 6))
    t = fingerprint.transformed
    # output(x, y) = source(f(x, y)), as (column, row)
    at = {
        "identity": lambda x, y: (x, y), "rot90": lambda x, y: (y, 3 - x), "rot180": lambda x, y: (5 - x, 3 - y), "rot270": lambda x, y: (5 - y, x),
        "flip_h": lambda x, y: (5 - x, y), "flip_v": lambda x, y: (x, 3 - y), "transpose": lambda x, y: (y, x), "transverse": lambda x, y: (5 - y, 3 - x),
    }
    for name in schemas.TRANSFORMS:
        out = t(g, name)
        for y in range(out.shape[0]):
            for x in range(out.shape[1]):
                sx, sy = at[name](x, y)
                assert out[y, x] == g[sy, sx]


def test_fingerprints(spark):
    rng = np.random.default_rng(1)
    noisy = rng.integers(0, 255, (40, 50), dtype=np.uint8)
    flat = np.full((32, 32), 7, dtype=np.uint8)
    df = spark.createDataFrame([(1, 50, 40, bytearray(noisy.tobytes())), (2, 32, 32, bytearray(flat.tobytes()))], "id int, width int, height int, pixels binary")
    got = {r.id: r for r in fingerprint.fingerprints(df).collect()}
    assert len(got[1].block_hash) == 32 and len(got[1].fine_hash) == 68 and len(got[1].variants) == 8
    assert (got[1].eligible, got[2].eligible) == (True, False)


def test_rotated_copies_are_recalled(spark):
    rng = np.random.default_rng(6)
    images = [rng.integers(0, 255, (16, 16), dtype=np.uint8) for _ in range(6)]
    images += [np.ascontiguousarray(fingerprint.transformed(images[k % 6], t)) for k, t in enumerate(schemas.TRANSFORMS)]
    images.append(np.ascontiguousarray(np.tile(images[0][:8], (2, 1))[:, ::-1] // 2 + images[0] // 2))
    df = spark.createDataFrame([(k, 16, 16, bytearray(g.tobytes())) for k, g in enumerate(images)], "id int, width int, height int, pixels binary")
    prints = fingerprint.fingerprints(df).localCheckpoint()
    held, want = {r.id: r for r in prints.where("eligible").collect()}, {}
    for a, b in itertools.permutations(held, 2):
        by = {v.transform: sum((x ^ y).bit_count() for x, y in zip(v.hash, held[b].block_hash)) for v in held[a].variants}
        if (least := min(by.values())) <= 31:
            want[a, b] = (least, sorted(t for t, d in by.items() if d == least))
    assert all((k % 6, 6 + k) in want and t in want[k % 6, 6 + k][1] for k, t in enumerate(schemas.TRANSFORMS))
    assert {(r.left_id, r.right_id): (r.least, r.transforms) for r in near.recalled_images(prints, prints).collect()} == want


@pytest.mark.parametrize(("bits", "radius"), [(256, 31), (544, 66)])
def test_binary_join_is_exact(spark, bits, radius):
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(8)]
    hashes = [h ^ sum(1 << k for k in rng.sample(range(bits), n)) for h in base for n in (0, 5, radius // 2, radius, radius + 1)]
    df = spark.createDataFrame([(k, bytearray(h.to_bytes(bits // 8, "big"))) for k, h in enumerate(hashes)] + [(99, None)], "id int, hash binary")
    got = [(r.left_id, r.right_id, r.distance) for r in near.binary_join(df, df, "id", "hash", radius, bits).collect()]
    want = [(a, b, d) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if (d := (x ^ y).bit_count()) <= radius]
    assert sorted(got) == want


def test_chained_components_of_all_lines(spark, tmp_path):
    from tessera.plans import registry

    rng = random.Random(9)
    lines = [(rng.randrange(60), rng.randrange(200), k % 50 + 1, 0.02) for k in range(45)]  # none has tax 0.01
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity int, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = [(s * 2, p % 97 * 2 + 1) for s, p, _, _ in lines]
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = dict(map(tuple, registry.queries()["d12_chained_components_whole"](spark, str(tmp_path)).select("node", "component").collect()))
    assert got == least and len(set(least.values())) > 1


def test_schemas_cover_all_relations():
    assert len(schemas.RELATIONS) == 22
