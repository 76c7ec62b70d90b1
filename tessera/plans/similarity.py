"""Registered queries of the duplicate-detection dataflow (ids D*), over documents and embeddings.

A document stands for an image: doc_id is its id, source its album, (n_chars, md5 of the text) its exact content, and the
sign bits of an embedding its perceptual hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import cover, graph, merge, near, planning, verify
from tessera.operators.component_index import ComponentIndex
from tessera.operators.exact import content_classes, exact_star_edges, first_of_key, library_class_edges, library_edges
from tessera.plans.registry import merkle_sql, query
from tessera.sources import store
from tessera.sources.tables import table

STARS = """stars AS (SELECT doc_id, source, rep, rep_source FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY n_chars, md5(text)) AS rep,
  first_value(source) OVER (PARTITION BY n_chars, md5(text) ORDER BY doc_id) AS rep_source FROM documents) WHERE doc_id <> rep)"""
GROUPS = f"""{STARS}, members AS (SELECT doc_id, rep AS grp FROM stars UNION SELECT rep, rep FROM stars)"""


def hashed(spark, sf):
    return table(spark, sf, "documents").withColumn("digest", F.md5("text"))


def stars(spark, sf):
    return exact_star_edges(hashed(spark, sf), "doc_id", ["n_chars", "digest"], "source")


def signed(spark, sf):
    """Embeddings with their first 63 sign bits as one BIGINT."""
    bits = F.aggregate(
        F.sequence(F.lit(1), F.lit(63)),
        F.lit(0).cast("long"),
        lambda s, k: s.bitwiseOR(F.when(F.element_at("embedding", k) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k - 1)).otherwise(F.lit(0).cast("long"))),
    )
    return table(spark, sf, "embeddings").select("vec_id", "label", bits.alias("hash"))


SIGNS = "signs AS (SELECT vec_id, label, list_sum(list_transform(range(1, 64), lambda k: CASE WHEN embedding[k] > 0 THEN CAST(1 AS BIGINT) << CAST(k - 1 AS INTEGER) ELSE 0 END))::BIGINT AS hash FROM embeddings)"


@query("d04_exact_star_edges", f"WITH {STARS} SELECT doc_id, rep, CASE WHEN source IS NOT DISTINCT FROM rep_source THEN 'intra_album' ELSE 'cross_album' END AS scope FROM stars")
def d04(spark, sf):
    return stars(spark, sf)


@query("d05_hamming_recall", f"WITH {SIGNS} SELECT a.vec_id AS left_id, b.vec_id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM signs a JOIN signs b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 20")
def d05(spark, sf):
    rows = signed(spark, sf)
    return near.radius_join(rows, rows, "vec_id", "hash", 20, 63).where("left_id < right_id")


@query("d05_ratio_recall", f"WITH {SIGNS} SELECT a.vec_id AS left_id, b.vec_id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM signs a JOIN signs b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 8")
def d05_ratio(spark, sf):
    """Recall at the workflow's own ratio of 0.12 of the bits."""
    rows = signed(spark, sf)
    return near.radius_join(rows, rows, "vec_id", "hash", near.recall_radius(63), 63).where("left_id < right_id")


@query("d05_lane_recall", f"WITH {SIGNS} SELECT a.vec_id AS left_id, b.vec_id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM signs a JOIN signs b ON bit_count(xor(a.hash, b.hash)) <= 6")
def d05_lanes(spark, sf):
    rows = signed(spark, sf)
    return near.lane_join(rows, rows, "vec_id", "hash", 6, 63)


@query(
    "d06_fine_verification",
    f"""WITH {SIGNS}, p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, t.transform, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS block,
        CAST(bit_count(xor(a.hash, b.hash) & t.mask) AS BIGINT) AS fine FROM signs a JOIN signs b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 20,
        (VALUES ('identity', 4294967295), ('rot180', 65535)) t(transform, mask))
        SELECT left_id, right_id, fine, block, transform FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY left_id, right_id ORDER BY fine, block, transform) rn FROM p) WHERE rn = 1""",
)
def d06(spark, sf):
    rows = signed(spark, sf)
    held = lambda side: rows.select(F.col("vec_id").alias(f"{side}_id"), F.col("hash").alias(f"{side}_hash"))
    pairs = d05(spark, sf).join(held("left"), "left_id").join(held("right"), "right_id")
    masks = F.array(F.struct(F.lit("identity").alias("transform"), F.lit(4294967295).cast("long").alias("mask")), F.struct(F.lit("rot180").alias("transform"), F.lit(65535).cast("long").alias("mask")))
    tried = pairs.select("left_id", "right_id", F.col("distance").alias("block"), F.col("left_hash").bitwiseXOR(F.col("right_hash")).alias("x"), F.explode(masks).alias("t"))
    tried = tried.select("left_id", "right_id", "block", F.bit_count(F.col("x").bitwiseAND(F.col("t.mask"))).cast("long").alias("fine"), "t.transform")
    return near.best_fine(tried, ["left_id", "right_id"], "fine", "block", "transform")


@query(
    "d06_tied_transforms",
    "SELECT user_id, CAST(floor(value) AS BIGINT) AS least, list_sort(list(DISTINCT event_type)) AS transforms FROM (SELECT *, MIN(floor(value)) OVER (PARTITION BY user_id) m FROM events) WHERE floor(value) = m GROUP BY 1, 2",
)
def d06_ties(spark, sf):
    rows = table(spark, sf, "events").withColumn("d", F.floor("value"))
    return near.tied_transforms(rows, ["user_id"], "d", "event_type")


CLASS_SQL = "CASE WHEN l_quantity < 3 THEN NULL WHEN l_discount <= 0.04 AND l_tax <= 0.04 THEN 'near' WHEN l_discount <= 0.12 AND l_tax <= 0.08 THEN 'similar' END"


@query("d07_classify", f"SELECT l_orderkey, l_linenumber, {CLASS_SQL} AS match_type FROM lineitem")
def d07(spark, sf):
    match = near.classify(F.col("l_quantity") >= 3, F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", match.alias("match_type"))


@query("d08_best_per_pair", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_orderkey, l_linenumber) rn FROM lineitem) WHERE rn = 1")
def d08(spark, sf):
    priority = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    best = near.best_per_pair(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], priority, [F.col("l_orderkey"), F.col("l_linenumber")])
    return best.select("l_partkey", "l_suppkey", "l_orderkey")


@query("d09_skip_exact_pairs", f"WITH {SIGNS} SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM signs a JOIN signs b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 20 WHERE a.label <> b.label")
def d09(spark, sf):
    return near.without_exact(d05(spark, sf), signed(spark, sf), "vec_id", ["label"]).select("left_id", "right_id")


@query(
    "d10_library_exact_edges",
    """WITH d AS (SELECT doc_id, n_chars, md5(text) AS h, md5(lower(text)) AS p FROM documents)
       SELECT i.doc_id, l.doc_id AS library_id, CASE WHEN i.n_chars = l.n_chars AND i.h = l.h THEN 'file_exact' ELSE 'pixel_exact' END AS match_type
       FROM d i JOIN d l ON i.p = l.p WHERE i.doc_id % 2 = 1 AND l.doc_id % 2 = 0""",
)
def d10(spark, sf):
    rows = hashed(spark, sf).withColumn("pixel", F.md5(F.lower("text")))
    return library_edges(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), "doc_id", ["n_chars", "digest"], "pixel")


D10_CLASSES = """WITH d AS (SELECT doc_id, n_chars, md5(text) AS h, md5(lower(text)) AS p FROM documents), i AS (SELECT n_chars, h, p, min(doc_id) AS rep FROM d WHERE doc_id % 2 = 1 GROUP BY ALL),
       l AS (SELECT n_chars, h, p, min(doc_id) AS rep FROM d WHERE doc_id % 2 = 0 GROUP BY ALL)"""


@query("d10_class_edges", f"{D10_CLASSES} SELECT i.rep AS image, l.rep AS library, CASE WHEN i.n_chars = l.n_chars AND i.h = l.h THEN 'file_exact' ELSE 'pixel_exact' END AS match_type FROM i JOIN l ON i.p = l.p")
def d10_classes(spark, sf):
    rows = hashed(spark, sf).withColumn("pixel", F.md5(F.lower("text")))
    return library_class_edges(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), "doc_id", ["n_chars", "digest"], "pixel")


@query("d10_class_membership", f"{D10_CLASSES} SELECT doc_id, rep AS representative FROM d JOIN l USING (n_chars, h, p) WHERE doc_id % 2 = 0")
def d10_members(spark, sf):
    rows = hashed(spark, sf).withColumn("pixel", F.md5(F.lower("text")))
    return content_classes(rows.where("doc_id % 2 = 0"), "doc_id", ["n_chars", "digest"], "pixel")[1]


@query("d10_image_membership", f"{D10_CLASSES} SELECT doc_id, rep AS representative FROM d JOIN i USING (n_chars, h, p) WHERE doc_id % 2 = 1")
def d10_image_members(spark, sf):
    rows = hashed(spark, sf).withColumn("pixel", F.md5(F.lower("text")))
    return content_classes(rows.where("doc_id % 2 = 1"), "doc_id", ["n_chars", "digest"], "pixel")[1]


@query("d11_top_recall", f"WITH {SIGNS}, p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM signs a JOIN signs b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 22) SELECT left_id, right_id, distance, place, found > 4 AS truncated FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY left_id ORDER BY distance, right_id) place, COUNT(*) OVER (PARTITION BY left_id) found FROM p) WHERE place <= 4")
def d11(spark, sf):
    rows = signed(spark, sf)
    pairs = near.radius_join(rows, rows, "vec_id", "hash", 22, 63).where("left_id < right_id")
    return near.top_recall(pairs, "left_id", "right_id", "distance", most=4).withColumn("place", F.col("place").cast("long"))


@query("d12_components", f"WITH {GROUPS} SELECT doc_id AS node, grp AS component FROM members")
def d12(spark, sf):
    return graph.connected_components(stars(spark, sf), "doc_id", "rep")


@query(
    "d12_chained_components_whole",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 AS a, (l_partkey % 97) * 2 + 1 AS b FROM lineitem),
       both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ UNION SELECT r.node, b.b FROM reach r JOIN both_ b ON r.seen = b.a)
       SELECT node, MIN(seen) AS component FROM reach GROUP BY node""",
)
def d12_chains_whole(spark, sf):
    lines = table(spark, sf, "lineitem")
    return graph.connected_components(lines.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") % 97 * 2 + 1).alias("b")))


@query("d12_changed_components", f"WITH {STARS} SELECT doc_id AS node, rep AS component FROM stars WHERE doc_id % 5 <> 0 UNION SELECT rep, rep FROM stars WHERE doc_id % 5 <> 0")
def d12_changed(spark, sf):
    """Components after edges came in two changes and some went: each change reads the components that it touches."""
    index = ComponentIndex(spark, f"{graph.shared_folder(spark)}/components-{uuid.uuid4().hex}", buckets=16)
    edges = stars(spark, sf).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    index.change(edges.where("a % 3 > 0"))
    index.change(edges.where("a % 3 = 0"), edges.where("a % 3 > 0 AND a % 5 = 0"))
    index.change(edges.where("false"), edges.where("a % 5 = 0"))
    return index.components()


def members(spark, sf):
    return d12(spark, sf).withColumnsRenamed({"node": "doc_id", "component": "grp"})


@query(
    "d13_representatives",
    f"WITH {GROUPS} SELECT grp, COALESCE(MIN(doc_id) FILTER (WHERE doc_id % 2 = 0), MIN(doc_id)) AS representative, COUNT(*) AS members FROM members GROUP BY grp",
)
def d13(spark, sf):
    return graph.representatives(members(spark, sf), "grp", "doc_id", F.col("doc_id") % 2 == 0, F.lit(True))


@query(
    "d14_initial_action",
    f"""WITH {GROUPS}, g AS (SELECT grp, COALESCE(MIN(doc_id) FILTER (WHERE doc_id % 2 = 0), MIN(doc_id)) AS rep, BOOL_OR(doc_id % 2 = 0) AS lib, COUNT(*) > 3 AS manual FROM members GROUP BY grp)
        SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR manual OR (NOT lib AND doc_id = rep) THEN 'keep' ELSE 'exclude' END AS action FROM members JOIN g USING (grp)""",
)
def d14(spark, sf):
    rows = members(spark, sf)
    reps = graph.representatives(rows, "grp", "doc_id", F.col("doc_id") % 2 == 0, F.lit(True))
    facts = rows.groupBy("grp").agg(F.bool_or(F.col("doc_id") % 2 == 0).alias("lib"))
    joined = rows.join(reps, "grp").join(facts, "grp")
    action = graph.initial_action(F.col("doc_id") % 2 == 0, F.col("members") > 3, F.col("lib"), F.col("doc_id") == F.col("representative"))
    return joined.select("doc_id", action.alias("action"))


@query(
    "d15_group_signatures",
    "SELECT grp, hash AS signature, rows AS members FROM (" + merkle_sql(f"WITH {GROUPS} SELECT grp, 'import:' || doc_id AS t FROM members", ["grp"]) + ")",
)
def d15(spark, sf):
    return graph.member_signature(members(spark, sf), "grp", F.lit("import"), "doc_id")


@query(
    "d15_reconcile_groups",
    f"""WITH {GROUPS}, f AS (SELECT grp, string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM members GROUP BY grp), o AS (SELECT grp, string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM members WHERE doc_id % 5 <> 0 GROUP BY grp)
        SELECT o.grp AS stored_id, f.grp AS fresh_id, CASE WHEN o.s IS NULL THEN 'insert' WHEN f.s IS NULL THEN 'delete' ELSE 'keep' END AS action FROM o FULL OUTER JOIN f ON o.s = f.s""",
)
def d15_reconcile(spark, sf):
    rows = members(spark, sf)
    named = lambda df: graph.member_signature(df, "grp", F.lit("import"), "doc_id").withColumnRenamed("grp", "group_id")
    return graph.reconcile_groups(named(rows.where("doc_id % 5 <> 0")), named(rows)).drop("signature")


REVIEW = f"""WITH {GROUPS}, fm AS (SELECT CAST(grp AS VARCHAR) AS g, doc_id, COUNT(*) OVER (PARTITION BY grp) > 2 AS manual, doc_id = grp AS first FROM members),
    om AS (SELECT CAST(grp AS VARCHAR) AS g, doc_id, grp % 2 = 0 AS manual, CASE WHEN grp % 3 = 0 THEN 'submitted' ELSE 'pending' END AS state, CASE WHEN doc_id % 4 = 1 THEN 'user' ELSE 'automatic' END AS by_, CASE WHEN doc_id % 4 = 1 THEN 'exclude' ELSE 'keep' END AS action FROM members WHERE doc_id % 5 <> 0),
    f AS (SELECT g, any_value(manual) AS manual, string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM fm GROUP BY g), o AS (SELECT g, any_value(manual) AS manual, any_value(state) AS state, string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM om GROUP BY g),
    k AS (SELECT f.g, f.manual, coalesce(o.g, 'new:' || f.g) AS group_id, o.g IS NULL AS fresh, CASE WHEN NOT f.manual THEN 'resolved' WHEN o.manual THEN o.state ELSE 'pending' END AS state FROM f LEFT JOIN o ON o.s = f.s)"""


def review(spark, sf):
    """Stored groups of most members, with decisions, and fresh ones of all."""
    rows = members(spark, sf)
    text = F.col("grp").cast("string").alias("group_id")
    image = (F.lit("import").alias("source"), F.col("doc_id").alias("image"))
    user = F.col("doc_id") % 4 == 1
    held = rows.where("doc_id % 5 <> 0")
    stored_members = held.select(text, *image, F.when(user, "exclude").otherwise("keep").alias("action"), F.when(user, "user").otherwise("automatic").alias("decided_by"))
    stored = held.select("grp").distinct().select(text, F.when(F.col("grp") % 3 == 0, "submitted").otherwise("pending").alias("state"), (F.col("grp") % 2 == 0).alias("manual"))
    fresh = rows.groupBy("grp").agg(F.count("*").alias("n")).select(text, (F.col("n") > 2).alias("manual"), F.col("grp").alias("representative"))
    manual = rows.join(fresh.select(F.col("representative").alias("grp"), "manual"), "grp")
    initial = graph.initial_action(F.lit(False), F.col("manual"), F.lit(False), F.col("doc_id") == F.col("grp"))
    return graph.reconciled_review(stored, stored_members, fresh, manual.select(text, *image, initial.alias("initial")))


@query("d15_reconciled_groups", f"{REVIEW} SELECT group_id, state, manual FROM k")
def d15_groups(spark, sf):
    return review(spark, sf)[0]


@query(
    "d15_reconciled_decisions",
    f"""{REVIEW}, m AS (SELECT k.group_id, k.fresh, fm.doc_id, fm.first, CASE WHEN om.by_ = 'user' THEN om.action WHEN k.manual OR fm.first THEN 'keep' ELSE 'exclude' END AS action, coalesce(om.by_ = 'user', false) AS user FROM fm JOIN k ON k.g = fm.g LEFT JOIN om ON om.doc_id = fm.doc_id),
        t AS (SELECT *, fresh AND first AND NOT bool_or(action = 'keep') OVER (PARTITION BY group_id) AS forced FROM m)
        SELECT group_id, doc_id AS image, CASE WHEN forced THEN 'keep' ELSE action END AS action, CASE WHEN user AND NOT forced THEN 'user' ELSE 'automatic' END AS decided_by FROM t""",
)
def d15_decisions(spark, sf):
    return review(spark, sf)[1].drop("source")


MERGE_OLD = "SELECT l_partkey AS a, l_suppkey AS b, MIN(l_orderkey) AS v, 1 AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL"
MERGE_NEW = "SELECT l_partkey AS a, l_suppkey AS b, MIN(l_orderkey) AS v, CAST(MIN(l_linenumber) % 3 AS INTEGER) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL"


def merge_sides(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnsRenamed({"l_partkey": "a", "l_suppkey": "b"})
    old = lines.where("l_returnflag = 'A'").groupBy("a", "b").agg(F.min("l_orderkey").alias("v"), F.lit(1).alias("p"))
    new = lines.where("l_returnflag = 'R'").groupBy("a", "b").agg(F.min("l_orderkey").alias("v"), (F.min("l_linenumber") % 3).cast("int").alias("p"))
    return old, new


@query("d16_insert_or_ignore", f"WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.a = n.a AND o.b = n.b)")
def d16(spark, sf):
    return merge.insert_or_ignore(*merge_sides(spark, sf), ["a", "b"], [F.col("v")])


@query("d17_upgrade_merge", f"WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW}) SELECT a, b, v, p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY p, src) rn FROM (SELECT *, 0 AS src FROM o UNION ALL SELECT *, 1 FROM n)) WHERE rn = 1")
def d17(spark, sf):
    return merge.upgrade(*merge_sides(spark, sf), ["a", "b"], F.col("p"))


@query("k04_upsert", f"WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.a = n.a AND o.b = n.b)")
def k04(spark, sf):
    return merge.upsert(*merge_sides(spark, sf), ["a", "b"])


@query("k05_insert_once", f"WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW}) SELECT n.a, n.b, n.p, CASE WHEN o.a IS NULL THEN 'inserted' WHEN o.p = n.p THEN 'same' ELSE 'conflict' END AS verdict FROM n LEFT JOIN o ON o.a = n.a AND o.b = n.b")
def k05(spark, sf):
    return merge.insert_once(*merge_sides(spark, sf), ["a", "b"], ["p"])


@query("k06_lease_verdict", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'acquired' WHEN value <= 10 OR event_type = 'click' OR user_id = 7 THEN 'taken over' ELSE 'refused' END AS verdict FROM events")
def k06(spark, sf):
    holder = F.when(F.col("event_type") != "view", F.col("event_type"))
    verdict = merge.lease_verdict(F.lit(10.0), F.col("value"), holder, F.col("user_id").cast("string"), "click", "7")
    return table(spark, sf, "events").select("event_id", verdict.alias("verdict"))


@query("k08_recompute_counters", "SELECT o_orderkey, COALESCE(n, 0) AS candidate_count FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey")
def k08(spark, sf):
    fresh = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").join(fresh, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("candidate_count"))


@query("k09_guarded_update", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 AS affected FROM orders")
def k09(spark, sf):
    guard = F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 200000)
    return merge.guarded_update(table(spark, sf, "orders"), "o_orderstatus", guard, F.lit("F")).select("o_orderkey", "o_orderstatus", "affected")


@query("k10_delete_ranked", "SELECT doc_id FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY n_chars, md5(text) ORDER BY doc_id) = 1")
def k10(spark, sf):
    return first_of_key(hashed(spark, sf), ["n_chars", "digest"], "doc_id").select("doc_id")


def kept_table(spark, rows, key):
    """rows as a stored table."""
    made = store.BucketStore(spark, f"{graph.shared_folder(spark)}/table-{uuid.uuid4().hex}", rows.schema, key, buckets=16)
    made.append(rows)
    return made


@query("k04_stored_upsert", f"WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW}) SELECT * FROM n WHERE a % 50 = 0 UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.a = n.a AND o.b = n.b AND n.a % 50 = 0)")
def k04_stored(spark, sf):
    """A keyed upsert in place: buckets that the batch does not touch keep their files."""
    old, new = merge_sides(spark, sf)
    kept = kept_table(spark, old, ["a", "b"])
    store.upsert(kept, new.where("a % 50 = 0"))
    return kept.read()


@query("d17_stored_upgrade", f"WITH o AS ({MERGE_OLD}), n AS ({MERGE_NEW}) SELECT a, b, v, p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY p, src) rn FROM (SELECT *, 0 AS src FROM o UNION ALL SELECT *, 1 FROM n)) WHERE rn = 1")
def d17_stored(spark, sf):
    old, new = merge_sides(spark, sf)
    kept = kept_table(spark, old, ["a", "b"])
    store.upgrade(kept, new, F.col("p"))
    return kept.read()


@query(
    "k09_guarded_write",
    """WITH u AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus IN ('O', 'P') AND o_totalprice > 200000 AS hit FROM orders)
       SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, (SELECT COUNT(*) FROM u WHERE hit) AS affected, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P') AS refused FROM u""",
)
def k09_write(spark, sf):
    """Two staged writes: one breaks a rule on its rows and leaves the table as it was, the other is published. Counts come from the writing pass."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    kept = kept_table(spark, rows, ["o_orderkey"])
    open_ = F.col("o_orderstatus").isin("O", "P")
    refused = store.guarded_update(kept, rows, "o_orderstatus", F.col("o_orderstatus") == "P", F.lit("X"), {"unknown": ~F.col("o_orderstatus").isin("O", "P", "F")})
    done = store.guarded_update(kept, rows, "o_orderstatus", open_ & (F.col("o_totalprice") > 200000), F.lit("F"), {"unknown": ~F.col("o_orderstatus").isin("O", "P", "F")})
    told = refused.counts["unknown"] if not refused.published else -1
    return kept.read().withColumns({"affected": F.lit(done.counts["affected"]).cast("long"), "refused": F.lit(told).cast("long")})


@query("d31_cascade_delete", f"WITH {STARS} SELECT doc_id, rep FROM stars WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3') AND rep NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def d31(spark, sf):
    gone = table(spark, sf, "documents").where("source = 'src3'")
    return merge.without_touching(stars(spark, sf), gone, "doc_id", ["doc_id", "rep"]).select("doc_id", "rep")


@query("d18_plan", f"WITH {GROUPS}, x AS (SELECT doc_id FROM members WHERE doc_id <> grp) SELECT d.doc_id, d.source FROM documents d WHERE n_chars > 100 AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = d.doc_id)")
def d18(spark, sf):
    excluded = members(spark, sf).where("doc_id <> grp")
    return planning.plan_images(table(spark, sf, "documents"), excluded, "doc_id", F.col("n_chars") > 100).select("doc_id", "source")


@query(
    "d19_edge_exclusions",
    f"""WITH {STARS}, e AS (SELECT s.doc_id, s.rep, s.source = s.rep_source AS intra, s.rep % 2 = 0 AS lib, CASE WHEN s.doc_id % 3 = 0 THEN 'keep_source' WHEN s.doc_id % 3 = 1 THEN 'keep_candidate' ELSE 'keep_all' END AS d FROM stars s)
        SELECT DISTINCT CASE WHEN d = 'keep_source' THEN rep ELSE doc_id END AS id FROM e WHERE (d = 'keep_source' AND intra AND NOT lib) OR (d = 'keep_candidate' AND (intra OR lib))""",
)
def d19(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "keep_source").when(F.col("doc_id") % 3 == 1, "keep_candidate").otherwise("keep_all")
    edges = stars(spark, sf).select(F.col("doc_id").alias("source"), F.col("rep").alias("candidate"), kind.alias("decision"), (F.col("scope") == "intra_album").alias("intra"), (F.col("rep") % 2 == 0).alias("is_library"))
    return planning.edge_exclusions(edges)


@query(
    "d20_covered_albums",
    """WITH d AS (SELECT doc_id, CAST(doc_id % 700 AS VARCHAR) AS album, md5(text) AS h FROM documents), c AS (SELECT album, h, COUNT(*) AS n FROM d GROUP BY ALL), s AS (SELECT album, SUM(n) AS n FROM c GROUP BY album),
       m AS (SELECT a.album AS a, b.album AS b, SUM(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.h = b.h AND a.album <> b.album GROUP BY 1, 2), v AS (SELECT m.a, m.b FROM m JOIN s ON s.album = m.b WHERE m.m = s.n)
       SELECT DISTINCT b AS album FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.a = v.b AND w.b = v.a) OR a < b""",
)
def d20(spark, sf):
    docs = hashed(spark, sf).select((F.col("doc_id") % 700).cast("string").alias("album"), "digest")
    return cover.covered_by_content(docs, "album", "digest")


@query(
    "d20_covered_by_edges",
    f"""WITH {STARS}, album AS (SELECT doc_id, 'al' || (doc_id % 40) AS album FROM documents WHERE doc_id IN (SELECT doc_id FROM stars UNION SELECT rep FROM stars)), n AS (SELECT album, COUNT(*) AS n FROM album GROUP BY album),
       e AS (SELECT s.rep, least(a.album, b.album) AS x, greatest(a.album, b.album) AS y FROM stars s JOIN album a ON a.doc_id = s.doc_id JOIN album b ON b.doc_id = s.rep WHERE a.album <> b.album),
       m AS (SELECT x, y, COUNT(DISTINCT rep) AS m FROM e GROUP BY x, y)
       SELECT DISTINCT CASE WHEN m = q.n AND p.n >= q.n THEN y ELSE x END AS album FROM m JOIN n p ON p.album = x JOIN n q ON q.album = y WHERE (m = q.n AND p.n >= q.n) OR (m = p.n AND q.n >= p.n)""",
)
def d20_edges(spark, sf):
    """Covers by largest matchings over star edges, which are not all pairs of equal content; in SQL a star's matching is one edge."""
    edges = stars(spark, sf).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    images = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("album", F.concat(F.lit("al"), (F.col("id") % 40).cast("string")))
    return cover.covered_albums(edges, images, "id", "album")


@query("d21_invalidate_drafts", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'invalidated' ELSE o_orderstatus END AS state FROM orders")
def d21(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "state")
    return merge.guarded_update(rows, "state", F.col("state") == "P", F.lit("invalidated")).select("o_orderkey", "state")


@query(
    "d22_plan_hash",
    merkle_sql("SELECT source, length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length(CAST(n_chars AS VARCHAR)) || ':' || n_chars || '32:' || md5(text) AS t FROM documents", ["source"]),
)
def d22(spark, sf):
    return verify.canonical_hash(hashed(spark, sf), ["source"], [F.col("doc_id"), F.col("n_chars"), F.col("digest")])


@query(
    "d24_reconcile_sets",
    """WITH s AS (SELECT doc_id, n_chars, md5(text) AS digest FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, md5(CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE text END) AS digest FROM documents WHERE doc_id % 7 <> 0)
       SELECT COALESCE(s.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS error FROM s FULL OUTER JOIN a USING (doc_id) WHERE s.doc_id IS NULL OR a.doc_id IS NULL
       UNION ALL SELECT doc_id, 'n_chars_mismatch' FROM s JOIN a USING (doc_id) WHERE s.n_chars <> a.n_chars
       UNION ALL SELECT doc_id, 'digest_mismatch' FROM s JOIN a USING (doc_id) WHERE s.digest <> a.digest""",
)
def d24(spark, sf):
    docs = table(spark, sf, "documents")
    stored = docs.where("doc_id % 11 <> 0").select("doc_id", "n_chars", F.md5("text").alias("digest"))
    size = F.when(F.col("doc_id") % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    actual = docs.where("doc_id % 7 <> 0").select("doc_id", size.alias("n_chars"), F.md5(F.when(F.col("doc_id") % 17 == 0, "x").otherwise(F.col("text"))).alias("digest"))
    return verify.reconcile(stored, actual, "doc_id", ["n_chars", "digest"])


@query("d30_index_delta", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'unchanged' END AS change FROM documents")
def d30(spark, sf):
    docs = hashed(spark, sf)
    old = docs.where("doc_id % 3 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return merge.delta(old, docs, "doc_id", F.sha2(F.concat_ws(":", "n_chars", "digest"), 256))


@query("d30_delta_bound", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unchanged' ELSE 'insert' END AS change FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 3600 SECOND")
def d30_bound(spark, sf):
    """Only what was committed since a clock value, a parameter, is held against the index."""
    events = table(spark, sf, "events")
    since = events.agg(F.max("ts")).first()[0]
    late = F.col("ts") >= F.lit(since) - F.expr("INTERVAL 3600 SECONDS")
    signature = F.sha2(F.concat_ws(":", "event_type", "user_id"), 256)
    return merge.delta(events.where(~late | (F.col("event_id") % 10 == 0)), events.where(late), "event_id", signature)


@query("d32_representatives_of_keys", "SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY n_chars, md5(text) UNION SELECT MIN(doc_id) FROM documents GROUP BY md5(lower(text))")
def d32(spark, sf):
    rows = hashed(spark, sf).withColumn("pixel", F.md5(F.lower("text")))
    return first_of_key(rows, ["n_chars", "digest"], "doc_id").select("doc_id").union(first_of_key(rows, ["pixel"], "doc_id").select("doc_id")).distinct()


@query("d38_edit_plan", "SELECT doc_id, source FROM documents WHERE (doc_id % 2 = 0 AND doc_id % 3 <> 0) OR doc_id % 7 = 1")
def d38(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return planning.edited(docs.where("doc_id % 2 = 0"), docs, "doc_id", "source", docs.where("doc_id % 3 = 0 AND doc_id % 7 <> 1"), docs.where("doc_id % 7 = 1"))


@query("d44_strongest_evidence", "SELECT user_id, arg_min(event_type, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END) AS strongest, MAX(value) AS confidence FROM events GROUP BY user_id")
def d44(spark, sf):
    kind = F.col("event_type")
    priority = F.when(kind == "error", 0).when(kind == "purchase", 1).when(kind == "signup", 2).when(kind == "click", 3).otherwise(4)
    return graph.strongest_evidence(table(spark, sf, "events"), "user_id", "event_type", priority, "value")
