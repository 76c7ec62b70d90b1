"""Further registered queries, one per remaining operator of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.operators import evidence, merge, near, validate, verify
from tessera.plans.registry import merkle_sql, query
from tessera.sources.tables import table

long = lambda c: c.cast("long")


@query("w04_distinct_on_pixel", "SELECT md5(lower(text)) AS pixel, MIN(doc_id) AS doc_id FROM documents GROUP BY 1")
def w04(spark, sf):
    from tessera.operators.exact import first_of_key

    return first_of_key(table(spark, sf, "documents").withColumn("pixel", F.md5(F.lower("text"))), ["pixel"], "doc_id")


@query("w06_argmin_composite", "SELECT l_orderkey, arg_min(l_linenumber, (l_discount, l_tax, l_linenumber, l_partkey)) AS line FROM lineitem GROUP BY l_orderkey")
def w06(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_discount", "l_tax", "l_linenumber", "l_partkey")).alias("line"))


@query("o02_order_by_boolean", "SELECT o_orderkey FROM orders ORDER BY (o_orderstatus = 'F'), o_orderdate DESC, o_orderkey LIMIT 30")
def o02(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_orderstatus") == "F", F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey")


@query("o07_bound_page", "SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 100 AND (l_linenumber, l_partkey) > (2, 0) ORDER BY 1, 2 LIMIT 6")
def o07(spark, sf):
    from tessera.operators.paging import page

    lines = table(spark, sf, "lineitem").where("l_orderkey = 100").select("l_linenumber", "l_partkey")
    return page(lines, [("l_linenumber", False), ("l_partkey", False)], 5, (2, 0))


@query("o08_cursor_text_whole", """SELECT o_orderkey, '{"kind":"albums","version":1,"bound":null,"key":{"k":' || o_orderkey || '}}' AS cursor FROM orders""")
def o08_whole(spark, sf):
    """Cursors as the database would build them: JSON, base64url without padding, and back."""
    text = F.format_string('{"kind":"albums","version":1,"bound":null,"key":{"k":%d}}', F.col("o_orderkey"))
    packed = F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/", "-_"), "=+$|\\s", "")
    padded = F.rpad(F.translate(packed, "-_", "+/"), F.ceil(F.length(packed) / 4).cast("int") * 4, F.lit("="))
    return table(spark, sf, "orders").select("o_orderkey", F.unbase64(padded).cast("string").alias("cursor"))


@query("o10_first_offender", "SELECT o_orderkey FROM orders WHERE o_totalprice > 499000 ORDER BY o_orderkey LIMIT 1")
def o10(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 499000").orderBy("o_orderkey").limit(1).select("o_orderkey")


@query("a16_backfill_counts", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS runs, (SELECT COUNT(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS errors FROM customer")
def a16(spark, sf):
    runs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"))
    errors = table(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("errors"))
    return table(spark, sf, "customer").select("c_custkey").join(runs, "c_custkey", "left").join(errors, "c_custkey", "left").na.fill(0)


@query("a17_lists_per_group", "SELECT source, list_sort(list(DISTINCT lang)) AS langs, COUNT(*) AS n FROM documents GROUP BY source")
def a17(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"), F.count("*").alias("n"))


@query("f02_concat_cast", "SELECT o_orderkey, o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) AS label FROM orders")
def f02(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string")).alias("label"))


@query("f03_hex_whole", "SELECT page_id, lower(hex(encode(url))) AS hex FROM pages")
def f03_whole(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.hex_lower(F.col("url").cast("binary")).alias("hex"))


@query("f07_quoted_identifier", """SELECT n_nationkey, '"' || replace(n_name, '"', '""') || '"' AS quoted FROM nation""")
def f07(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit('"'), F.replace("n_name", F.lit('"'), F.lit('""')), F.lit('"')).alias("quoted"))


@query("f09_version_major", "SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS major FROM part")
def f09(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.version_major(F.col("p_brand")).alias("major"))


@query("f14_recall_radius", "SELECT vec_id, CAST(len(embedding) * (1 + label) AS BIGINT) AS bits, CAST(ceil(len(embedding) * (1 + label) * 0.12::DOUBLE) AS BIGINT) AS radius FROM embeddings")
def f14(spark, sf):
    """The recall radius of hashes of as many bits as an embedding has values, some times over."""
    rows = table(spark, sf, "embeddings").select("vec_id", (F.size("embedding") * (1 + F.col("label"))).cast("long").alias("bits"))
    return rows.withColumn("radius", X.radius_of(F.col("bits")))


@query("f16_information_bits", "SELECT event_id, CAST(least(bit_count(user_id * 2654435761), 64 - bit_count(user_id * 2654435761)) AS BIGINT) AS bits FROM events")
def f16(spark, sf):
    ones = F.bit_count(F.col("user_id") * 2654435761)
    return table(spark, sf, "events").select("event_id", long(X.information_bits(ones, 64)).alias("bits"))


@query("f17_checked_product", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id * 1000 END AS product FROM documents")
def f17(spark, sf):
    factor = F.when(F.col("doc_id") % 2 == 0, F.lit(9223372036854775807)).otherwise(F.lit(1000))
    return table(spark, sf, "documents").select("doc_id", F.try_multiply(F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 2).otherwise(0), factor).alias("product"))


@query("f20_octet_length_whole", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def f20_whole(spark, sf):
    return table(spark, sf, "documents").select("doc_id", long(F.octet_length("text")).alias("n"))


@query("f21_arrays", "SELECT vec_id, list_contains(list_sort([label, 3, 1]), 3) AS three, list_min([label, 3, 1]) AS least, len(list_filter([label, 3, 1], lambda x: x > 2)) AS large FROM embeddings")
def f21(spark, sf):
    a = F.array("label", F.lit(3), F.lit(1))
    return table(spark, sf, "embeddings").select("vec_id", F.array_contains(F.array_sort(a), 3).alias("three"), F.array_min(a).alias("least"), long(F.size(F.filter(a, lambda x: x > 2))).alias("large"))


@query("f24_derived_ids", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, sha256('group:' || doc_id) AS h FROM documents)")
def f24(spark, sf):
    """Ids that follow from keys, in UUID form: reruns agree, unlike random ones."""
    h = F.sha2(F.concat(F.lit("group:"), F.col("doc_id").cast("string")), 256)
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5").alias("id"))


@query("f26_human_bytes", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KiB', floor(n_chars / 1024.0 * 10 + 0.5) / 10) END AS size FROM documents WHERE n_chars < 1048576")
def f26(spark, sf):
    return table(spark, sf, "documents").where("n_chars < 1048576").select("doc_id", X.human_bytes(F.col("n_chars")).alias("size"))


@query("f08_redaction", "SELECT conv_id, turn, 'password=<redacted> in <redacted-path> ok' AS text FROM conversations")
def f08(spark, sf):
    dirty = F.concat(F.lit("password="), F.md5("text"), F.lit("  in 'C:\\tmp\\"), F.col("turn").cast("string"), F.lit(".txt' ok"))
    clean = F.replace(X.redacted(dirty), F.lit("'"), F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", clean.alias("text"))


@query("k03_upgrade_tables", "SELECT l_partkey, MIN(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS priority FROM lineitem GROUP BY 1")
def k03(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("priority", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2))
    best = lambda df: near.best_per_pair(df, ["l_partkey"], F.col("priority"), [F.col("l_orderkey"), F.col("l_linenumber")])
    return merge.upgrade(best(rows.where("l_linenumber < 4")), best(rows.where("l_linenumber >= 4")), ["l_partkey"], F.col("priority")).select("l_partkey", "priority")


@query("k11_delete_anti_set", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_custkey IN (SELECT c_custkey FROM customer)")
def k11(spark, sf):
    customers = table(spark, sf, "customer")
    key = lambda df: df.select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(key(customers), "o_custkey", "left_semi").join(key(customers.where("c_acctbal < 0")), "o_custkey", "left_anti").select("o_orderkey")


@query("d07_similarity_score", "SELECT l_orderkey, l_linenumber, CAST(round((1 - (0.4 * l_discount + 0.6 * l_tax)) * 1000000) AS BIGINT) AS confidence FROM lineitem WHERE l_discount <= 0.12 AND l_tax <= 0.08")
def d07_score(spark, sf):
    rows = table(spark, sf, "lineitem").where(near.classify(F.lit(True), F.col("l_discount"), F.col("l_tax")).isNotNull())
    return rows.select("l_orderkey", "l_linenumber", long(F.round(X.similarity(F.col("l_discount"), F.col("l_tax")) * 1000000)).alias("confidence"))


@query(
    "d23_snapshot_hash",
    merkle_sql("SELECT conv_id, length(role) || ':' || role || length(CAST(turn AS VARCHAR)) || ':' || turn || '32:' || md5(COALESCE(text, '')) AS t FROM conversations", ["conv_id"]),
)
def d23(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    return verify.canonical_hash(turns, ["conv_id"], [F.col("role"), F.col("turn"), F.col("digest")])


@query(
    "d25_published_set",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'extra' ELSE 'hash_mismatch' END AS error FROM documents WHERE doc_id % 10 < 2 OR doc_id % 10 = 5",
)
def d25(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("hash"))
    plan = docs.where("doc_id % 10 <> 1")
    disk = docs.where("doc_id % 10 <> 0").withColumn("hash", F.when(F.col("doc_id") % 10 == 5, "?").otherwise(F.col("hash")))
    return verify.reconcile(plan, disk, "doc_id", ["size", "hash"])


@query(
    "v13_complete_evidence",
    """SELECT source, CASE WHEN BOOL_OR(doc_id % 97 = 5) THEN 'conflict' WHEN BOOL_OR(doc_id % 31 = 7) THEN 'resume' ELSE 'committed' END AS verdict FROM documents GROUP BY source""",
)
def v13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    plan = docs.drop("source")
    manifest = plan.where("doc_id % 31 <> 7")
    disk = plan.withColumn("size", F.when(F.col("doc_id") % 97 == 5, F.col("size") + 1).otherwise(F.col("size")))
    errors = evidence.all_evidence(plan, {"manifest": manifest, "disk": disk, "catalog": plan}, "doc_id", ["size"])
    return evidence.verdicts(errors, docs, docs, "doc_id", "source")


@query("v16_confirmed_hash", "SELECT source, COUNT(*) % 2 = 0 AS confirmed FROM documents GROUP BY source")
def v16(spark, sf):
    docs = table(spark, sf, "documents")
    plan = verify.canonical_hash(docs, ["source"], [F.col("doc_id")])
    told = plan.select("source", F.when(F.col("rows") % 2 == 0, F.col("hash")).otherwise("stale").alias("told"))
    return plan.join(told, "source").select("source", (F.col("hash") == F.col("told")).alias("confirmed"))


@query("v19_derived_paths", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def v19(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("tx"), F.col("o_orderpriority").alias("album"))
    staging, target = evidence.derived_paths(F.lit("/library"), F.col("tx"), F.col("album"))
    stored = rows.withColumns({"staging": staging, "target": F.when(F.col("o_orderkey") % 7 == 0, "/elsewhere").otherwise(target)})
    return stored.where((F.col("staging") != staging) | (F.col("target") != target)).select("o_orderkey")


@query("v20_contained_paths", "SELECT page_id, regexp_matches(url, '^http://') AND NOT regexp_matches(url, '/[.][.](/|$)') AS inside FROM pages")
def v20(spark, sf):
    return table(spark, sf, "pages").select("page_id", evidence.contained(F.regexp_replace("url", "^http://", "/root/"), F.lit("/root/")).alias("inside"))


@query("v03_conditional_presence", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND NOT (value IS NOT NULL AND length(props) BETWEEN 9 AND 9)")
def v03(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view") & ~(F.col("value").isNotNull() & F.length("props").between(9, 9))).select("event_id")


@query(
    "v18_cleanup_matches_plan",
    """SELECT doc_id, 'extra' AS error FROM documents WHERE doc_id % 6 = 2 UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 6 = 3
       UNION ALL SELECT doc_id, 'n_chars_mismatch' FROM documents WHERE doc_id % 6 NOT IN (2, 3) AND doc_id % 7 = 1
       UNION ALL SELECT doc_id, 'digest_mismatch' FROM documents WHERE doc_id % 6 NOT IN (2, 3) AND doc_id % 5 = 1 AND md5(text) <> md5(text || 'x')""",
)
def v18(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "text", F.md5("text").alias("digest"))
    size = F.when(F.col("doc_id") % 7 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    digest = F.when(F.col("doc_id") % 5 == 1, F.md5(F.concat("text", F.lit("x")))).otherwise(F.col("digest"))
    cleanup = docs.where("doc_id % 6 <> 3").select("doc_id", size.alias("n_chars"), digest.alias("digest"))
    return verify.reconcile(docs.where("doc_id % 6 <> 2"), cleanup, "doc_id", ["n_chars", "digest"])


@query("v05_repeated_plans", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING COUNT(*) > 1")
def v05_plans(spark, sf):
    return validate.repeated(table(spark, sf, "orders").where("o_orderstatus = 'F'"), {"o_custkey": F.col("o_custkey")})


@query("streaming_running_totals", "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def stream_totals(spark, sf):
    """Running totals of a file stream, complete at its end: the latest values that a progress display shows."""
    import uuid

    from tessera.operators.graph import shared_folder

    folder = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    events.write.parquet(f"{folder}/in")
    totals = spark.readStream.schema(events.schema).parquet(f"{folder}/in").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(long(F.round(F.col("value") * 100))).alias("cents"))

    def store(batch, batch_id):
        batch.write.parquet(f"{folder}/out/{batch_id}")

    query_ = totals.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    last = max(query_.lastProgress["batchId"], 0) if query_.lastProgress else 0
    return spark.read.parquet(f"{folder}/out/{last}")
