"""Registered queries of sources and sinks that the driver tables can play (S*, K*, streaming)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import merkle_sql, query
from tessera.sources import files, sinks
from tessera.sources.tables import table


@query("s06_scan_predicate", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND value > 5")
def s06(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error' AND value > 5").select("event_id", "ts")


@query("s07_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def s07(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = 77")


@query("s08_set_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 17, 92, 5, 1999)")
def s08(spark, sf):
    return table(spark, sf, "part").where(F.col("p_partkey").isin(3, 17, 92, 5, 1999)).select("p_partkey", "p_name")


@query("s09_arrays_as_rows", "SELECT conv_id, UNNEST(turns) AS turn, UNNEST(sizes) AS size FROM (SELECT conv_id, list(turn) AS turns, list(length(text)) AS sizes FROM conversations GROUP BY conv_id)")
def s09(spark, sf):
    listed = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("size"))).alias("x"))
    arrays = listed.select("conv_id", F.col("x.turn").alias("turn"), F.col("x.size").alias("size"))
    return arrays.withColumn("conv_id", F.transform("turn", lambda _: F.col("conv_id"))).transform(lambda df: files.arrays_as_rows(df, ["conv_id", "turn", "size"]))


@query("s10_json_as_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s10(spark, sf):
    wrapped = table(spark, sf, "events").select(F.to_json(F.array(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))).alias("j"))
    return files.json_as_rows(wrapped, "j", "event_id:long,k:long")


@query("s11_catalog", "SELECT UNNEST(['r_name', 'r_regionkey']) AS column_name")
def s11(spark, sf):
    return spark.createDataFrame([(f.name,) for f in table(spark, sf, "region").schema], "column_name string")


@query("s15_key_value_whole", "SELECT event_id, json_extract_string(props, '$.k') = '69' AS hit FROM events")
def s15_whole(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.from_json("props", "k string")["k"] == "69").alias("hit"))


@query("k07_insert_select", "SELECT l_orderkey, l_linenumber, 'skipped' AS decision FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def k07(spark, sf):
    small = table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf, "lineitem").where("l_quantity > 45").join(small, "l_partkey", "left_anti")
    return rows.select("l_orderkey", "l_linenumber", F.lit("skipped").alias("decision"))


@query("k14_publish_twice", "SELECT doc_id FROM documents")
def k14(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    once = sinks.published(docs.where("doc_id % 3 = 0"), docs, ["doc_id"])
    return sinks.published(once, docs, ["doc_id"])


DUMPED = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"]}


@query(
    "k16_dump_restore",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, rows AS row_count, hash AS fingerprint FROM (" + merkle_sql(f"SELECT concat_ws(chr(31), {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS t FROM {name}", []) + ")" for name, cols in DUMPED.items()
    ),
)
def k16(spark, sf):
    """Row counts and fingerprints of restored copies, against those of the source tables."""
    from tessera.operators.graph import saved
    from tessera.operators.verify import table_fingerprint

    out = None
    for name, cols in DUMPED.items():
        restored = saved(table(spark, sf, name), "dump")
        found = table_fingerprint(restored, cols).select(F.lit(name).alias("table_name"), "row_count", "fingerprint")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "k18_prewrite",
    """SELECT UNNEST(['copy', 'cleanup']) AS kind, source || '/' || doc_id AS source_path, '/library/.staging/' || source || '/' || doc_id AS staging_path,
       '/library/' || source || '/' || doc_id AS target_path, n_chars AS expected_size, md5(text) AS expected_hash, 'planned' AS state FROM documents""",
)
def k18(spark, sf):
    plan = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "n_chars", F.md5("text").alias("digest"))
    return sinks.prewritten(plan, "/library", "source", "path", "n_chars", "digest", move=True)


@query("k19_plan_albums", "SELECT source, COUNT(*) AS expected_image_count FROM documents WHERE n_chars > 500 GROUP BY source")
def k19(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    return sinks.plan_rows(docs, F.col("n_chars") > 500, "source", "path")[0]


@query("k13_manifests", """SELECT source, '{"version":1,"album":"' || source || '","files":[' || string_agg('{"path":"' || path || '","size":' || n_chars || ',"hash":"' || h || '"}', ',' ORDER BY path) || ']}' AS json FROM (SELECT source, CAST(doc_id AS VARCHAR) AS path, n_chars, md5(text) AS h FROM documents) GROUP BY source""")
def k13(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "n_chars", F.md5("text").alias("digest"))
    return sinks.manifest_json(docs, "source", "path", "n_chars", "digest", {"version": F.lit(1)})


@query(
    "k15_diagnostics",
    """SELECT '{' || string_agg(json, ',' ORDER BY k) || '}' AS json FROM (SELECT n_name AS k, '"' || n_name || '":"token=<redacted> ' || n_name || '"' AS json FROM nation
       UNION ALL SELECT * FROM (VALUES ('db_password', '"db_password":"<redacted>"'), ('library_root_path', '"library_root_path":"<redacted-path>"'), ('root', '"root":"<redacted-path>"')) t(k, json))""",
)
def k15(spark, sf):
    """Settings and counts as one sanitized JSON text."""
    facts = table(spark, sf, "nation").select(F.col("n_name").alias("k"), F.concat(F.lit("token=abc "), "n_name").alias("v"))
    facts = facts.unionByName(spark.createDataFrame([("db_password", "x"), ("library_root_path", "/srv/lib"), ("root", "/srv")], "k string, v string"))
    return sinks.diagnostics(facts, "k", "v")


def files_of_three(rows):
    """Files of each of a stream's three batches: as many as Spark reads the rows in parts, so that no task gets a third of all."""
    return max(1, rows.rdd.getNumPartitions())


@query("streaming_exact_components", "SELECT doc_id, rep FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars, md5(text)) AS rep FROM documents) WHERE doc_id <> rep")
def streaming(spark, sf):
    """The components' smallest ids after a file stream: equal to one batch over everything, whatever the batches were."""
    from tessera.operators.graph import connected_components, shared_folder
    from tessera.streaming.incremental import detect_stream

    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    files = files_of_three(docs)
    docs.repartition(3 * files, "doc_id").write.parquet(f"{folder}/in")
    index = detect_stream(spark, f"{folder}/in", docs.schema, "doc_id", {"n_chars": "n_chars", "digest": "md5(text)"}, f"{folder}/checkpoint", files)
    found = connected_components(index.edges(), "doc_id", "rep")
    return found.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("rep"))


@query("streaming_progress", "SELECT 3 AS batches, COUNT(*) AS rows, TRUE AS finished FROM events")
def streaming_progress(spark, sf):
    """Batches and rows that the listener was told of a stream in three batches."""
    from tessera.operators.graph import shared_folder
    from tessera.streaming import progress

    folder = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "ts")
    files = files_of_three(events)
    events.repartition(3 * files).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    return progress.as_rows(spark, progress.watched(writer, spark, f"progress-{uuid.uuid4().hex}"))
