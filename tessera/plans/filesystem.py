"""Registered queries over file trees, manifests, markers and logs (S1-S5, S12-S14, K1, K12, K17, V17), fingerprints (D1-D3), and what
else needs rows of its own. Trees are built from the small driver tables, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.errors import PythonException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import digest
from tessera.functions import expr as X
from tessera.operators import evidence, fingerprint, near, verify
from tessera.operators.graph import saved, shared_folder
from tessera.operators.lane_index import LaneIndex
from tessera.plans.registry import merkle_sql, query
from tessera.schemas import TRANSFORMS
from tessera.sources import files, fixtures, png, sinks
from tessera.sources.tables import table
from tessera.sources.tree_source import place, write_tree


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# One image per part, in its brand's album, of three formats; notes and a link per brand, an empty album, and an image outside all albums.
PARTS = """parts AS (SELECT replace(p_brand, '#', '-') AS album, p_name, p_partkey AS k, 10 + p_partkey % 200 AS w, 20 + p_partkey % 100 AS h, ['png', 'jpg', 'webp'][CAST(p_partkey % 3 AS INTEGER) + 1] AS kind FROM part),
  shots AS (SELECT *, album || '/' || CASE WHEN k % 4 = 0 THEN 'deep/' ELSE '' END || k || '.' || CASE WHEN k % 5 = 0 THEN upper(kind) ELSE kind END AS path, unhex(CASE kind
    WHEN 'png' THEN '89504E470D0A1A0A0000000D49484452' || format('{:08X}', w) || format('{:08X}', h) WHEN 'jpg' THEN 'FFD8FFC0001108' || format('{:04X}', h) || format('{:04X}', w)
    ELSE '524946460000000057454250565038580A00000000000000' || format('{:02X}', w - 1) || '0000' || format('{:02X}', h - 1) || '0000' END) || encode(p_name) AS content FROM parts),
  brands AS (SELECT DISTINCT album FROM parts), tree AS (SELECT path, content FROM shots UNION ALL SELECT album || '/notes.txt', encode('notes of ' || album) FROM brands UNION ALL SELECT 'loose.png', encode('no album'))"""


def sample_files(spark, sf):
    """(relative_path, content) of the sample tree; a row without content is a folder."""
    album, k = F.replace("p_brand", F.lit("#"), F.lit("-")), F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("png"), F.lit("jpg"), F.lit("webp")), (k % 3 + 1).cast("int"))
    path = F.concat(album, F.lit("/"), F.when(k % 4 == 0, "deep/").otherwise(""), k.cast("string"), F.lit("."), F.when(k % 5 == 0, F.upper(kind)).otherwise(kind))
    shots = table(spark, sf, "part").select(path.alias("relative_path"), F.concat(fixtures.image_header(kind, 10 + k % 200, 20 + k % 100), F.col("p_name").cast("binary")).alias("content"))
    brands = table(spark, sf, "part").select(album.alias("album")).distinct()
    notes = brands.select(F.concat("album", F.lit("/notes.txt")).alias("relative_path"), F.concat(F.lit("notes of "), "album").cast("binary").alias("content"))
    others = spark.createDataFrame([("loose.png", bytearray(b"no album")), ("Empty", None)], "relative_path string, content binary")
    return shots.unionByName(notes).unionByName(others)


def sample_tree(spark, sf):
    """The tree written by tasks, with links added afterwards."""
    root = fresh(spark, "tree")
    write_tree(sample_files(spark, sf), root)
    for r in table(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("album")).distinct().collect():  # one row a brand
        fixtures.link(root, f"{r.album}/linked.png", "../loose.png")
    return root


@query("s01_albums", f"WITH {PARTS} SELECT split_part(path, '/', 1) AS album, COUNT(*) AS files, CAST(SUM(octet_length(content)) AS BIGINT) AS bytes FROM tree WHERE contains(path, '/') GROUP BY 1 UNION ALL SELECT 'Empty', 0, 0")
def s01(spark, sf):
    return files.albums(spark, sample_tree(spark, sf))


@query("s02_images", f"WITH {PARTS} SELECT path AS relative_path, octet_length(content) AS file_size, split_part(path, '/', 1) AS album FROM tree WHERE NOT ends_with(path, '.txt')")
def s02(spark, sf):
    return files.images(spark, sample_tree(spark, sf)).select("relative_path", "file_size", "album")


@query(
    "s03_source_summary",
    f"""WITH {PARTS} SELECT (SELECT COUNT(*) + 1 FROM brands) AS albums, COUNT(*) AS images, CAST(SUM(octet_length(content)) AS BIGINT) AS bytes,
        (SELECT string_agg(album, ',' ORDER BY album) FROM (SELECT album FROM brands UNION ALL SELECT 'Empty')) AS names FROM shots""",
)
def s03(spark, sf):
    return files.source_summary(spark, sample_tree(spark, sf))


@query("s04_snapshot", f"WITH {PARTS} SELECT path AS relative_path, 'file' AS file_type, octet_length(content) AS file_size, sha256(content) AS hash FROM tree UNION ALL SELECT album || '/linked.png', 'link', 0, NULL FROM brands")
def s04(spark, sf):
    return files.snapshot(spark, sample_tree(spark, sf))


@query("d37_rejected_entries", f"WITH {PARTS} SELECT album || '/linked.png' AS relative_path, 'link' AS kind FROM brands")
def d37(spark, sf):
    return files.rejected(spark, sample_tree(spark, sf))


@query("s05_dimensions", f"WITH {PARTS} SELECT path AS relative_path, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height FROM shots UNION ALL SELECT 'loose.png', NULL, NULL")
def s05(spark, sf):
    return files.dimensions(spark, sample_tree(spark, sf)).select("relative_path", "width", "height")


@query(
    "k12_copy_tree",
    f"""WITH {PARTS}, kept AS (SELECT path, content FROM tree WHERE path <> (SELECT MIN(path) FROM tree))
        SELECT path AS relative_path, octet_length(content) AS file_size, sha256(content) AS hash, NULL AS error, true AS refused_first FROM kept
        UNION ALL SELECT MIN(path), NULL, NULL, 'missing', true FROM tree""",
)
def k12_tree(spark, sf):
    """A tree copied file by file with digests taken in passing: a copy that meets another digest than planned leaves nothing, the next one is
    published whole, and is then held against the tree with one file more than was planned."""
    root, target = sample_tree(spark, sf), fresh(spark, "copy")
    stored = saved(files.snapshot(spark, root).where("file_type = 'file'").select("relative_path", "file_size", "hash"), "copy-plan")
    first = stored.agg(F.min("relative_path")).first()[0]
    plan = stored.where(F.col("relative_path") != first).select("relative_path", F.concat(F.lit(f"{root}/"), "relative_path").alias("source"), F.col("file_size").alias("size"), "hash")
    try:
        write_tree(plan.withColumn("hash", F.when(F.xxhash64("relative_path") % 7 == 0, "another").otherwise(F.col("hash"))), target)
        refused = False
    except PythonException:
        refused = not place(target).exists("")
    write_tree(plan, target)
    actual = files.snapshot(spark, target).select("relative_path", "file_size", "hash")
    errors = verify.reconcile(stored, actual, "relative_path", ["file_size", "hash"])
    return actual.join(errors, "relative_path", "full_outer").withColumn("refused_first", F.lit(refused))


MANIFESTS = """plan AS (SELECT source, CAST(doc_id AS VARCHAR) AS path, n_chars, md5(text) AS h FROM documents),
  manifests AS (SELECT source, '{"version":1,"album":"' || source || '","files":[' || string_agg('{"path":"' || path || '","size":' || n_chars || ',"hash":"' || h || '"}', ',' ORDER BY path) || ']}' AS json, COUNT(*) AS n FROM plan GROUP BY source)"""


def plan_of(spark, sf):
    return table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "n_chars", F.md5("text").alias("digest"))


def manifests_of(spark, sf):
    return sinks.manifest_json(plan_of(spark, sf), "source", "path", "n_chars", "digest", {"version": F.lit(1)})


def written_texts(df, name):
    """Rows (source, value) as one text file per source."""
    folder = fresh(df.sparkSession, name)
    df.repartition("source").write.partitionBy("source").text(folder)
    return folder


@query("s12_manifest_read", f"WITH {MANIFESTS} SELECT source AS album, sha256(json || chr(10)) AS raw_hash, 1 AS version, n AS files FROM manifests")
def s12(spark, sf):
    folder = written_texts(manifests_of(spark, sf).select("source", F.col("json").alias("value")), "manifests")
    found = files.manifests(spark, f"{folder}/*/*.txt")
    return found.select("manifest.album", "raw_hash", "manifest.version", F.size("manifest.files").cast("long").alias("files"))


def headers_of(spark, sf):
    """Header facts of each album's marker: the manifest's digest, and values that the plan is known by."""
    hashed = manifests_of(spark, sf).select("source", F.sha2("json", 256).alias("manifest_hash"))
    return hashed.select(
        "source", F.lit("1").alias("schema_version"), F.concat(F.lit("tx-"), "source").alias("transaction_id"), F.md5("source").alias("plan_hash"), "manifest_hash", F.lit("marker-1").alias("publish_strategy_version")
    )


def markers_of(spark, sf):
    return sinks.commit_markers(plan_of(spark, sf), headers_of(spark, sf), "source", "path", "n_chars", "digest")


@query(
    "s13_marker_read",
    f"""WITH {MANIFESTS} SELECT '1' AS schema_version, 'tx-' || source AS transaction_id, md5(source) AS plan_hash, sha256(json) AS manifest_hash, 'marker-1' AS publish_strategy_version,
        source AS album_relative_path, n AS image_count, n AS files FROM manifests""",
)
def s13(spark, sf):
    folder = written_texts(markers_of(spark, sf).select("source", F.to_json("marker").alias("value")), "markers")
    return files.markers(spark, folder).select(*[F.col("marker")[f].alias(f) for f in sinks.MARKER_HEADER], F.size("marker.files").cast("long").alias("files"))


@query(
    "v17_marker_equals_plan",
    """WITH s AS (SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS k FROM documents)
       SELECT source, 'image_count_mismatch' AS fault FROM s WHERE k % 5 = 1 UNION ALL SELECT source, 'files' FROM s WHERE k % 5 IN (1, 2)
       UNION ALL SELECT source, 'plan_hash_mismatch' FROM s WHERE k % 5 = 3 UNION ALL SELECT source, 'missing' FROM s WHERE k % 5 = 4""",
)
def v17(spark, sf):
    """Markers read back from files: some lack a file, some hold another digest or plan hash, some are gone."""
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 5
    expected = saved(markers_of(spark, sf), "expected-markers")
    stored = expected.where(k != 4).withColumn("marker", F.when(k == 3, F.col("marker").withField("plan_hash", F.lit("other"))).otherwise(F.col("marker")))
    files_ = F.col("marker.files")
    less = F.col("marker").withField("files", F.slice(files_, 2, F.size(files_))).withField("image_count", F.col("marker.image_count") - 1)
    other = F.col("marker").withField("files", F.transform(files_, lambda f: f.withField("hash", F.upper(f["hash"]))))
    stored = stored.withColumn("marker", F.when(k == 1, less).when(k == 2, other).otherwise(F.col("marker")))
    read = files.markers(spark, written_texts(stored.select("source", F.to_json("marker").alias("value")), "markers"))
    read = read.select(F.col("marker.album_relative_path").alias("source"), "marker")
    return evidence.marker_faults(read, expected, "source", sinks.MARKER_HEADER, "relative_path", ["size", "hash"])


@query(
    "s14_log_tail",
    """WITH logs AS (SELECT CAST(n_regionkey AS BIGINT) AS file_rank, n_name AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, COUNT(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
       SELECT file_rank, line FROM logs WHERE file_rank < 3 AND k >= n - 4""",
)
def s14(spark, sf):
    """Five logs, one a region, the first the newest: the last four lines each of the three newest."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    root = fresh(spark, "logs")
    lines = {r.n_regionkey: [x.n_name for x in rows if x.n_regionkey == r.n_regionkey] for r in rows}
    names = {k: f"run{k}.log" for k in lines}
    fixtures.write_files(spark, root, {names[k]: ("\n".join(v) + "\n").encode() for k, v in lines.items()}, {names[k]: 1_700_000_000 - 60 * k for k in lines})
    return files.log_tail(spark, root, 3, 200, 4).select("file_rank", "line")


@query("k01_append", "SELECT o_orderkey, o_custkey FROM orders")
def k01(spark, sf):
    """Three appends to one table, the second of which repeats part of the first."""
    rows, folder = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), fresh(spark, "append")
    for part in ("o_orderkey % 3 = 0", "o_orderkey % 6 IN (0, 1)", "true"):
        out = sinks.append_new(rows.where(part), folder, ["o_orderkey"])
    return out


@query(
    "k12_copy_verdict",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'absent' WHEN doc_id % 5 = 0 THEN 'size_mismatch' WHEN md5(text) <> md5(lower(text)) THEN 'hash_mismatch' ELSE 'verified' END AS verdict FROM documents""",
)
def k12(spark, sf):
    docs = table(spark, sf, "documents")
    there = F.col("doc_id") % 7 != 0
    size = F.when(there, F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    verdict = evidence.copy_verdict(F.col("n_chars"), F.md5("text"), size, F.when(there, F.md5(F.lower("text"))))
    return docs.select("doc_id", verdict.alias("verdict"))


K17 = merkle_sql("SELECT source, length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length(CAST(n_chars AS VARCHAR)) || ':' || n_chars || '32:' || md5(text) AS t FROM documents", ["source"])


@query("k17_snapshot_append", f"SELECT source, hash, rows AS files, rows AS stored FROM ({K17})")
def k17(spark, sf):
    """A snapshot that is appended twice, the first time without its headers, is there once, complete."""
    rows, folder = plan_of(spark, sf), fresh(spark, "snapshot")
    sinks.append_new(rows.where("n_chars % 2 = 0").select("source", "path", "n_chars", "digest"), f"{folder}/files", ["source", "path"])
    for _ in range(2):
        headers, stored = sinks.append_snapshot(rows, folder, "source", "path", ["n_chars", "digest"])
    return headers.join(stored.groupBy("source").agg(F.count("*").alias("stored")), "source")


PIXELS = "pixels AS (SELECT vec_id, i, CAST(greatest(0, least(255, floor(CAST(embedding[i + 1] AS DOUBLE) * 64) + 128)) AS INTEGER) AS v FROM (SELECT vec_id, embedding, UNNEST(range(0, 64)) AS i FROM embeddings))"


def gray_level(v):
    """A value of an embedding as a gray level; its first 64 are an image."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 64).cast("int") + 128))


def as_images(rows):
    """(id, levels) as 8 x 8 gray images."""
    hexed = F.array_join(F.transform("levels", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return rows.select("id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.to_binary(hexed, F.lit("hex")).alias("pixels"))


def gray_images(spark, sf):
    return as_images(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 64), gray_level).alias("levels")))


# The 16 x 16 reduction repeats every pixel twice each way; a quarter of its rows is two rows of pixels.
BLOCK_HASH = """SELECT {keys}, string_agg(line || line, '' ORDER BY r) AS hash FROM (SELECT {keys}, r, printf('%04x', CAST(SUM(CASE WHEN v > m THEN 3 << CAST(14 - 2 * c AS INTEGER) ELSE 0 END) AS INTEGER)) AS line
    FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY {keys}, r // 2) AS m FROM cells) GROUP BY {keys}, r) GROUP BY {keys}"""


@query(
    "d01_fingerprints",
    f"""WITH {PIXELS}, cells AS (SELECT vec_id, v, i // 8 AS r, i % 8 AS c FROM pixels), b AS ({BLOCK_HASH.format(keys="vec_id")}),
        p AS (SELECT vec_id, sha256(unhex('0000000000000008' || '0000000000000008' || string_agg(printf('%02x', v), '' ORDER BY i))) AS pixel_hash FROM pixels GROUP BY vec_id)
        SELECT vec_id, hash AS block_hash, pixel_hash FROM b JOIN p USING (vec_id)""",
)
def d01(spark, sf):
    return fingerprint.fingerprints(gray_images(spark, sf)).select(F.col("id").alias("vec_id"), X.hex_lower(F.col("block_hash")).alias("block_hash"), "pixel_hash")


# A 17 x 17 reduction of the 8 x 8 pixels, in whole units: cell j covers [32 j, 32 j + 32), pixel p [68 p, 68 p + 68).
FINE_BITS = """SELECT {keys}, string_agg(CASE WHEN after > g THEN '1' ELSE '0' END, '' ORDER BY way, j, k) AS bits FROM (SELECT {keys}, 0 AS way, j, k, g, lead(g) OVER (PARTITION BY {keys}, j ORDER BY k) AS after FROM fine
    UNION ALL SELECT {keys}, 1, j, k, g, lead(g) OVER (PARTITION BY {keys}, k ORDER BY j) FROM fine) WHERE after IS NOT NULL GROUP BY {keys}"""
FINE = """SELECT {keys}, a.j, b.j AS k, SUM(v * a.w * b.w) AS g FROM cells JOIN covers a ON a.p = r JOIN covers b ON b.p = c GROUP BY {keys}, a.j, b.j"""
COVERS = "covers AS (SELECT j, p, w FROM (SELECT j, p, least(32 * j + 32, 68 * p + 68) - greatest(32 * j, 68 * p) AS w FROM range(0, 17) a(j), range(0, 8) b(p)) WHERE w > 0)"
ELIGIBLE = """SELECT {keys}, stddev_pop(v) >= 8 AND COUNT(DISTINCT v // 16) >= 4 AND 4 * (SUM(abs(v - right_)) + SUM(abs(v - below))) / 1984.0 >= 2
    AND SUM(CASE WHEN v > m THEN 4 ELSE 0 END) BETWEEN 4 AND 252 AS fit FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY {keys}, r // 2) AS m, coalesce(lead(v) OVER (PARTITION BY {keys}, r ORDER BY c), v) AS right_,
    coalesce(lead(v) OVER (PARTITION BY {keys}, c ORDER BY r), v) AS below FROM cells) GROUP BY {keys}"""


@query(
    "d02_eligibility",
    f"""WITH {PIXELS}, cells AS (SELECT vec_id, v, i // 8 AS r, i % 8 AS c FROM pixels), {COVERS}, fine AS ({FINE.format(keys="vec_id")}), f AS ({FINE_BITS.format(keys="vec_id")}), e AS ({ELIGIBLE.format(keys="vec_id")})
        SELECT vec_id, fit AND bit_count(CAST(bits AS BIT)) BETWEEN 8 AND 536 AS eligible FROM e JOIN f USING (vec_id)""",
)
def d02(spark, sf):
    return fingerprint.fingerprints(gray_images(spark, sf)).select(F.col("id").alias("vec_id"), "eligible")


# Where the cell (r, c) of a transformed image comes from.
MOVES = "(VALUES ('identity', 1, 0, 0, 1, 0, 0), ('rot90', 0, -1, 7, 1, 0, 0), ('rot180', -1, 0, 7, 0, -1, 7), ('rot270', 0, 1, 0, -1, 0, 7), ('flip_h', 1, 0, 0, 0, -1, 7), ('flip_v', -1, 0, 7, 0, 1, 0), ('transpose', 0, 1, 0, 1, 0, 0), ('transverse', 0, -1, 7, -1, 0, 7))"


@query(
    "d03_transforms",
    f"""WITH {PIXELS}, moves AS (SELECT * FROM {MOVES.replace("('identity', 1, 0, 0, 1, 0, 0)", "('identity', 1, 0, 0, 0, 1, 0)")} t(transform, rr, rc, r0, cr, cc, c0)),
        grid AS (SELECT r, c FROM range(0, 8) a(r), range(0, 8) b(c)), cells AS (SELECT vec_id, transform, r, c, v FROM moves, grid, pixels WHERE i = 8 * (rr * r + rc * c + r0) + (cr * r + cc * c + c0)),
        b AS ({BLOCK_HASH.format(keys="vec_id, transform")}) SELECT vec_id, transform, hash FROM b""",
)
def d03(spark, sf):
    rows = fingerprint.fingerprints(gray_images(spark, sf)).select(F.col("id").alias("vec_id"), F.inline("variants"))
    return rows.where(F.col("transform").isin(list(TRANSFORMS))).select("vec_id", "transform", X.hex_lower(F.col("hash")).alias("hash"))


@query("f10_time_parameter", "SELECT event_id, ts <= max_ts - INTERVAL 3600 SECOND AS expired FROM events, (SELECT MAX(ts) AS max_ts FROM events)")
def f10(spark, sf):
    """The clock is a parameter, here an hour before the last event, so that a rerun decides alike."""
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts")).first()[0]
    return events.select("event_id", (F.col("ts") <= F.lit(now) - F.expr("INTERVAL 3600 SECONDS")).alias("expired"))


@query("f12_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_text FROM events")
def f12(spark, sf):
    return table(spark, sf, "events").select("event_id", X.rfc3339(F.col("ts")).alias("ts_text"))


@query(
    "f23_sanitized_json",
    """SELECT n_nationkey, '{"run":{"DB_Password":"<redacted>","root":"<redacted-path>","steps":[{"api_token":"<redacted>","note":"password=<redacted> of ' || n_name || '"},"plain ' || n_name || '",' || n_nationkey || ',null],"staging_path":"<redacted-path>","ok":true}}' AS json FROM nation""",
)
def f23(spark, sf):
    """Objects in lists in objects: secrets and paths by key at any depth, other texts by their own words."""
    dirty = F.to_json(
        F.struct(
            F.struct(
                F.col("n_name").alias("DB_Password"), F.lit("/srv/library").alias("root"),
                F.lit("@steps@").alias("steps"), F.concat(F.lit("/srv/"), "n_name").alias("staging_path"), F.lit(True).alias("ok"),
            ).alias("run")
        )
    )
    steps = F.concat(F.lit('[{"api_token":["x",{"y":1}],"note":"password=hunter2 of '), "n_name", F.lit('"},"plain '), "n_name", F.lit('",'), F.col("n_nationkey").cast("string"), F.lit(",null]"))
    return table(spark, sf, "nation").select("n_nationkey", X.sanitized_json(F.replace(dirty, F.lit('"@steps@"'), steps)).alias("json"))


@query("a07_scalar_sum", "SELECT (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT COUNT(*) FROM documents WHERE n_chars > 500) AS pending")
def a07(spark, sf):
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    both = one(table(spark, sf, "orders").where("o_orderstatus = 'P'"), "a").join(F.broadcast(one(table(spark, sf, "documents").where("n_chars > 500"), "b")))  # one row each
    return both.select((F.col("a") + F.col("b")).alias("pending"))


@query("o12_first_slice", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, dense_rank() OVER (ORDER BY source) AS a FROM documents) WHERE n <= 24 AND a <= 50")
def o12(spark, sf):
    """What a first screen shows: 24 images each of the first 50 albums. The limits are the feature."""
    docs = table(spark, sf, "documents")
    first = docs.groupBy("source").count().orderBy("source").limit(50).select("source")
    # Spark cuts each partition's rows of an album to 24 before it shuffles them.
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.join(F.broadcast(first), "source").withColumn("place", place).where("place <= 24").select("source", "doc_id")


# A library of the same images, each turned by one of the eight transforms, some with a changed corner.
LIBRARY = f"""{PIXELS}, moves AS (SELECT *, row_number() OVER () - 1 AS turn FROM {MOVES.replace("('identity', 1, 0, 0, 1, 0, 0)", "('identity', 1, 0, 0, 0, 1, 0)")} t(transform, rr, rc, r0, cr, cc, c0)),
    grid AS (SELECT r, c FROM range(0, 8) a(r), range(0, 8) b(c)),
    shown AS (SELECT vec_id AS id, transform, r, c, v FROM moves, grid, pixels WHERE i = 8 * (rr * r + rc * c + r0) + (cr * r + cc * c + c0)),
    stored AS (SELECT s.id + 1000000 AS id, r, c, CASE WHEN s.id % 3 = 0 AND r = 0 AND c = 0 THEN 255 - v ELSE v END AS v FROM shown s JOIN moves USING (transform) WHERE s.id % 8 = turn),
    cells AS (SELECT id, transform, r, c, v FROM shown UNION ALL SELECT id, 'stored', r, c, v FROM stored), {COVERS},
    blocks AS (SELECT id, transform, CAST(from_hex(hash) AS BIT) AS hash FROM ({BLOCK_HASH.format(keys="id, transform")})),
    fine AS ({FINE.format(keys="id, transform")}), fines AS ({FINE_BITS.format(keys="id, transform")}), looks AS ({ELIGIBLE.format(keys="id, transform")}),
    fit AS (SELECT id FROM looks JOIN fines USING (id, transform) WHERE transform IN ('identity', 'stored') AND fit AND bit_count(CAST(bits AS BIT)) BETWEEN 8 AND 536)"""
RECALLED = """recalled AS (SELECT a.id AS left_id, b.id AS right_id, a.transform, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS block FROM blocks a JOIN blocks b ON a.transform <> 'stored' AND b.transform = 'stored'
    WHERE a.id IN (FROM fit) AND b.id IN (FROM fit) AND bit_count(xor(a.hash, b.hash)) <= 31)"""


def library_images(spark, sf):
    """The turned copies: cell (r, c) comes from the cell that the image's transform takes it from."""
    moves = {"identity": (1, 0, 0, 0, 1, 0), "rot90": (0, -1, 7, 1, 0, 0), "rot180": (-1, 0, 7, 0, -1, 7), "rot270": (0, 1, 0, -1, 0, 7), "flip_h": (1, 0, 0, 0, -1, 7), "flip_v": (-1, 0, 7, 0, 1, 0), "transpose": (0, 1, 0, 1, 0, 0), "transverse": (0, -1, 7, -1, 0, 7)}
    turns = F.array(*[F.array(*[F.lit(8 * (rr * r + rc * c + r0) + (cr * r + cc * c + c0) + 1) for r in range(8) for c in range(8)]) for rr, rc, r0, cr, cc, c0 in (moves[t] for t in TRANSFORMS)])
    turn = F.element_at(turns, (F.col("vec_id") % 8 + 1).cast("int"))
    # One step a cell: an array named first and picked from here would be built anew for each of its cells.
    level = lambda k, i: gray_level(F.element_at("embedding", k))
    changed = lambda k, i: F.when((F.col("vec_id") % 3 == 0) & (i == 0), 255 - level(k, i)).otherwise(level(k, i))
    return as_images(table(spark, sf, "embeddings").select((F.col("vec_id") + 1000000).alias("id"), F.transform(turn, changed).alias("levels")))


@query(
    "d06_image_recall",
    f"""WITH {LIBRARY}, {RECALLED}, tied AS (SELECT * FROM recalled QUALIFY block = MIN(block) OVER (PARTITION BY left_id, right_id)),
        tried AS (SELECT t.left_id, t.right_id, t.transform, block, CAST(bit_count(xor(CAST(f.bits AS BIT), CAST(g.bits AS BIT))) AS BIGINT) AS fine FROM tied t JOIN fines f ON f.id = left_id AND f.transform = t.transform JOIN fines g ON g.id = right_id)
        SELECT left_id, right_id, fine, block, transform, CASE WHEN block / 256 <= 0.04 AND fine / 544 <= 0.04 THEN 'near' WHEN block / 256 <= 0.12 AND fine / 544 <= 0.08 THEN 'similar' END AS match_type
        FROM tried QUALIFY ROW_NUMBER() OVER (PARTITION BY left_id, right_id ORDER BY fine, block, transform) = 1""",
)
def d06_images(spark, sf):
    """Recall over 256-bit hashes with all eight variants, tied transforms verified by 544-bit hashes, and classes."""
    probes = saved(fingerprint.fingerprints(gray_images(spark, sf)), "probes")
    stored = saved(fingerprint.fingerprints(library_images(spark, sf)), "library")
    return near.verified_images(probes, stored, near.recalled_images(probes, stored))


@query(
    "d30_perceptual_index",
    f"""WITH {LIBRARY}, {RECALLED}, tied AS (SELECT * FROM recalled WHERE right_id % 7 <> 0 QUALIFY block = MIN(block) OVER (PARTITION BY left_id, right_id))
        SELECT left_id, right_id, block AS least, list_sort(list(transform)) AS transforms FROM tied GROUP BY ALL""",
)
def d30_images(spark, sf):
    """The library kept as an index: some images came with another's hash and are updated, one in seven is removed, most are skipped."""
    folder = f"{shared_folder(spark)}/lane-index-{uuid.uuid4().hex}"
    stored = saved(fingerprint.fingerprints(library_images(spark, sf)), "library").select("id", F.when(F.col("eligible"), F.col("block_hash")).alias("hash"))
    index = LaneIndex(spark, folder, 32, buckets=16)
    first = F.when(F.col("id") % 5 == 0, F.unhex(F.sha2(F.col("id").cast("string"), 256))).otherwise(F.col("hash"))
    index.upsert(stored.where("id % 2 = 0").withColumn("hash", first))
    index.upsert(stored)
    index.remove(stored.where("id % 7 = 0"))
    probes = fingerprint.fingerprints(gray_images(spark, sf)).where("eligible").select("id", F.inline("variants"))
    return near.tied_transforms(index.near(probes, near.recall_radius(256), ["transform"]), ["left_id", "right_id"], "distance", "transform")


@query(
    "d39_fingerprint_probe",
    """WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || CASE WHEN s_suppkey % 10 = 5 THEN '.jpg' ELSE '.png' END AS relative_path FROM supplier), xy AS (SELECT x, y FROM range(0, 64) a(x), range(0, 64) b(y)),
       h AS (SELECT k, sha256(unhex('00000000000000400000000000000040' || string_agg(printf('%02x%02x%02x', (4 * x + k) % 256, (4 * y + k) % 256, (2 * (x + y) + k) % 256), '' ORDER BY y, x))) AS pixel_hash FROM s, xy WHERE k % 5 > 0 GROUP BY k)
       SELECT relative_path, CASE WHEN k % 5 > 0 THEN 64 END AS width, CASE WHEN k % 5 > 0 THEN 64 END AS height, pixel_hash, CASE WHEN k % 5 > 0 THEN 256 END AS block_bits, CASE WHEN k % 5 > 0 THEN 544 END AS fine_bits,
         CASE WHEN k % 10 = 0 THEN 'cut or damaged' WHEN k % 10 = 5 THEN 'not a PNG file' END AS error FROM s LEFT JOIN h USING (k)""",
)
def d39(spark, sf):
    """Gradient samples written as image files, some cut short or of another kind, and probed where they lie."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("shift"))
    k = F.col("id") % 10
    name = F.concat(F.lit("s"), F.col("id").cast("string"), F.when(k == 5, ".jpg").otherwise(".png"))
    cut = F.expr("substring(content, 1, octet_length(content) - 20)")
    root = fresh(spark, "samples")
    write_tree(png.gradient_samples(rows).select(name.alias("relative_path"), F.when(k == 0, cut).when(k == 5, F.unhex(F.lit("FFD8FFC000110800400040"))).otherwise(F.col("content")).alias("content")), root)
    bits = lambda c: (8 * F.octet_length(c)).alias(c.replace("hash", "bits"))
    return png.probe(spark, root).select("relative_path", "width", "height", "pixel_hash", bits("block_hash"), bits("fine_hash"), "error")


@query("f18_blake3")
def f18_blake3(spark, sf):
    """BLAKE3 of every text; no SQL has it, so it is tested against plain Python and published digests."""
    return table(spark, sf, "documents").select("doc_id", X.hex_lower(digest.blake3(F.col("text").cast("binary"))).alias("blake3"))
