"""Registered queries of the relational pack: predicates, joins, aggregates, windows, order, sets, functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.functions import paths
from tessera.plans.registry import query
from tessera.sources.tables import table

W = Window
long = lambda c: c.cast("long")


# Predicates and projections (P*)
@query("p01_projection", "SELECT o_orderkey AS run_id, o_orderstatus AS state FROM orders")
def p01(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("state"))


@query("p02_in_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderpriority NOT IN ('1-URGENT','2-HIGH')")
def p02(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "F") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("p03_is_null_flag", "SELECT d.doc_id, l.quality IS NULL AS undecided FROM documents d LEFT JOIN labels l USING (doc_id)")
def p03(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.col("quality").isNull().alias("undecided"))


@query("p04_distinct_from", "SELECT d.doc_id, l.quality IS DISTINCT FROM l.toxic AS differs FROM documents d LEFT JOIN labels l USING (doc_id)")
def p04(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", (~F.col("quality").eqNullSafe(F.col("toxic"))).alias("differs"))


@query("p05_nullable_disjunction", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality IN (1)")
def p05(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.where(F.col("quality").isNull() | F.col("quality").isin(1)).select("doc_id")


@query(
    "p06_searched_case",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'recover' WHEN event_type = 'purchase' AND value > 20 THEN 'review'
       WHEN event_type = 'purchase' THEN 'plan' WHEN value < 5 THEN 'skip' ELSE 'new' END AS route FROM events""",
)
def p06(spark, sf):
    from tessera.functions.states import chain

    kind, value = F.col("event_type"), F.col("value")
    route = chain([(kind == "error", "recover"), ((kind == "purchase") & (value > 20), "review"), (kind == "purchase", "plan"), (value < 5, "skip")], "new")
    return table(spark, sf, "events").select("event_id", route.alias("route"))


@query(
    "p07_priority_map",
    "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS priority FROM events",
)
def p07(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.when(kind == "error", 0).when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(3).alias("priority"))


@query(
    "p08_coalesce_family",
    """SELECT d.doc_id, COALESCE(l.quality, -1) AS quality, NULLIF(l.toxic, 0) AS toxic,
       least(d.n_chars, 1000) AS low, greatest(d.n_chars, 1000) AS high FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def p08(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif(F.col("toxic"), F.lit(0)).alias("toxic"), F.least(n, F.lit(1000)).alias("low"), F.greatest(n, F.lit(1000)).alias("high"))


@query("p09_negated_case", "SELECT event_id FROM events WHERE NOT CASE WHEN event_type = 'view' THEN value > 10 ELSE value > 30 END")
def p09(spark, sf):
    return table(spark, sf, "events").where(~F.when(F.col("event_type") == "view", F.col("value") > 10).otherwise(F.col("value") > 30)).select("event_id")


@query("p10_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05 AND l_quantity BETWEEN 5 AND 10")
def p10(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_discount").between(0.02, 0.05) & F.col("l_quantity").between(5, 10)).select("l_orderkey", "l_linenumber")


def optional_filter(df, column, least=None):
    """column >= least where a bound is given, all rows where it is not."""
    return df if least is None else df.where(F.col(column) >= least)


@query("p11_optional_parameter", "SELECT 'bounded' AS form, COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION ALL SELECT 'open', COUNT(*) FROM orders")
def p11(spark, sf):
    orders = table(spark, sf, "orders")
    bounded = optional_filter(orders, "o_orderdate", F.to_timestamp(F.lit("1998-01-01")))
    return bounded.agg(F.count("*").alias("n")).select(F.lit("bounded").alias("form"), "n").unionByName(optional_filter(orders, "o_orderdate").agg(F.count("*").alias("n")).select(F.lit("open").alias("form"), "n"))


KEYSET_SQL = "(o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND (o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 500))))"


@query("p12_keyset_predicate", f"SELECT o_orderkey FROM orders WHERE {KEYSET_SQL}")
def p12(spark, sf):
    import datetime

    after = X.keyset_after([(F.col("o_orderdate"), datetime.datetime(1997, 6, 1), True), (F.col("o_orderpriority"), "2-HIGH", False), (F.col("o_orderkey"), 500, False)])
    return table(spark, sf, "orders").where(after).select("o_orderkey")


@query(
    "p13_exists_flag",
    "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_return FROM orders",
)
def p13(spark, sf):
    hit = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    return table(spark, sf, "orders").join(hit, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("has_return"))


@query("p14_extension_filter", "SELECT page_id FROM pages WHERE lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) LIKE '%.com'")
def p14(spark, sf):
    return table(spark, sf, "pages").where(F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).endswith(".com")).select("page_id")


@query("p15_filtered_members", "SELECT conv_id, COUNT(*) FILTER (WHERE role = 'assistant' AND length(text) > 100) AS kept FROM conversations GROUP BY conv_id")
def p15(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(F.count_if((F.col("role") == "assistant") & (F.length("text") > 100)).alias("kept"))


# Joins (J*)
@query("j01_inner", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j01(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("j02_left_null_test", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def j02(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j03_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 1000")
def j03(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal >= 1000").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query(
    "j04_star",
    """SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, cn.n_name AS customer_nation, s_name, sn.n_name AS supplier_nation, p_name
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
       LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN part ON l_partkey = p_partkey""",
)
def j04(spark, sf):
    nation = table(spark, sf, "nation")
    named = lambda p: nation.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_name").alias(f"{p}_nation"))
    out = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(named("customer"), F.col("c_nationkey") == F.col("customer_key"), "left")
    out = out.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(named("supplier"), F.col("s_nationkey") == F.col("supplier_key"), "left")
    return out.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").select(
        "l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "customer_nation", "s_name", "supplier_nation", "p_name"
    )


@query(
    "j05_polymorphic",
    """SELECT event_id, c.c_name, s.s_name FROM events e LEFT JOIN customer c ON e.event_type = 'purchase' AND c.c_custkey = e.user_id
       LEFT JOIN supplier s ON e.event_type <> 'purchase' AND s.s_suppkey = e.user_id""",
)
def j05(spark, sf):
    e, c, s = (table(spark, sf, t) for t in ("events", "customer", "supplier"))
    import_side = e.where("event_type = 'purchase'").join(c, F.col("c_custkey") == F.col("user_id"), "left").select("event_id", "c_name", F.lit(None).cast("string").alias("s_name"))
    library_side = e.where("NOT (event_type = 'purchase') OR event_type IS NULL").join(s, F.col("s_suppkey") == F.col("user_id"), "left")
    return import_side.unionByName(library_side.select("event_id", F.lit(None).cast("string").alias("c_name"), "s_name"))


@query("j06_left_filter_in_on", "SELECT o_orderkey, COUNT(l_orderkey) AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def j06(spark, sf):
    back = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").join(back, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("returned"))


@query(
    "j07_self_join_in_group",
    """SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b FROM conversations a JOIN conversations b
       ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn < b.turn AND COALESCE(length(a.text), 0) = COALESCE(length(b.text), 0)""",
)
def j07(spark, sf):
    keyed = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    a = keyed.withColumnRenamed("turn", "turn_a")
    b = keyed.withColumnRenamed("turn", "turn_b")
    return a.join(b, ["conv_id", "role", "size"]).where("turn_a < turn_b").select("conv_id", "turn_a", "turn_b")


@query("j08_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def j08(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey")


@query("j09_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j09(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


@query(
    "j10_nested_anti",
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
       WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey))""",
)
def j10(spark, sf):
    # Offenders first (an anti-join), then the customers that have one: the inner level never reads the outermost row.
    c, o, l, s = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "supplier"))  # noqa: E741
    lines = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "l_suppkey", "c_nationkey")
    offenders = lines.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "left_anti")
    return c.join(offenders.select("c_custkey").distinct(), "c_custkey", "left_semi").select("c_custkey")


@query("j11_single_rows", "SELECT a.n AS orders, b.n AS lines FROM (SELECT COUNT(*) n FROM orders) a, (SELECT COUNT(*) n FROM lineitem) b")
def j11(spark, sf):
    count = lambda t, name: table(spark, sf, t).agg(F.count("*").alias(name))
    return count("orders", "orders").join(F.broadcast(count("lineitem", "lines")))  # one row each


@query("j12_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def j12(spark, sf):
    small = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(small, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j13_lookup", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def j13(spark, sf):
    return table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")


@query(
    "j14_full_outer",
    """SELECT COALESCE(a.source, b.source) AS source, a.n AS long_docs, b.n AS short_docs FROM (SELECT source, COUNT(*) n FROM documents WHERE n_chars > 8000 GROUP BY source) a
       FULL OUTER JOIN (SELECT source, COUNT(*) n FROM documents WHERE n_chars < 60 GROUP BY source) b ON a.source = b.source""",
)
def j14(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.where("n_chars > 8000").groupBy("source").agg(F.count("*").alias("long_docs"))
    return a.join(docs.where("n_chars < 60").groupBy("source").agg(F.count("*").alias("short_docs")), "source", "full_outer")


@query("j17_pairs_on_shared", "SELECT DISTINCT least(a.lang, b.lang) AS lang_a, greatest(a.lang, b.lang) AS lang_b, a.source FROM documents a JOIN documents b ON a.source = b.source AND a.lang < b.lang")
def j17(spark, sf):
    kinds = table(spark, sf, "documents").select("source", "lang").distinct()
    b = kinds.withColumnRenamed("lang", "lang_b")
    return kinds.withColumnRenamed("lang", "lang_a").join(b, "source").where("lang_a < lang_b").select("lang_a", "lang_b", "source")


@query("j18_after_marker", "SELECT o_orderkey FROM orders, (SELECT min(ts) - INTERVAL 27 YEAR AS t FROM events) m WHERE o_orderdate > m.t")
def j18(spark, sf):
    marker = table(spark, sf, "events").agg((F.min("ts") - F.expr("INTERVAL '27' YEAR")).alias("t"))
    return table(spark, sf, "orders").join(F.broadcast(marker), F.col("o_orderdate") > F.col("t")).select("o_orderkey")  # the marker is one row


# Aggregations (A*)
@query("a01_count", "SELECT COUNT(*) AS n FROM lineitem")
def a01(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query(
    "a02_filtered_counts",
    """SELECT l_suppkey, COUNT(*) AS total, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS open_,
       COUNT(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY l_suppkey""",
)
def a02(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open_"), F.count_if(F.col("l_quantity") > 25).alias("large")
    )


@query("a03_filtered_distinct", "SELECT o_custkey, COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def a03(spark, sf):
    lines = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return lines.groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned_parts"))


@query(
    "a04_child_counts",
    """SELECT c_custkey, COUNT(DISTINCT o_orderkey) AS orders, COUNT(DISTINCT event_id) AS events FROM customer
       LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""",
)
def a04(spark, sf):
    # Each child is counted before the join, so nothing fans out.
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"))
    events = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("e"))
    zero = F.lit(0).cast("long")
    return table(spark, sf, "customer").join(orders, "c_custkey", "left").join(events, "c_custkey", "left").select("c_custkey", F.coalesce("o", zero).alias("orders"), F.coalesce("e", zero).alias("events"))


@query("a05_sum_or_zero", "SELECT s_suppkey, CAST(COALESCE(SUM(l_quantity), 0) AS BIGINT) AS quantity FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def a05(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, sf, "supplier").join(sums, "s_suppkey", "left").select("s_suppkey", long(F.coalesce("q", F.lit(0.0))).alias("quantity"))


@query(
    "a06_dashboard",
    """SELECT (SELECT COUNT(*) FROM orders) AS runs, (SELECT COUNT(*) FROM lineitem) AS albums, (SELECT COUNT(*) FROM documents) AS images,
       (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM documents) AS both_, (SELECT CAST(SUM(n_chars) AS BIGINT) FROM documents) AS bytes""",
)
def a06(spark, sf):
    one = lambda t, *aggs: table(spark, sf, t).agg(*aggs)
    row = one("orders", F.count("*").alias("runs")).join(F.broadcast(one("lineitem", F.count("*").alias("albums"))))
    row = row.join(F.broadcast(one("documents", F.count("*").alias("images"), F.sum("n_chars").alias("bytes"))))  # one row each
    return row.select("runs", "albums", "images", (F.col("runs") + F.col("images")).alias("both_"), "bytes")


@query(
    "a08_conditional_source",
    """SELECT d.source, CASE WHEN MAX(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN COUNT(*) FILTER (WHERE l.quality = 0) ELSE COUNT(*) END AS pending
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""",
)
def a08(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    out = joined.groupBy("source").agg(F.max("has").alias("any"), F.count_if(F.col("quality") == 0).alias("low"), F.count("*").alias("all_"))
    return out.select("source", F.when(F.col("any") == 1, F.col("low")).otherwise(F.col("all_")).alias("pending"))


@query("a09_next_version", "SELECT o_custkey, COALESCE(MAX(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY o_custkey")
def a09(spark, sf):
    from tessera.operators.planning import next_version

    return next_version(table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query("a10_having_distinct", "SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem GROUP BY 1, 2 HAVING COUNT(DISTINCT l_returnflag) > 1")
def a10(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy(X.pair_low("l_partkey", "l_suppkey").alias("low"), X.pair_high("l_partkey", "l_suppkey").alias("high"))
    return pairs.agg(F.count_distinct("l_returnflag").alias("n")).where("n > 1").select("low", "high")


@query("a11_min_not_null", "SELECT source, MIN(quality) FILTER (WHERE quality IS NOT NULL) AS lowest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a11(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.min("quality").alias("lowest"))


@query(
    "a12_group_summary",
    """SELECT o_orderkey, o_orderstatus, COUNT(l_orderkey) AS members, COUNT(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS excluded, COUNT(l_orderkey) FILTER (WHERE l_linestatus = 'F') AS kept
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""",
)
def a12(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("members"), F.count_if(F.col("l_returnflag") == "R").alias("excluded"), F.count_if(F.col("l_linestatus") == "F").alias("kept")
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").na.fill(0, ["members", "excluded", "kept"])


@query("a13_histogram", "SELECT o_orderstatus AS state, COUNT(*) AS n FROM orders GROUP BY 1")
def a13(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("a14_catalog_totals", "SELECT COUNT(DISTINCT source) AS albums, COUNT(*) AS images, CAST(SUM(n_chars) AS BIGINT) AS bytes FROM documents")
def a14(spark, sf):
    by_album = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("b"))
    return by_album.agg(F.count("source").alias("albums"), F.sum("n").alias("images"), F.sum("b").alias("bytes"))


@query("a15_album_totals", "SELECT n_name, COUNT(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def a15(spark, sf):
    counts = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, sf, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))


@query("a18_plan_rollup", "SELECT source, COUNT(*) AS images, COUNT(*) FILTER (WHERE keep) AS included, COUNT(*) FILTER (WHERE NOT keep) AS skipped, CAST(COALESCE(SUM(n_chars) FILTER (WHERE keep), 0) AS BIGINT) AS bytes, COUNT(*) FILTER (WHERE keep) > 0 AS planned FROM (SELECT d.*, COALESCE(l.quality, 1) = 1 AS keep FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source")
def a18(spark, sf):
    from tessera.operators.planning import plan_images, plan_rollup

    docs = table(spark, sf, "documents")
    kept = plan_images(docs, table(spark, sf, "labels").where("quality = 0"), "doc_id", F.lit(True))
    return plan_rollup(docs, kept, "doc_id", "source", "n_chars")


@query(
    "a19_table_fingerprint",
    """SELECT 'nation' AS table_name, CAST(SUM(n) AS BIGINT) AS row_count, md5(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS fingerprint
       FROM (SELECT md5(concat_ws(chr(31), CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS h, COUNT(*) AS n FROM nation GROUP BY 1)""",
)
def a19(spark, sf):
    from tessera.operators.verify import table_fingerprint

    return table_fingerprint(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"]).select(F.lit("nation").alias("table_name"), "row_count", "fingerprint")


EQUAL_SQL = "NOT EXISTS ({a} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {a})"
COMPARED = {
    "nation": ("SELECT n_nationkey, n_name FROM nation", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name"),
    "customer": ("SELECT c_custkey, c_nationkey FROM customer", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer"),
    "part": ("SELECT p_partkey, p_name FROM part", "SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey = 3"),
    "supplier": ("SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier WHERE s_suppkey > 1"),
}


@query("a20_fingerprint_compare", " UNION ALL ".join(f"SELECT '{name}' AS table_name, {EQUAL_SQL.format(a=f'({a})', b=f'({b})')} AS equal" for name, (a, b) in COMPARED.items()))
def a20(spark, sf):
    """Tables against reordered, changed, repeated and shortened copies, by row count and fingerprint."""
    from tessera.operators.verify import table_fingerprint

    change = F.when(F.col("c_custkey") % 100 == 7, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey")
    nation, customer, part, supplier = (table(spark, sf, t).select(*c) for t, c in (("nation", ["n_nationkey", "n_name"]), ("customer", ["c_custkey", "c_nationkey"]), ("part", ["p_partkey", "p_name"]), ("supplier", ["s_suppkey"])))
    pairs = {
        "nation": (nation, nation.orderBy("n_name")), "customer": (customer, customer.select("c_custkey", change)),
        "part": (part, part.unionByName(part.where("p_partkey = 3"))), "supplier": (supplier, supplier.where("s_suppkey > 1")),
    }
    out = None
    for name, (a, b) in pairs.items():
        both = table_fingerprint(a, a.columns).join(F.broadcast(table_fingerprint(b, b.columns).toDF("n2", "f2")))  # one row each
        found = both.select(F.lit(name).alias("table_name"), ((F.col("row_count") == F.col("n2")) & (F.col("fingerprint") == F.col("f2"))).alias("equal"))
        out = found if out is None else out.unionByName(found)
    return out


@query("a21_metric_counts", "SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 25) AS high, COUNT(*) FILTER (WHERE value <= 25) AS low FROM events GROUP BY event_type")
def a21(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 25).alias("high"), F.count_if(F.col("value") <= 25).alias("low"))


@query("a22_statistics_json", """SELECT '{"orders":' || (SELECT COUNT(*) FROM orders) || ',"lines":' || (SELECT COUNT(*) FROM lineitem) || '}' AS statistics""")
def a22(spark, sf):
    return j11(spark, sf).select(F.to_json(F.struct("orders", "lines")).alias("statistics"))


@query(
    "a23_headroom",
    "SELECT o_orderstatus, CAST(SUM(greatest(CAST(floor(o_totalprice) AS BIGINT), 0) + CASE WHEN o_orderstatus IN ('O','P') THEN 1048576 ELSE 0 END) AS BIGINT) AS bytes FROM orders GROUP BY 1",
)
def a23(spark, sf):
    size = F.greatest(F.floor("o_totalprice"), F.lit(0)) + F.when(F.col("o_orderstatus").isin("O", "P"), 1024 * 1024).otherwise(0)
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.sum(size).alias("bytes"))


# Windows and arg-min (W*)
@query("w01_rank_pairs", "SELECT low, high, l_orderkey, l_linenumber FROM (SELECT least(l_partkey, l_suppkey) low, greatest(l_partkey, l_suppkey) high, l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY (l_returnflag = 'R') DESC, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END, l_shipdate, l_orderkey, l_linenumber, l_extendedprice) rn FROM lineitem) WHERE rn = 1")
def w01(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns({"low": X.pair_low("l_partkey", "l_suppkey"), "high": X.pair_high("l_partkey", "l_suppkey")})
    w = W.partitionBy("low", "high").orderBy((F.col("l_returnflag") == "R").desc(), F.when(F.col("l_linestatus") == "F", 0).otherwise(1), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("low", "high", "l_orderkey", "l_linenumber")


@query("w02_rank_ordered_pairs", "SELECT l_partkey, l_suppkey, MIN(l_orderkey) AS first_order FROM lineitem GROUP BY ALL")
def w02(spark, sf):
    w = W.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey")
    return table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("first_order"))


@query("w03_distinct_on", "SELECT n_chars, md5(text) AS digest, MIN(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def w03(spark, sf):
    return table(spark, sf, "documents").groupBy("n_chars", F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("w05_argmin_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) rn FROM events) WHERE rn = 1")
def w05(spark, sf):
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(priority, "ts", "event_id")).alias("event_id"))


@query("w07_keep_ties", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) r FROM lineitem) WHERE r = 1")
def w07(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_quantity")
    return table(spark, sf, "lineitem").withColumn("r", F.rank().over(w)).where("r = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("w08_top_k_flag", "SELECT user_id, event_id, place, found > 5 AS truncated FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value, event_id) place, COUNT(*) OVER (PARTITION BY user_id) found FROM events) WHERE place <= 5")
def w08(spark, sf):
    from tessera.operators.near import top_recall

    return top_recall(table(spark, sf, "events"), "user_id", "event_id", "value", most=5).select("user_id", "event_id", long(F.col("place")).alias("place"), "truncated")


# Order, limits and paging (O*): the limits are the feature.
@query("o01_sorted", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey")
def o01(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("o03_route_one", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 1")
def o03(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")


@query("o04_nulls_last", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 25")
def o04(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.orderBy(F.desc_nulls_last("quality"), "doc_id").limit(25).select("doc_id", "quality")


@query("o05_recents", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def o05(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts")


@query("o06_keyset_page", f"SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE {KEYSET_SQL} ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey LIMIT 18")
def o06(spark, sf):
    import datetime

    from tessera.operators.paging import page

    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return page(orders, [("o_orderdate", True), ("o_orderpriority", False), ("o_orderkey", False)], 17, (datetime.datetime(1997, 6, 1), "2-HIGH", 500))


@query("o11_latest_per_key", "SELECT o_custkey, MAX(o_orderkey) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def o11(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("latest"))


# Set operations (U*)
@query("u01_union", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 UNION SELECT l_suppkey FROM lineitem WHERE l_tax = 0")
def u01(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.where("l_quantity > 40").select(F.col("l_partkey").alias("k")).union(lines.where("l_tax = 0").select("l_suppkey")).distinct()


@query("u02_union_all", "SELECT c_custkey AS id, c_name AS name, 'import' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 'library' FROM supplier")
def u02(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("import").alias("origin"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("library").alias("origin")))


@query("u03_set_equality", "SELECT (SELECT COUNT(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS labels_known, (SELECT COUNT(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS all_labelled")
def u03(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")  # noqa: E741
    none = lambda df, name: df.agg((F.count("*") == 0).alias(name))
    return none(l.join(d, "doc_id", "left_anti"), "labels_known").join(F.broadcast(none(d.join(l, "doc_id", "left_anti"), "all_labelled")))  # one row each


@query("u04_differences", "SELECT user_id AS id, 'extra' AS side FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'missing' FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)")
def u04(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return e.join(c, "id", "left_anti").withColumn("side", F.lit("extra")).unionByName(c.join(e, "id", "left_anti").withColumn("side", F.lit("missing")))


@query("u05_minus_ignored", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax = 0.02) AND p_size > 10")
def u05(spark, sf):
    back = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_tax = 0.02").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").where("p_size > 10").join(back, "p_partkey", "left_anti").select("p_partkey")


# Scalar functions (F*)
@query("f01_joined_path", r"SELECT p_partkey, concat_ws('\', NULLIF(p_brand, ''), NULLIF(p_type, ''), NULLIF(p_name, '')) AS path FROM part")
def f01(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.joined_path(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("path"))


@query("f04_without_album", "SELECT doc_id, 'img_' || doc_id || '.PNG' AS rest, 'png' AS ext FROM documents")
def f04(spark, sf):
    path = F.concat("source", F.lit("/img_"), "doc_id", F.lit(".PNG"))
    return table(spark, sf, "documents").select("doc_id", X.without_album(path, F.col("source")).alias("rest"), X.extension(path).alias("ext"))


@query("f05_normal_path", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages WHERE NOT regexp_matches(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '//|/[.]|/$|[.]$')")
def f05(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").where(~bare.rlike("//|/[.]|/$|[.]$")).select("page_id", paths.normal_path(bare).alias("path"))


@query("f06_conflict_key_whole", "SELECT doc_id, lower(nfc_normalize(text)) AS key FROM documents")
def f06_whole(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paths.conflict_key(F.col("text")).alias("key"))


@query("f11_intervals", "SELECT event_id, strftime(ts + INTERVAL 300 SECOND, '%Y-%m-%dT%H:%M:%S.%fZ') AS expires FROM events")
def f11(spark, sf):
    return table(spark, sf, "events").select("event_id", X.rfc3339(F.col("ts") + F.expr("INTERVAL '300' SECOND")).alias("expires"))


@query("f13_hamming", "SELECT a.vec_id, CAST(bit_count(xor(a.vec_id * 2654435761, a.label * 40503)) AS BIGINT) AS distance FROM embeddings a")
def f13(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", long(X.hamming64(F.col("vec_id") * 2654435761, long(F.col("label")) * 40503)).alias("distance"))


@query("f15_similarity", "SELECT l_orderkey, l_linenumber, CAST(round(greatest(least(1 - (0.4 * l_discount + 0.6 * l_tax), 1), 0) * 10000) AS BIGINT) AS similarity FROM lineitem")
def f15(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", long(F.round(X.similarity(F.col("l_discount"), F.col("l_tax")) * 10000)).alias("similarity"))


@query("f19_digests", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def f19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha"), long(F.octet_length("text")).alias("bytes"))


@query("f22_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f22(spark, sf):
    return table(spark, sf, "events").select("event_id", long(F.get_json_object("props", "$.k")).alias("k"))


@query("f25_legacy_state", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS base FROM orders")
def f25(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.legacy_state(F.replace("o_orderpriority", F.lit("-"), F.lit(": "))).alias("base"))
