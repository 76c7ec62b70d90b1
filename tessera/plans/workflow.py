"""Registered queries of the workflow's decisions: routing, reconciliation, state machines, validation (D26-D42, V*).

Orders stand for runs, line items for their albums and transactions; states follow from keys and dates, so that both
engines see the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import states as S
from tessera.operators import routing
from tessera.plans.registry import query
from tessera.sources.tables import table


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RUN_SQL = f"runs AS (SELECT o_orderkey AS id, {listed(schemas.RUN_STATES)}[CAST(o_orderkey % {len(schemas.RUN_STATES)} AS INTEGER) + 1] AS state, o_orderdate AS started_at FROM orders)"
ALBUM_SQL = f"albums AS (SELECT l_orderkey AS run_id, CAST(l_partkey AS BIGINT) AS album_id, {listed(schemas.ALBUM_STATES)}[CAST(l_partkey % {len(schemas.ALBUM_STATES)} AS INTEGER) + 1] AS state, CAST(l_quantity AS BIGINT) AS image_count, CAST(l_linenumber % 3 AS BIGINT) AS review_count FROM lineitem)"
TX_SQL = f"txs AS (SELECT l_orderkey AS run_id, CAST(l_partkey AS BIGINT) AS album_id, {listed(schemas.TRANSACTION_STATES)}[CAST(l_suppkey % {len(schemas.TRANSACTION_STATES)} AS INTEGER) + 1] AS state FROM lineitem WHERE l_returnflag = 'R')"
PLAN_SQL = "plans AS (SELECT l_orderkey AS run_id, CAST(l_partkey AS BIGINT) AS album_id FROM lineitem WHERE l_returnflag <> 'N')"


def _state(values: list[str], key):
    at = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def runs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _state(schemas.RUN_STATES, "o_orderkey").alias("state"), F.col("o_orderdate").alias("started_at"))


def albums(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("album_id"), _state(schemas.ALBUM_STATES, "l_partkey").alias("state"),
        F.col("l_quantity").cast("long").alias("image_count"), (F.col("l_linenumber") % 3).cast("long").alias("review_count"),
    )


def transactions(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("album_id"), _state(schemas.TRANSACTION_STATES, "l_suppkey").alias("state"))


def planned(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("album_id"))


IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
FACT_SQL = f"""{RUN_SQL}, {ALBUM_SQL}, {TX_SQL}, {PLAN_SQL},
facts AS (SELECT r.*, EXISTS (SELECT 1 FROM plans p WHERE p.run_id = r.id) AS has_plan, EXISTS (SELECT 1 FROM txs t WHERE t.run_id = r.id) AS has_tx,
  EXISTS (SELECT 1 FROM txs t WHERE t.run_id = r.id AND t.state IN {IN(schemas.RECOVERABLE_STATES)}) AS recoverable,
  EXISTS (SELECT 1 FROM txs t WHERE t.run_id = r.id AND t.state IN {IN(schemas.UNRESOLVED_STATES)}) AS unresolved,
  EXISTS (SELECT 1 FROM plans p WHERE p.run_id = r.id AND NOT EXISTS (SELECT 1 FROM txs t WHERE t.run_id = r.id AND t.album_id = p.album_id)) AS missing,
  EXISTS (SELECT 1 FROM plans p WHERE p.run_id = r.id AND NOT EXISTS (SELECT 1 FROM txs t WHERE t.run_id = r.id AND t.album_id = p.album_id AND t.state = 'source_archived')) AS unfinished_plan,
  (SELECT COUNT(*) FROM albums a WHERE a.run_id = r.id AND a.state = 'pending') AS pending_albums, (SELECT COUNT(*) FROM albums a WHERE a.run_id = r.id AND a.state = 'analyzing') AS analyzing_albums,
  (SELECT COUNT(*) FROM albums a WHERE a.run_id = r.id AND a.state = 'failed') AS failed_albums, (SELECT COALESCE(SUM(review_count), 0) FROM albums a WHERE a.run_id = r.id) AS pending_reviews FROM runs r)"""
ROUTE_SQL = """CASE WHEN recoverable THEN 'recover' WHEN state = 'review_required' AND pending_reviews > 0 THEN 'review' WHEN state = 'review_required' THEN 'generate_plan'
 WHEN state = 'cancelled' AND has_plan AND NOT unresolved THEN 'resume_commit' WHEN state IN ('committing', 'recovery_required') AND has_plan AND missing THEN 'resume_commit'
 WHEN state IN ('committing', 'recovery_required') AND unresolved THEN 'inspect_transaction_failure' WHEN state IN ('committing', 'recovery_required') AND has_plan THEN 'resume_commit'
 WHEN state IN ('committing', 'recovery_required') THEN 'inspect_transaction_failure' WHEN pending_albums > 0 OR analyzing_albums > 0 THEN 'resume_analysis'
 WHEN state = 'failed' OR failed_albums > 0 THEN 'inspect_failed' WHEN state = 'ready_to_commit' THEN 'generate_plan' ELSE 'new_import' END"""


def facts(spark, sf) -> DataFrame:
    return routing.run_facts(runs(spark, sf), albums(spark, sf), transactions(spark, sf), planned(spark, sf))


@query("d28_next_actions", f"WITH {FACT_SQL} SELECT id, {ROUTE_SQL} AS next_action FROM facts WHERE state NOT IN ('abandoned', 'completed')")
def d28(spark, sf):
    return routing.next_actions(facts(spark, sf)).select("id", "next_action")


@query("d28_dashboard_top", f"WITH {FACT_SQL}, r AS (SELECT id, started_at, {ROUTE_SQL} AS next_action FROM facts WHERE state NOT IN ('abandoned', 'completed')) SELECT id, next_action FROM r WHERE next_action <> 'new_import' ORDER BY list_position(['recover', 'inspect_transaction_failure', 'review', 'generate_plan', 'resume_analysis', 'inspect_failed', 'resume_commit'], next_action), started_at DESC, id LIMIT 1")
def d28_top(spark, sf):
    return routing.first_action(routing.next_actions(facts(spark, sf))).select("id", "next_action")


@query(
    "d29_committable_runs",
    f"""WITH {FACT_SQL} SELECT id FROM facts WHERE has_plan AND (state = 'ready_to_commit' OR (state = 'cancelled' AND NOT recoverable AND NOT unresolved)
        OR (state IN ('committing', 'recovery_required') AND NOT recoverable AND (missing OR NOT unresolved)))""",
)
def d29(spark, sf):
    return routing.committable(facts(spark, sf)).select("id")


@query("d29_reviewable_runs", f"WITH {FACT_SQL} SELECT id FROM facts WHERE state <> 'abandoned' AND (state IN ('review_required', 'ready_to_commit') OR pending_reviews > 0)")
def d29_reviewable(spark, sf):
    return routing.reviewable(facts(spark, sf)).select("id")


@query(
    "d26_reconcile_runs",
    f"""WITH {FACT_SQL} SELECT id, CASE WHEN state NOT IN ('committing', 'recovery_required', 'completed') OR NOT has_plan THEN state
        WHEN recoverable OR unresolved OR unfinished_plan THEN 'recovery_required' ELSE 'completed' END AS state FROM facts""",
)
def d26(spark, sf):
    return routing.reconciled(runs(spark, sf), transactions(spark, sf), planned(spark, sf).withColumn("mode", F.lit("copy_and_archive"))).select("id", "state")


@query("d27_scan_verdict", f"WITH {ALBUM_SQL} SELECT run_id, CASE WHEN COUNT(*) FILTER (WHERE state IN ('pending', 'analyzing')) > 0 THEN 'cancelled' WHEN COUNT(*) FILTER (WHERE state = 'failed') > 0 THEN 'failed' WHEN SUM(review_count) > 0 THEN 'review_required' ELSE 'ready_to_commit' END AS verdict FROM albums GROUP BY run_id")
def d27(spark, sf):
    sums = albums(spark, sf).groupBy("run_id").agg(F.count_if(F.col("state").isin("pending", "analyzing")).alias("u"), F.count_if(F.col("state") == "failed").alias("f"), F.sum("review_count").alias("r"))
    return sums.select("run_id", S.scan_verdict(F.col("u"), F.col("f"), F.col("r")).alias("verdict"))


def machine_sql(transitions: list[tuple[str, str, str]], states: list[str]) -> str:
    own = {(s, a): n for s, a, n in reversed(transitions) if s != "*"}
    full = {(s, a): n for _, a, n in transitions if _ == "*" for s in states} | own
    rows = ", ".join(f"('{s}', '{a}', '{n}')" for (s, a), n in full.items())
    actions = sorted({a for _, a, _ in transitions})
    asked = f"SELECT event_id, {listed(states)}[CAST(event_id % {len(states)} AS INTEGER) + 1] AS state, {listed(actions)}[CAST((event_id // {len(states)}) % {len(actions)} AS INTEGER) + 1] AS action FROM events"
    return f"SELECT event_id, state, action, t.n AS next_state FROM ({asked}) LEFT JOIN (VALUES {rows}) t(s, a, n) ON t.s = state AND t.a = action"


def asked(spark, sf, transitions, states) -> DataFrame:
    """Each event as an action on something in a state; over enough events every state meets every action."""
    actions = sorted({a for _, a, _ in transitions})
    turn = F.floor(F.col("event_id") / len(states))
    return table(spark, sf, "events").select("event_id", _state(states, "event_id").alias("state"), _state(actions, turn).alias("action"))


def machine(spark, sf, transitions, states) -> DataFrame:
    return asked(spark, sf, transitions, states).withColumn("next_state", S.next_state(F.col("state"), F.col("action"), transitions))


@query("d33_run_machine", machine_sql(schemas.RUN_TRANSITIONS, schemas.RUN_STATES))
def d33_runs(spark, sf):
    return machine(spark, sf, schemas.RUN_TRANSITIONS, schemas.RUN_STATES)


@query("d33_file_machine", machine_sql(schemas.FILE_TRANSITIONS, schemas.FILE_STATES))
def d33_files(spark, sf):
    return machine(spark, sf, schemas.FILE_TRANSITIONS, schemas.FILE_STATES)


@query("d33_transaction_machine", machine_sql(schemas.TRANSACTION_TRANSITIONS, schemas.TRANSACTION_STATES))
def d33_transactions(spark, sf):
    rows = asked(spark, sf, schemas.TRANSACTION_TRANSITIONS, schemas.TRANSACTION_STATES)
    steps = S.transition_table(spark, schemas.TRANSACTION_TRANSITIONS, schemas.TRANSACTION_STATES)
    return rows.join(F.broadcast(steps), ["state", "action"], "left")  # a fixed table


@query("d34_publish_strategy", "SELECT event_id, CASE WHEN NOT (value > 5 AND user_id % 3 <> 0) THEN 'unsupported' WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'strong_local' ELSE 'conservative_mounted' END AS strategy FROM events")
def d34(spark, sf):
    needed = F.array(F.col("value") > 5, F.col("user_id") % 3 != 0)
    return table(spark, sf, "events").select("event_id", S.publish_strategy(needed, F.col("event_type") == "view", F.col("user_id") % 2 == 0).alias("strategy"))


@query(
    "d35_recovery_hints",
    f"""WITH {TX_SQL} SELECT run_id, album_id, CASE WHEN state IN ('planned', 'staging') THEN 'staging incomplete: clean .part files, resume copy' WHEN state IN ('verifying', 'verified') THEN 'staging complete: re-verify and publish'
        WHEN state = 'publishing' AND album_id % 3 = 0 THEN 'target exists: verify manifest then mark published' WHEN state = 'publishing' AND album_id % 2 = 0 THEN 'staging ready, target missing: retry rename' WHEN state = 'publishing' THEN 'staging missing: re-stage from source'
        WHEN state IN ('published', 'db_committing') THEN 'published: retry database commit' WHEN state IN ('library_committed', 'source_archiving', 'source_files_removing') THEN 'library committed: resume source archive'
        WHEN state = 'cleanup_required' THEN 'cleanup required: staging dir left behind' WHEN state = 'conflict' THEN 'conflict: manual resolution required'
        WHEN state IN ('failed', 'cancelled') THEN 'terminal state ' || state || ': automatic recovery is unavailable; manual resolution required' ELSE 'unhandled state: ' || state END AS hint FROM txs""",
)
def d35(spark, sf):
    hint = S.recovery_hint(F.col("state"), F.col("album_id") % 2 == 0, F.col("album_id") % 3 == 0, F.lit("copy_and_archive"))
    return transactions(spark, sf).select("run_id", "album_id", hint.alias("hint"))


@query("d40_archive_decision", "SELECT event_id, CASE WHEN (value > 10) = (user_id % 2 = 0) OR user_id % 5 = 0 THEN 'conflict' WHEN value > 10 THEN 'move' ELSE 'accept' END AS decision FROM events")
def d40(spark, sf):
    return table(spark, sf, "events").select("event_id", S.archive_decision(F.col("value") > 10, F.col("user_id") % 2 == 0, F.col("user_id") % 5 != 0).alias("decision"))


CLEANUP = ["pending", "verifying", "removing", "removed", "conflict"]


@query("d41_cleanup_decision", f"SELECT event_id, CASE WHEN (s = 'pending' AND q) OR (s = 'removing' AND NOT p AND NOT q) THEN 'conflict' WHEN s IN ('verifying', 'removed') OR (s = 'removing' AND q) THEN 'ignore' WHEN s IN ('pending', 'removing') THEN 'keep' ELSE 'conflict' END AS decision, CASE WHEN s IN ('pending', 'verifying', 'removing') AND p THEN 'pending' WHEN s = 'removing' THEN 'removed' WHEN s = 'removed' AND NOT p THEN 'removed' ELSE 'conflict' END AS legacy FROM (SELECT event_id, {listed(CLEANUP)}[CAST(event_id % 5 AS INTEGER) + 1] AS s, value > 10 AS p, user_id % 2 = 0 AS q FROM events)")
def d41(spark, sf):
    rows = table(spark, sf, "events").withColumn("s", _state(CLEANUP, "event_id"))
    p, q = F.col("value") > 10, F.col("user_id") % 2 == 0
    return rows.select("event_id", S.cleanup_decision(F.col("s"), p, q).alias("decision"), S.legacy_cleanup_state(F.col("s"), p).alias("legacy"))


@query(
    "d42_resume_stage",
    f"""WITH {TX_SQL} SELECT run_id, album_id, CASE WHEN state IN ('planned', 'staging') THEN 'stage' WHEN state IN ('verifying', 'verified') THEN 'verify' WHEN state = 'publishing' THEN 'publish' WHEN state IN ('published', 'db_committing') THEN 'catalog'
        WHEN state IN ('library_committed', 'source_archiving', 'source_files_removing') THEN CASE WHEN album_id % 2 = 0 THEN 'archive_source' ELSE 'remove_source_files' END WHEN state = 'cleanup_required' THEN 'clean_staging' END AS stage FROM txs""",
)
def d42(spark, sf):
    mode = F.when(F.col("album_id") % 2 == 0, "copy_and_archive").otherwise("move_selected_without_backup")
    return transactions(spark, sf).select("run_id", "album_id", S.resume_stage(F.col("state"), mode).alias("stage"))


@query("d43_restage", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'copy' WHEN doc_id % 9 = 0 THEN 'copy' ELSE 'reuse' END AS step FROM documents")
def d43(spark, sf):
    from tessera.operators.validate import restage

    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("digest"))
    staged = docs.where("doc_id % 4 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 9 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return restage(docs, staged, "doc_id", ["n_chars", "digest"])


# Validation (V*): each returns the rows that break a rule.
@query("v01_exactly_one", "SELECT event_id FROM events WHERE (event_type = 'view') = (value > 20)")
def v01(spark, sf):
    from tessera.operators.validate import not_exactly_one

    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", 1).alias("a"), F.when(F.col("value") > 20, 1).alias("b"))
    return rows.where(not_exactly_one(F.col("a"), F.col("b"))).select("event_id")


@query("v02_domain", "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click', 'signup')")
def v02(spark, sf):
    return table(spark, sf, "events").where(~F.col("event_type").isin("view", "click", "signup")).select("event_id")


@query("v04_unit_interval", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount * 11 BETWEEN 0 AND 1)")
def v04(spark, sf):
    return table(spark, sf, "lineitem").where(~(F.col("l_discount") * 11).between(0, 1)).select("l_orderkey", "l_linenumber")


@query("v05_unique_pair", "SELECT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def v05(spark, sf):
    from tessera.functions.expr import pair_high, pair_low
    from tessera.operators.validate import repeated

    return repeated(table(spark, sf, "lineitem"), {"low": pair_low("l_partkey", "l_suppkey"), "high": pair_high("l_partkey", "l_suppkey")})


@query("v06_decision_consistency", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE (l.quality = 1 AND l.toxic = 1) OR (l.quality = 0 AND d.n_chars > 5000)")
def v06(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return joined.where("(quality = 1 AND toxic = 1) OR (quality = 0 AND n_chars > 5000)").select("doc_id")


@query("v07_single_membership", "SELECT user_id, COUNT(DISTINCT event_type) AS groups FROM events WHERE value > 30 GROUP BY 1 HAVING COUNT(DISTINCT event_type) > 1")
def v07(spark, sf):
    return table(spark, sf, "events").where("value > 30").groupBy("user_id").agg(F.count_distinct("event_type").alias("groups")).where("groups > 1")


@query("v08_paired_columns", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 250000)")
def v08(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") != (F.col("o_totalprice") > 250000)).select("o_orderkey")


@query("v09_foreign_keys", "SELECT 'labels.doc_id' AS rule, CAST(doc_id AS BIGINT) AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'lineitem.l_orderkey', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def v09(spark, sf):
    from tessera.operators.validate import orphans

    even = table(spark, sf, "documents").where("doc_id % 2 = 0")
    done = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    a = orphans(table(spark, sf, "labels"), "doc_id", even, "doc_id", "labels.doc_id")
    return a.unionByName(orphans(table(spark, sf, "lineitem"), "l_orderkey", done, "o_orderkey", "lineitem.l_orderkey"))


@query("v10_path_conflicts", "SELECT source, lower(lang) AS key, COUNT(DISTINCT lang) AS spellings, COUNT(*) AS n FROM documents GROUP BY 1, 2 HAVING COUNT(*) > 1")
def v10(spark, sf):
    from tessera.operators.validate import path_conflicts

    return path_conflicts(table(spark, sf, "documents"), ["source"], F.col("lang"))


@query("v11_group_keeps_one", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) FILTER (WHERE l_returnflag <> 'R') = 0")
def v11(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey").distinct().join(lines.where("l_returnflag <> 'R'").select("l_orderkey"), "l_orderkey", "left_anti")


@query("v12_one_to_one", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'n_chars_mismatch' END AS error FROM documents WHERE doc_id % 5 = 0 OR doc_id % 8 = 3")
def v12(spark, sf):
    from tessera.operators.verify import reconcile

    plan = table(spark, sf, "documents").select("doc_id", "n_chars")
    done = plan.where("doc_id % 5 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 8 == 3, F.col("n_chars") - 1).otherwise(F.col("n_chars")))
    return reconcile(plan, done, "doc_id", ["n_chars"])


@query("v14_contiguous_history", "SELECT v AS version, v = rn AS known FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY v) rn FROM (SELECT DISTINCT n_regionkey + 1 + CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS v FROM nation))")
def v14(spark, sf):
    from tessera.operators.validate import known_prefix

    gap = F.when(F.col("n_regionkey") > 2, 1).otherwise(0)
    applied = table(spark, sf, "nation").select((F.col("n_regionkey") + 1 + gap).alias("version")).distinct()
    return known_prefix(applied, "version", 5)


@query("v15_conflicting_batch", "SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS signatures FROM lineitem WHERE l_quantity > 48 GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey) > 1")
def v15(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity > 48")
    return rows.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("signatures")).where("signatures > 1")
