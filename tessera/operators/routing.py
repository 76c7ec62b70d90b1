"""Run facts and what they lead to: next action, reviewable and committable runs, reconciled states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.states import chain

ACTIONS = ["recover", "inspect_transaction_failure", "review", "generate_plan", "resume_analysis", "inspect_failed", "resume_commit", "new_import"]


def _flags(rows: DataFrame, **conditions: Column) -> DataFrame:
    return rows.groupBy("run_id").agg(*[F.bool_or(c).alias(n) for n, c in conditions.items()])


def run_facts(runs: DataFrame, albums: DataFrame, transactions: DataFrame, plan: DataFrame) -> DataFrame:
    """runs (id, state, started_at) with one aggregate per child joined on.

    albums: run_id, state, review_count; transactions: run_id, album_id, state; plan: run_id, album_id of hashed frozen
    plans. Nested existence tests become an anti-join for the missing albums and flags per run.
    """
    counts = albums.groupBy("run_id").agg(
        F.count_if(F.col("state") == "pending").alias("pending_albums"),
        F.count_if(F.col("state").isin("analyzing", "scanning", "fingerprinting")).alias("analyzing_albums"),
        F.count_if(F.col("state") == "failed").alias("failed_albums"),
        F.sum("review_count").alias("pending_reviews"),
    )
    tx = _flags(transactions, recoverable=F.col("state").isin(schemas.RECOVERABLE_STATES), unresolved=F.col("state").isin(schemas.UNRESOLVED_STATES))
    missing = plan.join(transactions.select("run_id", "album_id"), ["run_id", "album_id"], "left_anti").select("run_id", F.lit(True).alias("missing")).distinct()
    has_plan = plan.select("run_id", F.lit(True).alias("has_plan")).distinct()
    out = runs
    for side in (counts, tx, has_plan, missing):
        out = out.join(side.withColumnRenamed("run_id", "id"), "id", "left")
    return out.na.fill(0, ["pending_albums", "analyzing_albums", "failed_albums", "pending_reviews"]).na.fill(False, ["recoverable", "unresolved", "has_plan", "missing"])


def next_actions(facts: DataFrame) -> DataFrame:
    state = F.col("state")
    late = state.isin("committing", "recovery_required")
    action = chain(
        [
            (F.col("recoverable"), "recover"),
            ((state == "review_required") & (F.col("pending_reviews") > 0), "review"),
            (state == "review_required", "generate_plan"),
            ((state == "cancelled") & F.col("has_plan") & ~F.col("unresolved"), "resume_commit"),
            (late & F.col("has_plan") & F.col("missing"), "resume_commit"),
            (late & F.col("unresolved"), "inspect_transaction_failure"),
            (late & F.col("has_plan"), "resume_commit"),
            (late, "inspect_transaction_failure"),
            ((F.col("pending_albums") > 0) | (F.col("analyzing_albums") > 0), "resume_analysis"),
            ((state == "failed") | (F.col("failed_albums") > 0), "inspect_failed"),
            (state == "ready_to_commit", "generate_plan"),
        ],
        "new_import",
    )
    return facts.where(~state.isin("abandoned", "completed")).withColumn("next_action", action)


def first_action(routed: DataFrame) -> DataFrame:
    """The one action that a dashboard shows: by urgency, then the newest run."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("next_action"))
    return routed.where("next_action <> 'new_import'").orderBy(rank, F.desc("started_at"), "id").limit(1)


def reviewable(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("state") != "abandoned") & (F.col("state").isin("review_required", "ready_to_commit") | (F.col("pending_reviews") > 0)))


def committable(facts: DataFrame) -> DataFrame:
    state = F.col("state")
    cancelled = (state == "cancelled") & ~F.col("recoverable") & ~F.col("unresolved")
    late = state.isin("committing", "recovery_required") & ~F.col("recoverable") & (F.col("missing") | ~F.col("unresolved"))
    return facts.where(F.col("has_plan") & ((state == "ready_to_commit") | cancelled | late))


def reconciled(runs: DataFrame, transactions: DataFrame, plan: DataFrame) -> DataFrame:
    """runs with the state that plan and transactions bear out. plan: run_id, album_id, mode; a run without a plan keeps its state."""
    terminal = F.create_map(*[F.lit(x) for kv in schemas.TERMINAL_OF_MODE.items() for x in kv])
    tx = _flags(transactions, blocked=F.col("state").isin(schemas.RECOVERABLE_STATES + schemas.UNRESOLVED_STATES))
    wanted = plan.select("run_id", "album_id", terminal[F.col("mode")].alias("state"))
    open_ = wanted.join(transactions.select("run_id", "album_id", "state"), ["run_id", "album_id", "state"], "left_anti").select("run_id", F.lit(True).alias("open")).distinct()
    has_plan = plan.select("run_id", F.lit(True).alias("has_plan")).distinct()
    out = runs
    for side in (tx, open_, has_plan):
        out = out.join(side.withColumnRenamed("run_id", "id"), "id", "left")
    late = F.col("state").isin("committing", "recovery_required", "completed") & F.coalesce("has_plan", F.lit(False))
    wrong = F.coalesce("blocked", F.lit(False)) | F.coalesce("open", F.lit(False))
    return out.withColumn("state", F.when(~late, F.col("state")).when(wrong, "recovery_required").otherwise("completed")).drop("blocked", "open", "has_plan")
