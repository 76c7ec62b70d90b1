"""Decision tables: state machines, verdicts and recovery actions as expressions or small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas


def chain(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """CASE with the first true condition deciding."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def next_state(state: Column, action: Column, transitions: list[tuple[str, str, str]]) -> Column:
    """The next state, null for a transition that is not allowed. Rows for one state go before rows for any."""
    own = [(s, a, n) for s, a, n in transitions if s != "*"]
    any_ = [(s, a, n) for s, a, n in transitions if s == "*"]
    cases = [((state == s) & (action == a), n) for s, a, n in own] + [(action == a, n) for _, a, n in any_]
    return chain(cases)


def transition_table(spark: SparkSession, transitions: list[tuple[str, str, str]], states: list[str]) -> DataFrame:
    """(state, action, next_state) with the rows for any state written out."""
    seen = {}
    for s, a, n in transitions:
        for state in states if s == "*" else [s]:
            seen.setdefault((state, a), n)
    return spark.createDataFrame([(s, a, n) for (s, a), n in seen.items()], "state string, action string, next_state string")


def scan_verdict(unfinished: Column, failed: Column, pending: Column) -> Column:
    return chain([(unfinished > 0, "cancelled"), (failed > 0, "failed"), (pending > 0, "review_required")], "ready_to_commit")


def publish_strategy(required: Column, directory_rename: Column, parent_sync: Column) -> Column:
    """required: array of booleans, one per probe that any strategy needs."""
    return chain([(~F.forall(required, lambda x: x), "unsupported"), (directory_rename & parent_sync, "strong_local")], "conservative_mounted")


def recovery_hint(state: Column, staging_exists: Column, target_exists: Column, mode: Column) -> Column:
    # The hints' texts.
    return chain(
        [
            (state.isin("planned", "staging"), "staging incomplete: clean .part files, resume copy"),
            (state.isin("verifying", "verified"), "staging complete: re-verify and publish"),
            ((state == "publishing") & target_exists, "target exists: verify manifest then mark published"),
            ((state == "publishing") & staging_exists, "staging ready, target missing: retry rename"),
            (state == "publishing", "staging missing: re-stage from source"),
            (state.isin("published", "db_committing"), "published: retry database commit"),
            (
                state.isin("library_committed", "source_archiving", "source_files_removing"),
                F.when(mode == "copy_and_archive", "library committed: resume source archive").otherwise(
                    "library committed: resume verified selected-source removal"
                ),
            ),
            (state == "cleanup_required", "cleanup required: staging dir left behind"),
            (state == "conflict", "conflict: manual resolution required"),
            (state.isin("failed", "cancelled"), F.concat(F.lit("terminal state "), state, F.lit(": automatic recovery is unavailable; manual resolution required"))),
        ],
        F.concat(F.lit("unhandled state: "), state),
    )


def resume_stage(state: Column, mode: Column) -> Column:
    """Where recovery takes a transaction up again; null where nothing is to be done."""
    return chain(
        [
            (state.isin("planned", "staging"), "stage"),
            (state.isin("verifying", "verified"), "verify"),
            (state == "publishing", "publish"),
            (state.isin("published", "db_committing"), "catalog"),
            (state.isin("library_committed", "source_archiving", "source_files_removing") & (mode == "copy_and_archive"), "archive_source"),
            (state.isin("library_committed", "source_archiving", "source_files_removing"), "remove_source_files"),
            (state == "cleanup_required", "clean_staging"),
        ]
    )


def archive_decision(source_exists: Column, archive_exists: Column, snapshot_matches: Column) -> Column:
    return chain(
        [
            (source_exists & archive_exists, "conflict"),
            (~source_exists & ~archive_exists, "conflict"),
            (~snapshot_matches, "conflict"),
            (source_exists, "move"),
        ],
        "accept",
    )


def legacy_cleanup_state(state: Column, source_exists: Column) -> Column:
    """State of a cleanup row from before quarantine paths; 'conflict' where files and state disagree."""
    return chain(
        [
            (state.isin("pending", "verifying", "removing") & source_exists, "pending"),
            (state == "removing", "removed"),
            ((state == "removed") & ~source_exists, "removed"),
        ],
        "conflict",
    )


def cleanup_decision(state: Column, source_exists: Column, quarantine_exists: Column) -> Column:
    """ignore: both paths are left out when the album is verified again; keep: neither is; conflict: stop."""
    return chain(
        [
            ((state == "pending") & quarantine_exists, "conflict"),
            ((state == "removing") & ~source_exists & ~quarantine_exists, "conflict"),
            (state.isin("verifying", "removed"), "ignore"),
            ((state == "removing") & quarantine_exists, "ignore"),
            (state.isin("pending", "removing"), "keep"),
        ],
        "conflict",
    )


def recovery_write_bytes(state: Column, image_bytes: Column) -> Column:
    """Bytes that taking up a transaction may write: its images and a mebibyte before publishing ends, else none."""
    return F.when(state.isin(schemas.TRANSACTION_STATES[:5]), image_bytes + 1024 * 1024).otherwise(F.lit(0).cast("long"))
