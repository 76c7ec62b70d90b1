"""Relations of the import workflow as Spark schemas, and its state sets. The single source for both."""

from __future__ import annotations

from pyspark.sql import types as T

# States, in the order of the workflow.
RUN_STATES = [
    "created", "scanning", "fingerprinting", "detecting_duplicates", "analyzing", "review_required", "ready_to_commit",
    "committing", "recovery_required", "completed", "cancelled", "failed", "abandoned",
]
TRANSACTION_STATES = [
    "planned", "staging", "verifying", "verified", "publishing", "published", "db_committing", "library_committed",
    "source_archiving", "source_archived", "source_files_removing", "source_files_removed", "cleanup_required", "conflict", "failed", "cancelled",
]
RECOVERABLE_STATES = [
    "planned", "staging", "verifying", "verified", "publishing", "published", "db_committing", "library_committed",
    "source_archiving", "source_files_removing", "cleanup_required", "conflict",
]
UNRESOLVED_STATES = ["failed", "cancelled"]
FILE_STATES = ["planned", "copying", "copied", "verifying", "verified", "published", "failed", "cancelled"]
ALBUM_STATES = ["pending", "analyzing", "analyzed", "review_required", "failed"]
MATCH_PRIORITY = {"file_exact": 0, "pixel_exact": 1, "near": 2, "similar": 3}
TRANSFORMS = ["identity", "rot90", "rot180", "rot270", "flip_h", "flip_v", "transpose", "transverse"]
TERMINAL_OF_MODE = {"copy_and_archive": "source_archived", "move_selected_without_backup": "source_files_removed"}

# Fixed values: (state, action, next state). '*' stands for any state; rows of a state come before the '*' rows.
FILE_TRANSITIONS = [
    ("planned", "copy", "copying"), ("copying", "copied", "copied"), ("copied", "verify", "verifying"), ("verifying", "verified", "verified"),
    ("verified", "publish", "published"), ("planned", "verified", "verified"), ("verified", "retry", "verified"), ("published", "retry", "published"),
    ("*", "fail", "failed"), ("planned", "cancel", "cancelled"), ("copying", "cancel", "cancelled"),
]
RUN_TRANSITIONS = [
    ("created", "start_scan", "scanning"), ("scanning", "fingerprint", "fingerprinting"), ("fingerprinting", "detect", "detecting_duplicates"),
    ("detecting_duplicates", "analyze", "analyzing"), ("analyzing", "require_review", "review_required"), ("analyzing", "ready", "ready_to_commit"),
    ("review_required", "finalize", "ready_to_commit"), ("ready_to_commit", "commit", "committing"), ("ready_to_commit", "abandon_workflow", "abandoned"),
    ("cancelled", "abandon_workflow", "abandoned"), ("committing", "recover", "recovery_required"), ("committing", "complete", "completed"),
    ("recovery_required", "retry", "committing"), ("recovery_required", "resolve", "completed"), ("*", "cancel", "cancelled"), ("*", "fail", "failed"),
]
TRANSACTION_TRANSITIONS = [
    ("planned", "stage", "staging"), ("staging", "verify", "verifying"), ("verifying", "verified", "verified"), ("verified", "publish", "publishing"),
    ("publishing", "published", "published"), ("published", "db_commit", "db_committing"), ("db_committing", "library_committed", "library_committed"),
    ("library_committed", "archive", "source_archiving"), ("source_archiving", "archived", "source_archived"),
    ("library_committed", "remove_source_files", "source_files_removing"), ("source_files_removing", "removed", "source_files_removed"),
    ("*", "fail", "failed"), ("*", "cancel", "cancelled"), ("*", "conflict", "conflict"),
    ("staging", "retry", "staging"), ("verified", "retry", "verified"), ("published", "retry", "published"), ("db_committing", "retry", "db_committing"),
    ("library_committed", "retry", "library_committed"), ("source_archiving", "retry", "source_archiving"), ("source_archiving", "retry_archive", "source_archiving"),
    ("source_files_removing", "retry_source_removal", "source_files_removing"), ("cleanup_required", "clean", "cleanup_required"),
    ("cleanup_required", "cleaned", "source_archived"), ("cleanup_required", "cleaned_move", "source_files_removed"),
]


_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "int": T.IntegerType(),
    "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(),
}


def _schema(text: str) -> T.StructType:
    """'name type, ...' as a StructType; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (field.split() for field in text.split(","))])


_IMAGE = "file_size long, width int, height int, format string, blake3 binary, pixel_hash binary, block_hash_16 binary, double_gradient_hash_32 binary, perceptual_eligible boolean, fingerprint_version string, quality_score double, state string"
RELATIONS: dict[str, T.StructType] = {
    k: _schema(v)
    for k, v in {
        "app_meta": "key string, value string, updated_at timestamp",
        "library_roots": "id string, path string, display_name string, filesystem_type string, is_active boolean, created_at timestamp, updated_at timestamp",
        "import_runs": "id string, source_root string, library_root_id string, state string, policy_version string, started_at timestamp, completed_at timestamp, error_code string, error_message string, statistics string",
        "import_albums": "id string, import_run_id string, source_path string, source_name string, target_relative_path string, state string, decision string, image_count int, duplicate_candidate_count int, review_candidate_count int, attempts int, error_message string, created_at timestamp, committed_at timestamp",
        "import_images": f"id string, import_album_id string, source_path string, relative_path string, modified_at timestamp, decode_state string, {_IMAGE}",
        "library_albums": "id string, library_root_id string, relative_path string, display_name string, manifest_version int, manifest_hash binary, image_count int, committed_at timestamp, state string, transaction_id string, plan_hash binary",
        "library_images": f"id string, album_id string, relative_path string, committed_at timestamp, {_IMAGE}",
        "duplicate_candidates": "id string, import_run_id string, source_image_id string, candidate_source_image_id string, candidate_library_image_id string, scope string, match_type string, blake3_equal boolean, pixel_hash_equal boolean, block_distance int, double_gradient_distance int, block_distance_ratio double, double_gradient_distance_ratio double, transform_type string, confidence double, decision string, decision_source string, rule_version string, created_at timestamp",
        "review_decisions": "id string, candidate_id string, decision string, selected_image_id string, notes string, created_at timestamp",
        "review_groups": "id string, import_run_id string, state string, requires_manual_review boolean, created_at timestamp, resolved_at timestamp",
        "review_group_members": "id string, group_id string, image_id string, image_source string, final_action string, decision_source string, created_at timestamp, updated_at timestamp",
        "import_plans": "id string, import_run_id string, version int, state string, policy_version string, library_root_id string, plan_hash binary, frozen_at timestamp, source_file_mode string",
        "import_plan_albums": "id string, plan_id string, import_album_id string, target_relative_path string, expected_image_count int, album_plan_hash binary",
        "import_plan_images": "id string, plan_album_id string, import_image_id string, source_path string, target_relative_path string, expected_file_size long, expected_blake3 binary, width int, height int, format string",
        "file_transactions": "id string, import_run_id string, import_album_id string, state string, staging_path string, target_path string, manifest_path string, plan_hash binary, manifest_hash binary, source_file_mode string, last_error string, started_at timestamp, completed_at timestamp",
        "file_operations": "id string, transaction_id string, source_path string, staging_path string, target_path string, expected_size long, expected_blake3 binary, actual_blake3 binary, state string, attempt_count int",
        "source_file_cleanup_operations": "id string, transaction_id string, source_path string, quarantine_path string, expected_size long, expected_blake3 binary, state string",
        "source_album_snapshots": "id string, import_album_id string, snapshot_hash binary, created_at timestamp",
        "source_album_snapshot_files": "snapshot_id string, relative_path string, file_type string, file_size long, blake3 binary",
        "library_root_leases": "library_root_id string, owner string, token string, heartbeat_at timestamp, expires_at timestamp",
        "audit_events": "id long, kind string, payload string, created_at timestamp",
        "schema_migrations": "version int, applied_at timestamp",
    }.items()
}
