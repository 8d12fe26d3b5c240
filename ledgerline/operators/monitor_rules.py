"""Row rules of the monitor's tables: targets, checkpoints, runs, resolutions, acknowledged gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .issues import check
from .lineage import repeated
from .rowchecks import is_authorizer, is_human

_HEX = "^[0-9a-f]{64}$"


def _set(name: str) -> Column:
    return F.col(name).isNotNull()


def target_rules(targets: DataFrame, zone: str = "Asia/Tokyo") -> DataFrame:
    """Active window, zone, URL, approvals and the matrix of activation and enablement."""
    status, enabled, generation = F.col("activation_status"), F.col("enabled"), F.col("activation_generation")
    granted = F.col("access_status") == "permitted"
    reviewed = F.col("terms_status") == "candidate_specific_review_completed"
    was_active = status.isin("activated", "suspended", "retired")
    return check(
        targets, "monitor_target",
        [
            ("active_until", "before_active_from", F.col("active_until") < F.col("active_from")), ("timezone", "other_zone", F.col("timezone") != zone),
            ("url", "not_https", ~F.col("url").startswith("https://") | F.regexp_extract("url", "^https://([^/?#]*)", 1).contains("@")),
            ("event_id", "event_document_without_event", (F.col("target_type") == "event_document") & ~_set("event_id")),
            ("approved_by", "not_an_authorizer", _set("approved_by") & ~is_authorizer(F.col("approved_by"))),
            ("terms_status", "review_without_record", reviewed & ~(_set("terms_reviewed_at") & _set("terms_reference"))),
            ("access_status", "permitted_without_review", granted & ~(reviewed & is_authorizer(F.col("approved_by")))),
            ("activation_status", "activation_fields_set", (status == "not_activated") & (_set("activated_at") | (generation != 0))),
            ("enabled", "enabled_without_activation", (status == "not_activated") & enabled),
            ("activation_status", "activation_incomplete", was_active & (~_set("activated_at") | ~is_authorizer(F.col("approved_by")) | (generation < 1))),
            ("enabled", "enabled_but_stopped", status.isin("suspended", "retired") & enabled),
            ("enabled", "enabled_without_grant", enabled & ~((F.col("automation_level") == "level_2") & granted & (status == "activated"))),
        ],
    )


def schedule_sources(targets: DataFrame) -> DataFrame:
    """A schedule source is another target that exists and has no source itself."""
    sources = targets.select(F.col("target_id").alias("schedule_source_id"), F.lit(True).alias("__found"), F.col("schedule_source_id").alias("__deeper"))
    rows = targets.filter(_set("schedule_source_id")).join(sources, "schedule_source_id", "left")
    return check(
        rows, "monitor_target",
        [("schedule_source_id", "own_source", F.col("schedule_source_id") == F.col("target_id")), ("schedule_source_id", "missing_source", F.col("__found").isNull()),
         ("schedule_source_id", "source_of_source", F.col("__deeper").isNotNull() & (F.col("schedule_source_id") != F.col("target_id")))],
    )


def checkpoint_rules(checkpoints: DataFrame, storage_errors: tuple[str, ...] = ("state_unavailable", "persistence_error")) -> DataFrame:
    state, pending, error, count = F.col("state"), _set("pending_run_id"), _set("error_code"), F.coalesce("error_count", F.lit(0))
    return check(
        checkpoints, "monitor_checkpoint",
        [
            ("last_success_at", "after_last_checked", F.col("last_success_at") > F.col("last_checked_at")), ("fingerprint", "fingerprint_pair", _set("fingerprint") != _set("fingerprint_version")),
            ("fingerprint", "fingerprint_form", ~F.col("fingerprint").rlike(_HEX)), ("version", "uninitialized_version", (state == "uninitialized") & (F.col("version") != 0)),
            ("pending_run_id", "pending_missing", (state == "pending_human_review") & ~pending), ("pending_run_id", "pending_unexpected", pending & ~state.isin("pending_human_review", "stopped")),
            ("error_count", "error_pair", error != (count > 0)), ("state", "degraded_without_error", (state == "degraded") & ~error),
            ("state", "healthy_with_storage_error", (state == "healthy") & F.col("error_code").isin(*storage_errors)),
        ],
    )


def run_rules(runs: DataFrame) -> DataFrame:
    """The matrix of result, observation, persistence and notification."""
    result, before, after = F.col("result"), F.col("fingerprint_before"), F.col("fingerprint_after")
    ok, error, commit = F.col("observation_status") == "succeeded", _set("error_code"), F.col("persistence_status")
    stored_badly = F.coalesce(F.col("error_code") == "persistence_error", F.lit(False))
    return check(
        runs, "monitor_run",
        [
            ("finished_at", "before_start", F.col("finished_at") < F.col("started_at")), ("fingerprint_after", "fingerprint_form", ~before.rlike(_HEX) | ~after.rlike(_HEX)),
            ("result", "initialized_fields", (result == "initialized") & ~(ok & before.isNull() & after.isNotNull() & (F.col("version_after") == 1) & F.col("previous_run_id").isNull())),
            ("result", "no_change_fields", (result == "no_change") & ~(ok & before.eqNullSafe(after) & after.isNotNull() & F.col("change_summary").isNull())),
            ("result", "change_fields", (result == "change_detected") & ~(ok & before.isNotNull() & after.isNotNull() & ~before.eqNullSafe(after) & _set("change_summary"))),
            ("result", "error_fields", (result == "error") & ~(error & _set("error_detail") & ((F.col("observation_status") == "failed") | stored_badly))),
            ("observation_status", "skipped_but_observed", (result == "skipped") & (F.col("observation_status") != "not_attempted")),
            ("error_code", "error_unexpected", (result != "error") & (error | _set("error_detail"))),
            ("version_after", "version_step", (commit == "committed") & (result != "initialized") & ~F.col("version_after").eqNullSafe(F.col("version_before") + 1)),
            ("persistence_status", "failed_fields", (commit == "failed") & ~((result == "error") & stored_badly & F.col("version_after").isNull())),
            ("version_after", "version_unexpected", (commit == "not_attempted") & _set("version_after")),
            ("notification_status", "notification_missing", result.isin("change_detected", "error") & (F.col("notification_status") == "not_required")),
        ],
    )


def acknowledgement_rules(acks: DataFrame) -> DataFrame:
    """Gaps have a positive length and a person behind them, are acknowledged after they end, once each."""
    rows = check(
        acks, "monitor_gap_acknowledgement",
        [("gap_end", "not_after_start", F.col("gap_end") <= F.col("gap_start")), ("acknowledged_at", "before_gap_end", F.col("acknowledged_at") < F.col("gap_end")), ("acknowledged_by", "not_a_person", ~is_human(F.col("acknowledged_by")))],
    )
    twice = repeated(acks.filter(_set("supersedes")), "monitor_gap_acknowledgement", ["supersedes"], "superseded_twice")
    again = repeated(acks.filter(~_set("supersedes")), "monitor_gap_acknowledgement", ["target", "gap_start", "gap_end"], "acknowledged_twice")
    return rows.unionByName(twice).unionByName(again)
