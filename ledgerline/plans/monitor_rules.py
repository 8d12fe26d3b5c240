"""Registered queries of the monitor tables' row rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import monitor_rules as rules
from .validation import rules_sql
from .views import view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_TARGET = """SELECT o_orderkey AS row_number, o_orderkey AS target_id, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey - CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE 6 END + CASE WHEN o_orderkey % 54 = 0 THEN 100000000 ELSE 0 END WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 END AS schedule_source_id,
  CAST(o_orderdate AS TIMESTAMP) AS active_from, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_orderkey % 20 - 1) AS active_until, CASE WHEN o_orderkey % 13 = 0 THEN 'UTC' ELSE 'Asia/Tokyo' END AS timezone,
  CASE o_orderkey % 9 WHEN 0 THEN 'http://a.example' WHEN 1 THEN 'https://me@a.example/x' ELSE 'https://a.example/' || CAST(o_orderkey AS STRING) END AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'event_document' ELSE 'ir_page' END AS target_type, CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey END AS event_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'bot' WHEN 1 THEN 'human:a' WHEN 2 THEN 'system_policy:p' WHEN 3 THEN 'human:b' END AS approved_by, CASE WHEN o_orderkey % 3 = 0 THEN 'not_reviewed' ELSE 'candidate_specific_review_completed' END AS terms_status,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS terms_reviewed_at, CASE WHEN o_orderkey % 10 <> 0 THEN 'ref' END AS terms_reference, CASE WHEN o_orderkey % 2 = 0 THEN 'permitted' ELSE 'unknown' END AS access_status,
  CASE o_orderstatus WHEN 'F' THEN 'activated' WHEN 'O' THEN 'not_activated' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'suspended' ELSE 'retired' END END AS activation_status, CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_orderdate AS TIMESTAMP) END AS activated_at, o_orderkey % 3 AS activation_generation,
  o_orderkey % 5 < 2 AS enabled, CASE WHEN o_orderkey % 4 < 2 THEN 'level_2' ELSE 'level_1' END AS automation_level FROM {orders}"""
_AUTH = "coalesce(regexp_full_match(approved_by, '(human|system_policy):\\S.*'), false)"
_ACTIVE = "activation_status IN ('activated', 'suspended', 'retired')"


@query("WITH t AS (" + _TARGET.format(orders="orders") + ") " + rules_sql("monitor_target", "t", [
    ("active_until", "before_active_from", "active_until < active_from"), ("timezone", "other_zone", "timezone <> 'Asia/Tokyo'"), ("url", "not_https", "url NOT LIKE 'https://%' OR url LIKE '%@%'"),
    ("event_id", "event_document_without_event", "target_type = 'event_document' AND event_id IS NULL"), ("approved_by", "not_an_authorizer", f"approved_by IS NOT NULL AND NOT {_AUTH}"),
    ("terms_status", "review_without_record", "terms_status = 'candidate_specific_review_completed' AND (terms_reviewed_at IS NULL OR terms_reference IS NULL)"),
    ("access_status", "permitted_without_review", f"access_status = 'permitted' AND NOT (terms_status = 'candidate_specific_review_completed' AND {_AUTH})"),
    ("activation_status", "activation_fields_set", "activation_status = 'not_activated' AND (activated_at IS NOT NULL OR activation_generation <> 0)"), ("enabled", "enabled_without_activation", "activation_status = 'not_activated' AND enabled"),
    ("activation_status", "activation_incomplete", f"{_ACTIVE} AND (activated_at IS NULL OR NOT {_AUTH} OR activation_generation < 1)"), ("enabled", "enabled_but_stopped", "activation_status IN ('suspended', 'retired') AND enabled"),
    ("enabled", "enabled_without_grant", "enabled AND NOT (automation_level = 'level_2' AND access_status = 'permitted' AND activation_status = 'activated')")]))
def monitor_target_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.target_rules(spark.sql(_TARGET, orders=view(spark, sf_dir, "orders")))


@query("WITH t AS (" + _TARGET.format(orders="orders") + "), j AS (SELECT t.row_number, t.target_id, t.schedule_source_id, s.target_id AS found, s.schedule_source_id AS deeper FROM t LEFT JOIN t s ON t.schedule_source_id = s.target_id WHERE t.schedule_source_id IS NOT NULL) "
       + rules_sql("monitor_target", "j", [("schedule_source_id", "own_source", "schedule_source_id = target_id"), ("schedule_source_id", "missing_source", "found IS NULL"), ("schedule_source_id", "source_of_source", "deeper IS NOT NULL AND schedule_source_id <> target_id")]))
def schedule_source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.schedule_sources(spark.sql(_TARGET, orders=view(spark, sf_dir, "orders")))


_CHECKPOINT = """SELECT event_id AS row_number, ts AS last_checked_at, ts - INTERVAL '1' HOUR * (event_id % 9 - 1) AS last_success_at, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ABC' ELSE {sha} END AS fingerprint, CASE WHEN event_id % 7 > 0 THEN 1 END AS fingerprint_version,
  CASE event_id % 5 WHEN 0 THEN 'uninitialized' WHEN 1 THEN 'healthy' WHEN 2 THEN 'degraded' WHEN 3 THEN 'pending_human_review' ELSE 'stopped' END AS state, event_id % 3 AS version, CASE WHEN event_id % 4 = 0 THEN event_id END AS pending_run_id,
  CASE event_id % 8 WHEN 0 THEN 'persistence_error' WHEN 1 THEN 'timeout' END AS error_code, CASE WHEN event_id % 8 < 3 THEN 1 ELSE 0 END AS error_count FROM {events}"""


@query("WITH c AS (" + _CHECKPOINT.format(sha="sha256(event_type)", events="events") + ") " + rules_sql("monitor_checkpoint", "c", [
    ("last_success_at", "after_last_checked", "last_success_at > last_checked_at"), ("fingerprint", "fingerprint_pair", "(fingerprint IS NULL) <> (fingerprint_version IS NULL)"), ("fingerprint", "fingerprint_form", "NOT regexp_full_match(fingerprint, '[0-9a-f]{64}')"),
    ("version", "uninitialized_version", "state = 'uninitialized' AND version <> 0"), ("pending_run_id", "pending_missing", "state = 'pending_human_review' AND pending_run_id IS NULL"), ("pending_run_id", "pending_unexpected", "pending_run_id IS NOT NULL AND state NOT IN ('pending_human_review', 'stopped')"),
    ("error_count", "error_pair", "(error_code IS NOT NULL) <> (error_count > 0)"), ("state", "degraded_without_error", "state = 'degraded' AND error_code IS NULL"), ("state", "healthy_with_storage_error", "state = 'healthy' AND error_code IN ('state_unavailable', 'persistence_error')")]))
def monitor_checkpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.checkpoint_rules(spark.sql(_CHECKPOINT.format(sha="sha2(event_type, 256)", events="{events}"), events=view(spark, sf_dir, "events")))


_RUN = """SELECT event_id AS row_number, ts AS started_at, ts + INTERVAL '1' SECOND * (event_id % 30 - 1) AS finished_at, CASE event_id % 5 WHEN 0 THEN 'initialized' WHEN 1 THEN 'no_change' WHEN 2 THEN 'change_detected' WHEN 3 THEN 'error' ELSE 'skipped' END AS result,
  CASE event_id % 5 WHEN 3 THEN 'failed' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'succeeded' ELSE 'not_attempted' END ELSE CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE 'succeeded' END END AS observation_status,
  CASE WHEN event_id % 5 IN (1, 2) THEN {sha} END AS fingerprint_before, CASE WHEN event_id % 23 = 0 THEN 'XYZ' WHEN event_id % 5 = 2 THEN {other} WHEN event_id % 5 < 2 THEN {sha} END AS fingerprint_after, CASE WHEN event_id % 5 = 2 AND event_id % 3 > 0 THEN 'title' END AS change_summary,
  CASE WHEN event_id % 5 = 3 OR event_id % 29 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'persistence_error' ELSE 'timeout' END END AS error_code, CASE WHEN event_id % 5 = 3 THEN 'text' END AS error_detail, CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'not_attempted' ELSE 'committed' END AS persistence_status,
  event_id % 3 AS version_before, CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 <> 0 THEN event_id % 3 + CASE WHEN event_id % 31 = 0 THEN 2 ELSE 1 END END AS version_after, CASE WHEN event_id % 20 = 5 THEN 'R' END AS previous_run_id, CASE WHEN event_id % 6 = 0 THEN 'not_required' ELSE 'delivered' END AS notification_status FROM {events}"""
_STORED_BADLY = "coalesce(error_code = 'persistence_error', false)"
_HEX = "regexp_full_match({c}, '[0-9a-f]{{64}}')"


@query("WITH r AS (" + _RUN.format(sha="sha256(event_type)", other="sha256(event_type || 'x')", events="events") + ") " + rules_sql("monitor_run", "r", [
    ("finished_at", "before_start", "finished_at < started_at"), ("fingerprint_after", "fingerprint_form", f"NOT {_HEX.format(c='fingerprint_before')} OR NOT {_HEX.format(c='fingerprint_after')}"),
    ("result", "initialized_fields", "result = 'initialized' AND NOT (observation_status = 'succeeded' AND fingerprint_before IS NULL AND fingerprint_after IS NOT NULL AND version_after = 1 AND previous_run_id IS NULL)"),
    ("result", "no_change_fields", "result = 'no_change' AND NOT (observation_status = 'succeeded' AND fingerprint_before IS NOT DISTINCT FROM fingerprint_after AND fingerprint_after IS NOT NULL AND change_summary IS NULL)"),
    ("result", "change_fields", "result = 'change_detected' AND NOT (observation_status = 'succeeded' AND fingerprint_before IS NOT NULL AND fingerprint_after IS NOT NULL AND fingerprint_before <> fingerprint_after AND change_summary IS NOT NULL)"),
    ("result", "error_fields", f"result = 'error' AND NOT (error_code IS NOT NULL AND error_detail IS NOT NULL AND (observation_status = 'failed' OR {_STORED_BADLY}))"), ("observation_status", "skipped_but_observed", "result = 'skipped' AND observation_status <> 'not_attempted'"),
    ("error_code", "error_unexpected", "result <> 'error' AND (error_code IS NOT NULL OR error_detail IS NOT NULL)"), ("version_after", "version_step", "persistence_status = 'committed' AND result <> 'initialized' AND version_after IS DISTINCT FROM version_before + 1"),
    ("persistence_status", "failed_fields", f"persistence_status = 'failed' AND NOT (result = 'error' AND {_STORED_BADLY} AND version_after IS NULL)"), ("version_after", "version_unexpected", "persistence_status = 'not_attempted' AND version_after IS NOT NULL"),
    ("notification_status", "notification_missing", "result IN ('change_detected', 'error') AND notification_status = 'not_required'")]))
def monitor_run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run_rules(spark.sql(_RUN.format(sha="sha2(event_type, 256)", other="sha2(event_type || 'x', 256)", events="{events}"), events=view(spark, sf_dir, "events")))


_ACK = """SELECT event_id AS row_number, user_id AS target, CAST(ts AS DATE) AS gap_start, CAST(ts + INTERVAL '1' DAY * (event_id % 5 - 1) AS DATE) AS gap_end, CAST(ts + INTERVAL '1' DAY * (event_id % 6) AS DATE) AS acknowledged_at,
  CASE event_id % 3 WHEN 0 THEN 'human:a' WHEN 1 THEN 'system_policy:p' END AS acknowledged_by, CASE WHEN event_id % 4 = 0 THEN event_id - event_id % 20 END AS supersedes FROM {events}"""


@query("WITH a AS (" + _ACK.format(events="events") + "), s AS (SELECT *, row_number() OVER (PARTITION BY supersedes ORDER BY row_number) AS k FROM a WHERE supersedes IS NOT NULL), g AS (SELECT *, row_number() OVER (PARTITION BY target, gap_start, gap_end ORDER BY row_number) AS k FROM a WHERE supersedes IS NULL) "
       + rules_sql("monitor_gap_acknowledgement", "a", [("gap_end", "not_after_start", "gap_end <= gap_start"), ("acknowledged_at", "before_gap_end", "acknowledged_at < gap_end"), ("acknowledged_by", "not_a_person", "acknowledged_by IS NULL OR acknowledged_by NOT LIKE 'human:%'")])
       + " UNION ALL " + rules_sql("monitor_gap_acknowledgement", "s", [("supersedes", "superseded_twice", "k > 1")]) + " UNION ALL " + rules_sql("monitor_gap_acknowledgement", "g", [("target,gap_start,gap_end", "acknowledged_twice", "k > 1")]))
def gap_acknowledgement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.acknowledgement_rules(spark.sql(_ACK, events=view(spark, sf_dir, "events")))
