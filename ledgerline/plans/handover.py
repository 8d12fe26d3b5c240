"""Registered queries: access, handoffs, dispatches, carried contexts, legacy baselines, and rules of targets, resolutions and hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation, handover, learning, monitor
from ..sources.tables import staged_rows
from . import learning as plans, records
from .validation import rules_sql
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


_TARGETS = """SELECT c_custkey AS target, c_custkey + 2 AS row_number, CASE WHEN c_custkey % 11 = 0 THEN 'false' WHEN c_custkey % 11 = 1 THEN NULL ELSE 'True' END AS enabled, CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'true' END AS automated_access_permitted,
  CASE WHEN c_custkey % 5 = 0 THEN 'level_1' ELSE 'level_2' END AS monitoring_level, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'candidate_specific_review_completed' END AS terms_review_state, CASE WHEN c_custkey % 3 = 0 THEN 'human:a' WHEN c_custkey % 3 = 1 THEN 'system_policy:p' ELSE 'workflow:w' END AS automation_approved_by,
  CASE WHEN c_custkey % 4 = 0 THEN 'draft' ELSE 'activated' END AS activation_state, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'human:b' END AS activation_approved_by FROM {customer}"""


@query(f"WITH t AS ({_TARGETS.format(customer='customer')}) " + rules_sql("monitor_target", "t", [
    ("enabled", "disabled", "lower(coalesce(enabled, '')) <> 'true'"), ("automated_access_permitted", "not_permitted", "automated_access_permitted <> 'true'"), ("monitoring_level", "not_level_2", "monitoring_level <> 'level_2'"), ("terms_review_state", "terms_not_reviewed", "terms_review_state IS NULL"),
    ("automation_approved_by", "automation_unauthorised", "automation_approved_by LIKE 'workflow:%'"), ("activation_state", "not_activated", "activation_state <> 'activated'"), ("activation_approved_by", "activation_unauthorised", "activation_approved_by IS NULL")]))
def access_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handover.access_gate(spark.sql(_TARGETS, customer=view(spark, sf_dir, "customer")))


_RESPONSES = "SELECT user_id AS target, CASE WHEN user_id % 3 = 0 THEN 'human_review' ELSE 'autonomous_research_handoff' END AS change_response, concat('CMP-', CAST(user_id AS STRING)) AS company_id, CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('EVT-', CAST(user_id AS STRING)) END AS earnings_event_id, 'https://ir.example/' AS source_url, 'html' AS source_category FROM {events} GROUP BY user_id"
_SEEN = "SELECT user_id AS target, max(props) AS last_seen_title, CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('D-', CAST(max(event_id) AS STRING)) END AS last_seen_document_id, CAST(NULL AS STRING) AS last_seen_published_at, concat('https://ir.example/', CAST(max(event_id) AS STRING), '.pdf') AS last_seen_document_url, '' AS last_seen_schedule FROM {events} WHERE user_id % 5 <> 0 GROUP BY user_id"


@query(records._RUNS + f""", l AS (SELECT target, arg_max(run_id, row_number) AS run_id, arg_max(result, row_number) AS result, max(row_number) AS n FROM runs GROUP BY 1), t AS ({_RESPONSES.format(events='events')}), c AS ({_SEEN.format(events='events')}),
  m AS (SELECT run_id, od IS DISTINCT FROM document_id AS moved FROM res)
SELECT 'earnings_document_research_v1' AS handoff_version, 'ready_for_document_discovery' AS status, l.target AS monitor_target_id, l.run_id AS monitor_run_id, company_id, nullif(earnings_event_id, '') AS earnings_event_id, source_url, source_category, CAST(row_number AS VARCHAR) AS detected_row,
  'Changed metadata fields: ' || CASE WHEN moved THEN 'document_id' ELSE 'stable_metadata' END AS change_summary, last_seen_title, nullif(last_seen_document_id, '') AS last_seen_document_id, last_seen_published_at, last_seen_document_url, CAST(NULL AS VARCHAR) AS last_seen_schedule,
  'document_discovery|document_content_acquisition|financial_metric_extraction|pre_event_comparison|earnings_evaluation|price_reaction_tracking' AS next_stages, false AS raw_content_included
FROM l JOIN runs ON runs.run_id = l.run_id JOIN t ON t.target = l.target JOIN m ON m.run_id = l.run_id LEFT JOIN c ON c.target = l.target WHERE l.result = 'change_detected' AND change_response = 'autonomous_research_handoff'""")
def research_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events")
    runs = monitor.transitions(records._observations(spark, sf_dir)).withColumn("finished_at", F.col("row_number").cast("string"))
    out = handover.research_handoffs(runs, spark.sql(_RESPONSES, events=events), spark.sql(_SEEN, events=events))
    return out.withColumnRenamed("detected_at", "detected_row").withColumn("next_stages", F.array_join("next_stages", "|"))


_DOCUMENTS = "SELECT o_custkey AS handoff_id, o_orderkey AS pos, concat('https://ir.example/', CAST(o_orderkey AS STRING), '.pdf') AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'earnings_release' WHEN o_orderkey % 7 = 0 THEN 'earnings_presentation' END AS kind FROM {orders} WHERE o_orderkey % 4 = 0"


@query(f"""WITH d AS ({_DOCUMENTS.format(orders='orders')}), c AS (SELECT c_custkey AS handoff_id, count(d.pos) AS n, count(kind) AS k FROM customer LEFT JOIN d ON handoff_id = c_custkey GROUP BY 1)
SELECT handoff_id, 'earnings_document_dispatch_v1' AS dispatch_version, CASE WHEN n > 4 THEN 'beyond_limit' WHEN k > 0 THEN 'analysis_completed' ELSE 'no_target_documents' END AS status, CASE WHEN n > 4 THEN 0 ELSE k END AS analyzed_document_count, CASE WHEN n > 4 THEN 0 ELSE n - k END AS excluded_document_count, false AS raw_document_retained FROM c""")
def handoff_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handover.dispatches(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("handoff_id")), spark.sql(_DOCUMENTS, orders=view(spark, sf_dir, "orders")))


_PROSPECTIVE = ("published_at", "reviewed_by")
_LEGACY = "SELECT row_number, k, CASE WHEN k % 3 = 0 THEN NULL ELSE 'x' END AS published_at, CASE WHEN k % 4 = 0 THEN ' ' ELSE 'human:a' END AS reviewed_by, baseline_status = 'locked' AS is_locked, CASE WHEN k % 5 <> 0 THEN locked_at END AS locked_at, CASE WHEN k % 7 <> 0 THEN 'h' END AS record_hash, k % 2 = 0 AS capable FROM {baseline}"


@query(f"WITH b AS ({_LEGACY.format(baseline='baseline')}), l AS (SELECT * FROM b WHERE published_at IS NULL AND reviewed_by = ' ' AND is_locked) " + rules_sql("pre_earnings_baseline", "l", [("baseline_status", "legacy_in_prospective_file", "capable"), ("locked_at,baseline_record_hash", "legacy_lock_incomplete", "NOT capable AND (locked_at IS NULL OR record_hash IS NULL)")]), "event", "baseline")
def legacy_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_LEGACY, baseline=view(spark, sf_dir, "baseline"))
    return handover.legacy_baselines(rows, _PROSPECTIVE, F.col("capable"))


# Contexts of each group's reviews, with faults planted by the group.
_SOURCES = "SELECT group_id AS context_id, review_no AS pos, CASE WHEN group_id % 7 = 1 THEN group_id ELSE review_id END AS review_id, event_id, review_no AS reviewed_at FROM {r}"
_CONTEXTS = "SELECT group_id AS context_id, CASE WHEN group_id % 7 = 2 THEN max(review_no) - 1 ELSE max(review_no) END AS prepared_at FROM {r} GROUP BY group_id"


@query(f"""{plans._LISTS}, sx AS ({_SOURCES.format(r='r')}), cx AS ({_CONTEXTS.format(r='r')}), ct AS (SELECT group_id AS context_id, field, text, count(*) + CASE WHEN group_id % 7 = 4 THEN 1 ELSE 0 END AS n, list(review_id) AS ids FROM fi WHERE field NOT IN ('additional_indicators', 'supported_but_not_generalized') GROUP BY group_id, field, text)
SELECT DISTINCT context_id, code FROM (SELECT context_id, 'repeated_source_review' AS code FROM sx GROUP BY 1 HAVING count(*) <> count(DISTINCT review_id) UNION ALL SELECT cx.context_id, 'source_from_later' FROM cx JOIN sx USING (context_id) WHERE reviewed_at > prepared_at
  UNION ALL SELECT context_id, 'other_source_events' FROM sx WHERE context_id % 7 = 3 GROUP BY 1 HAVING count(DISTINCT event_id) > 1 UNION ALL SELECT context_id, 'other_count' FROM ct WHERE n <> len(ids)
  UNION ALL SELECT context_id, 'unknown_review' FROM (SELECT context_id, unnest(ids) AS id FROM ct) u WHERE NOT EXISTS (SELECT 1 FROM sx WHERE sx.context_id = u.context_id AND sx.review_id = u.id)) q""", *plans._VIEWS)
def carryover_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = plans._items(spark, sf_dir)
    reviews = items[0]
    order = reviews.groupBy("group_id", "event_id").agg(F.min("review_no").alias("n")).groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda e: e["event_id"]).alias("e"))
    events = order.select(F.col("group_id").alias("context_id"), F.expr("CASE WHEN group_id % 7 = 3 THEN reverse(e) ELSE e END").alias("source_event_ids"))
    contexts = spark.sql(_CONTEXTS, r=reviews).join(events, "context_id")
    carried = learning.carried_rows(reviews, plans._lists(items)).groupBy(F.col("group_id").alias("context_id"), "field", "text").agg((F.count(F.lit(1)) + F.expr("max(CASE WHEN group_id % 7 = 4 THEN 1 ELSE 0 END)")).alias("occurrence_count"), F.collect_list("review_id").alias("source_review_ids"))
    return handover.carryover_contract(contexts, spark.sql(_SOURCES, r=reviews), staged_rows(carried))  # read twice


@query(rules_sql("monitor_target", "(SELECT k AS row_number, k % 9 = 0 AS other FROM event)", [("event_id", "other_company", "other")]), "event")
def target_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "event")
    targets = events.select(F.col("k").alias("row_number"), "event_id", F.expr("CASE WHEN k % 9 = 0 THEN 'CMP-x' ELSE company_id END").alias("company_id"))
    return monitor.target_companies(targets, events)


@query(records._RUNS + ", w AS (SELECT resol.*, runs.finished_at AS e FROM resol LEFT JOIN runs ON runs.run_id = resol.run_id) " + rules_sql("monitor_resolution", "w", [("resolved_at", "outside_window", "NOT coalesce(resolved_at >= e AND resolved_at <= TIMESTAMP '2024-01-20 00:00:00', false)")]))
def resolution_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = records._runs(spark, sf_dir)
    return monitor.resolution_windows(records._resolutions(runs), runs, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


_HYPOTHESES = "SELECT concat('H-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS hypothesis_id, concat('EVT-', CAST(l_orderkey AS STRING)) AS event_id, CASE l_linenumber % 3 WHEN 0 THEN 'post_event' WHEN 1 THEN 'pre_event' ELSE NULL END AS stage, CASE l_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'pending' ELSE 'closed' END AS status, CAST(l_shipdate AS TIMESTAMP) AS created_at FROM {lineitem}"


@query(f"WITH h AS ({_HYPOTHESES.format(lineitem='lineitem')}), l AS (SELECT event_id, max(locked_at) AS lock FROM baseline WHERE baseline_status = 'locked' AND NOT uses_post_event_data AND locked_at IS NOT NULL GROUP BY 1) SELECT hypothesis_id FROM h JOIN l USING (event_id) WHERE stage = 'pre_event' AND status IN ('active', 'pending') AND created_at <= lock", "event", "baseline")
def eligible_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.eligible_hypotheses(spark.sql(_HYPOTHESES, lineitem=view(spark, sf_dir, "lineitem")), view(spark, sf_dir, "baseline")).select("hypothesis_id")
