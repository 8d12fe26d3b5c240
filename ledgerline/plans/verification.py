"""Registered queries: verification after events, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation, monitor, verification
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


_RV = """SELECT row_number, event_id, baseline_id, CAST(o_custkey AS STRING) AS ticker, scheduled_at + INTERVAL '2' DAY AS reviewed_at, CASE WHEN k % 13 = 0 THEN 'draft' ELSE 'evaluated' END AS evaluation_status, scheduled_at + INTERVAL '1' DAY + CASE WHEN k % 17 = 0 THEN INTERVAL '3' DAY ELSE INTERVAL '0' DAY END AS evaluated_at, scheduled_at AS announced_at,
  k % 19 <> 0 AS is_locked, k % 23 = 0 AS uses_post_event_data, CASE WHEN k % 29 <> 0 THEN scheduled_at - INTERVAL '1' HOUR + CASE WHEN k % 31 = 0 THEN INTERVAL '3' HOUR ELSE INTERVAL '0' HOUR END END AS locked_at, event_id AS b_event_id, CASE WHEN k % 37 = 0 THEN 'B' ELSE baseline_id END AS b_baseline_id,
  event_id AS r_event_id, CAST(o_custkey + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END AS STRING) AS r_ticker, CASE WHEN k % 2 = 0 THEN event_id END AS p_event_id, CASE WHEN k % 43 = 0 THEN 'B' END AS p_baseline_id, CAST(NULL AS STRING) AS p_ticker, CASE WHEN k % 2 = 0 THEN scheduled_at + INTERVAL '1' DAY + CASE WHEN k % 8 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END END AS p_reviewed_at
  FROM (SELECT *, 'B1-' || CAST(k AS STRING) AS baseline_id FROM {event}) e"""


@query(f"WITH rv AS ({_RV.replace('{event}', 'event')}) " + rules_sql("review", "rv", [
    ("evaluation_status", "not_evaluated", "evaluation_status <> 'evaluated'"), ("is_locked", "not_immutable", "NOT is_locked OR uses_post_event_data"), ("locked_at", "missing_time", "locked_at IS NULL"), ("baseline_id", "b_differs", "b_baseline_id <> baseline_id"), ("ticker", "r_differs", "r_ticker <> ticker"),
    ("baseline_id", "p_differs", "p_baseline_id <> baseline_id"), ("reviewed_at", "before_sources", "reviewed_at < evaluated_at OR reviewed_at < announced_at"), ("locked_at", "after_announcement", "locked_at >= announced_at"), ("locked_at", "after_evaluation", "locked_at > evaluated_at"),
    ("reviewed_at", "not_after_previous", "reviewed_at <= p_reviewed_at")]), "event")
def review_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.review_gates(spark.sql(_RV, event=view(spark, sf_dir, "event")))


_WORD = "CASE conv_id % 5 WHEN 0 THEN 'company guidance: ' WHEN 1 THEN 'Invalidation condition: ' ELSE '' END"
_LOG = f"SELECT 'H-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS hypothesis_id, conv_id AS event_id, CASE WHEN turn % 4 = 3 THEN 'invalidation' WHEN conv_id % 11 = 0 THEN 'draft' ELSE 'pre_event' END AS hypothesis_type, CAST(turn AS BIGINT) AS created_at, concat({_WORD}, text) AS hypothesis_text, CASE WHEN turn % 4 = 3 THEN 'H-' || CAST(conv_id AS STRING) || '-' || CAST(turn - 3 AS STRING) END AS parent_id, CASE WHEN turn % 4 = 3 THEN 'invalidated' ELSE 'active' END AS status FROM {{conversations}}"
_ASSESSED = f"SELECT conv_id * 1000 + turn AS row_number, CAST(conv_id + CASE WHEN conv_id % 13 = 0 AND turn = 0 THEN 1 ELSE 0 END AS BIGINT) AS event_id, 'H-' || CAST(conv_id AS STRING) || '-' || CAST(turn + CASE WHEN conv_id % 17 = 0 AND turn = 0 THEN 500 ELSE 0 END AS STRING) AS hypothesis_id, CASE WHEN conv_id % 7 = 2 THEN text ELSE concat({_WORD}, text) END AS hypothesis_text, CASE turn % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'mixed' WHEN 2 THEN 'invalidated' ELSE 'pending' END AS result FROM {{conversations}} WHERE turn % 4 <> 3 AND turn < 8"
_LOCKS = "SELECT DISTINCT conv_id AS event_id, CAST(3 + conv_id % 3 AS BIGINT) AS locked_at FROM {conversations}"
_CTES = f"WITH lg AS ({_LOG.format(conversations='conversations')}), aa AS ({_ASSESSED.format(conversations='conversations')}), lk AS ({_LOCKS.format(conversations='conversations')})"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "conversations")
    log, assessed = spark.sql(_LOG, conversations=turns), spark.sql(_ASSESSED, conversations=turns)
    return verification.verifications(assessed, verification.invalidations(log, assessed))


@query(_CTES + ", j AS (SELECT aa.*, lg.hypothesis_id AS lid, lg.event_id AS le, lg.hypothesis_type AS lt, lg.created_at AS lc, lg.hypothesis_text AS lx, locked_at FROM aa LEFT JOIN lg USING (hypothesis_id) LEFT JOIN lk ON lk.event_id = aa.event_id) " + rules_sql("hypothesis_log", "j", [
    ("hypothesis_id", "not_logged", "lt IS NULL"), ("event_id", "other_event", "le <> event_id"), ("hypothesis_type", "not_pre_event", "lt <> 'pre_event'"), ("created_at", "after_lock", "lc > locked_at"), ("hypothesis_text", "other_text", "lx <> hypothesis_text")]))
def resolved_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "conversations")
    return verification.resolved_hypotheses(spark.sql(_ASSESSED, conversations=turns), spark.sql(_LOG, conversations=turns), spark.sql(_LOCKS, conversations=turns))[0]


_VER = _CTES + """, iv AS (SELECT parent_id AS hypothesis_id, string_agg(hypothesis_id, ',' ORDER BY hypothesis_id) AS ids FROM lg WHERE hypothesis_type = 'invalidation' AND parent_id IN (SELECT hypothesis_id FROM aa) GROUP BY 1),
 ve AS (SELECT aa.*, CASE result WHEN 'supported' THEN 'supported' WHEN 'mixed' THEN 'partially_supported' WHEN 'invalidated' THEN 'rejected' ELSE 'pending' END AS verified, coalesce(ids, '') AS ids, CASE WHEN ids IS NOT NULL THEN 'triggered' WHEN result = 'invalidated' THEN 'insufficient_evidence' WHEN contains(lower(hypothesis_text), 'invalidation condition:') THEN 'not_triggered' ELSE 'not_recorded' END AS condition_status FROM aa LEFT JOIN iv USING (hypothesis_id))"""


@query(_VER + " SELECT row_number, verified, condition_status, ids AS record_ids FROM ve")
def hypothesis_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("row_number", "verified", "condition_status", F.concat_ws(",", "record_ids").alias("record_ids"))


@query(_VER + ", x AS (SELECT event_id, list_distinct(list(verified) FILTER (contains(lower(hypothesis_text), 'company guidance:'))) AS l FROM ve GROUP BY 1) SELECT event_id, CASE WHEN l IS NULL OR len(l) = 0 THEN 'not_recorded' WHEN len(l) > 1 OR l[1] = 'partially_supported' THEN 'mixed' WHEN l[1] = 'supported' THEN 'supported' WHEN l[1] = 'rejected' THEN 'contradicted' ELSE 'insufficient_evidence' END AS guidance_read FROM x")
def guidance_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.guidance_read(_verified(spark, sf_dir), "event_id")


_O, _C = "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}", "SELECT c_custkey AS o_custkey, c_custkey, DATE '2024-01-01' AS day FROM {customer}"


@query(f"WITH o AS ({_O.format(orders='orders')}), c AS ({_C.format(customer='customer')}) SELECT o_custkey, 'earnings_evaluation' AS record_type, CAST(o_orderkey AS VARCHAR) AS record_id, CAST(day AS VARCHAR) AS recorded_at, sha256(to_json({{'day': CAST(day AS VARCHAR), 'o_custkey': o_custkey, 'o_orderkey': o_orderkey}})) AS content_sha256 FROM o UNION ALL SELECT o_custkey, 'pre_event_baseline', CAST(c_custkey AS VARCHAR), CAST(day AS VARCHAR), sha256(to_json({{'c_custkey': c_custkey, 'day': CAST(day AS VARCHAR), 'o_custkey': o_custkey}})) FROM c")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = spark.sql(_O, orders=view(spark, sf_dir, "orders")), spark.sql(_C, customer=view(spark, sf_dir, "customer"))
    out = verification.source_records({"earnings_evaluation": (orders, "o_orderkey", "day"), "pre_event_baseline": (customer, "c_custkey", "day")}, "o_custkey")
    return out.withColumn("recorded_at", F.col("recorded_at").cast("string"))


@query("WITH f AS (SELECT o_custkey, o_orderpriority AS event_id, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2) SELECT o_custkey, event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY seen, event_id)::INT AS n FROM f")
def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.source_events(view(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("event_id"), "o_orderkey"), "o_custkey", "o_orderkey")


_EXPECTED = "SELECT l_orderkey AS event_id, 'm' || CAST(l_linenumber AS STRING) AS metric, CAST(l_quantity AS DOUBLE) AS value, CASE WHEN l_partkey % 5 = 0 THEN 'q1' ELSE 'full_year' END AS scope, CASE WHEN l_partkey % 7 = 0 THEN 'USD' ELSE 'JPY' END AS unit FROM {lineitem}"
_ACTUAL = "SELECT l_orderkey AS event_id, 'm' || CAST(l_linenumber AS STRING) AS metric, CAST(l_quantity + l_suppkey % 3 - 1 AS DOUBLE) AS value, 'full_year' AS scope, 'JPY' AS unit FROM {lineitem} WHERE l_suppkey % 9 <> 0"
_CMP = f"WITH x AS ({_EXPECTED.format(lineitem='lineitem')}), a AS ({_ACTUAL.format(lineitem='lineitem')}), j AS (SELECT x.event_id, x.metric, x.value AS e, a.value AS v FROM x JOIN a ON x.event_id = a.event_id AND x.metric = a.metric AND x.scope = a.scope AND x.unit = a.unit)"


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = view(spark, sf_dir, "lineitem")
    expected = spark.sql(_EXPECTED, lineitem=items)
    return expected, evaluation.consensus_comparison(expected, spark.sql(_ACTUAL, lineitem=items), ["event_id", "metric"])[0]


@query(_CMP + " SELECT event_id, metric, e AS expected, v AS actual, CASE WHEN e <> 0 THEN (v - e) / abs(e) * 100 END AS pct, CASE WHEN e = 0 OR abs((v - e) / abs(e) * 100) <= 1.0 THEN 'in_line' WHEN v > e THEN 'above' ELSE 'below' END AS band FROM j")
def consensus_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)[1]


@query(_CMP + " SELECT event_id, string_agg(DISTINCT metric, ',' ORDER BY metric) AS limitations FROM x WHERE (event_id, metric) NOT IN (SELECT (event_id, metric) FROM j) GROUP BY 1")
def evaluation_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, compared = _compared(spark, sf_dir)
    return verification.evaluation_limits(expected, compared, ["event_id", "metric"]).select("event_id", F.concat_ws(",", "limitations").alias("limitations"))


@query("SELECT p_partkey, CASE WHEN d IN ('', 'none') AND v IN ('', 'none') THEN '' WHEN d IN ('', 'none') THEN v WHEN v IN ('', 'none') THEN d ELSE d || ' | ' || v END AS summary FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN p_name ELSE '' END AS d, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS v FROM part)")
def schedule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN p_name ELSE '' END AS d", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS v")
    return rows.select("p_partkey", monitor.schedule_summary(F.col("d"), F.col("v")).alias("summary"))
