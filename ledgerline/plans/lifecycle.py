"""Registered queries: rules of statuses, baselines, activations, checkpoints, resolutions and schedules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lifecycle, monitor, schedule
from . import records
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


# Given tables hold none of these fields, so each is derived by key arithmetic, which also plants violations.
_ST = """SELECT *, CASE WHEN k % 13 <> 0 AND status IN ('postponed', 'cancelled') THEN 'moved' END AS status_reason, CASE WHEN k % 17 = 0 THEN 'EVT-' || CAST(k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS STRING) END AS replacement_event_id,
  CASE WHEN status = 'postponed' AND k % 19 <> 0 THEN scheduled_at - INTERVAL '1' DAY WHEN k % 23 = 0 THEN scheduled_at END AS previous_scheduled_at FROM {status}"""
_EV = "SELECT event_id, company_id, scheduled_at + CASE WHEN k % 41 = 0 THEN INTERVAL '1' HOUR ELSE INTERVAL '0' HOUR END AS scheduled_at FROM {event}"
_HY = "SELECT *, CASE WHEN turn % 3 = 0 THEN 'invalidated' ELSE 'active' END AS status, CASE WHEN conv_id % 5 <> 0 THEN CAST(turn AS STRING) END AS invalidated_at, CASE WHEN conv_id % 7 <> 0 THEN 'why' END AS invalidation_reason FROM {hypothesis}"
_BL = """SELECT *, baseline_status = 'locked' AND k % 67 <> 0 AS is_locked, CASE WHEN review_status <> 'pending' AND k % 71 <> 0 THEN 'human:a' WHEN k % 73 = 0 THEN 'human:b' END AS reviewed_by, CASE WHEN k % 6 = 0 THEN locked_at - INTERVAL '3' DAY WHEN k % 79 = 0 THEN locked_at + INTERVAL '2' HOUR ELSE locked_at - INTERVAL '1' HOUR END AS reviewed_at,
  CASE WHEN k % 83 = 0 THEN 'xyz' WHEN baseline_status = 'locked' OR k % 89 = 0 THEN concat(md5(CAST(k AS STRING)), md5(event_id)) END AS record_hash, CASE WHEN baseline_status = 'locked' AND k % 97 <> 0 THEN 'sha256' END AS hash_algorithm, CASE WHEN v = 2 AND k % 101 <> 0 THEN 'newer' WHEN k % 103 = 0 THEN 'odd' END AS supersession_reason,
  as_of AS published_at, as_of + INTERVAL '3' HOUR AS observed_at FROM {baseline}"""
_EVI = "SELECT *, shipped AS published_at, shipped + INTERVAL '1' DAY AS observed_at FROM {evidence}"


def _frame(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: view(spark, sf_dir, name)})


def _cte(name: str, sql: str, source: str) -> str:
    return f"{name} AS ({sql.replace('{' + source + '}', source)})"


_S, _E, _B, _H, _V = _cte("st", _ST, "status"), _cte("ev", _EV, "event"), _cte("bl", _BL, "baseline"), _cte("hy", _HY, "hypothesis"), _cte("evi", _EVI, "evidence")
_T, _P = "event_status_history", "pre_earnings_baseline"


@query(f"WITH {_S}, w AS (SELECT *, lag(status_id) OVER (PARTITION BY event_id ORDER BY row_number) AS earlier FROM st) " + rules_sql(_T, "w", [
    ("occurred_at", "occurred_without_time", "status = 'occurred' AND occurred_at IS NULL"), ("occurred_at", "after_recording", "status = 'occurred' AND occurred_at > recorded_at"), ("occurred_at", "time_without_occurrence", "status <> 'occurred' AND occurred_at IS NOT NULL"),
    ("status_reason", "missing_reason", "status IN ('postponed', 'cancelled') AND status_reason IS NULL"), ("replacement_event_id", "not_cancelled", "replacement_event_id IS NOT NULL AND status <> 'cancelled'"), ("replacement_event_id", "replaces_itself", "replacement_event_id = event_id"),
    ("supersedes", "second_initial", "supersedes IS NULL AND earlier IS NOT NULL"), ("status", "initial_not_scheduled", "supersedes IS NULL AND status <> 'scheduled'"), ("previous_scheduled_at", "initial_with_previous", "supersedes IS NULL AND previous_scheduled_at IS NOT NULL")]), "event", "status")
def status_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.status_fields(_frame(spark, sf_dir, _ST, "status"))


@query(f"WITH {_S}, p AS (SELECT s.*, t.recorded_at AS prec, t.scheduled_at AS psch FROM st s JOIN st t ON s.supersedes = t.status_id) " + rules_sql(_T, "p", [
    ("recorded_at", "not_later", "recorded_at <= prec"), ("previous_scheduled_at", "previous_not_kept", "status = 'postponed' AND previous_scheduled_at IS DISTINCT FROM psch"), ("scheduled_at", "postponed_earlier", "status = 'postponed' AND scheduled_at <= psch"),
    ("previous_scheduled_at", "previous_without_postponement", "status <> 'postponed' AND previous_scheduled_at IS NOT NULL"), ("scheduled_at", "terminal_moves_schedule", "status IN ('cancelled', 'occurred') AND scheduled_at IS DISTINCT FROM psch")]), "event", "status")
def status_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.status_moves(_frame(spark, sf_dir, _ST, "status"))


@query(f"WITH {_S}, {_E}, j AS (SELECT st.*, ev.scheduled_at AS own FROM st JOIN ev USING (event_id) WHERE supersedes IS NULL), r AS (SELECT st.*, a.company_id AS c1, b.company_id AS c2 FROM st JOIN ev a ON a.event_id = st.event_id JOIN ev b ON b.event_id = st.replacement_event_id) "
       + rules_sql(_T, "j", [("scheduled_at", "other_schedule", "scheduled_at <> own")]) + " UNION ALL " + rules_sql(_T, "r", [("replacement_event_id", "other_company", "c1 <> c2")]), "event", "status")
def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses, events = _frame(spark, sf_dir, _ST, "status"), _frame(spark, sf_dir, _EV, "event")
    return lifecycle.initial_schedules(statuses, events).union(lifecycle.replacements(statuses, events))


@query(f"WITH {_H} " + rules_sql("hypothesis_log", "hy", [("invalidation_reason", "missing_reason", "status = 'invalidated' AND (invalidated_at IS NULL OR invalidation_reason IS NULL)")]), "hypothesis")
def hypothesis_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.hypothesis_ends(_frame(spark, sf_dir, _HY, "hypothesis"))


_NOW = "tl AS (SELECT * FROM status s WHERE NOT EXISTS (SELECT 1 FROM status t WHERE t.supersedes = s.status_id)), cur AS (SELECT * FROM tl WHERE event_id IN (SELECT event_id FROM tl GROUP BY 1 HAVING count(*) = 1))"


@query(f"WITH {_NOW}, j AS (SELECT r.*, cur.status AS now FROM review r LEFT JOIN cur USING (event_id) WHERE return_1d IS NOT NULL OR return_5d IS NOT NULL) " + rules_sql("post_earnings_review", "j", [("event_id", "return_without_occurrence", "now IS DISTINCT FROM 'occurred'")]), "event", "status", "review")
def review_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.review_returns(view(spark, sf_dir, "review"), view(spark, sf_dir, "status"), ["return_1d", "return_5d"])


@query(f"WITH {_B}, {_NOW}, bt AS (SELECT event_id, count(*) AS n, min(baseline_status) AS bs, min(review_status) AS rs, min(reviewed_at) AS rev, min(locked_at) AS lck FROM bl b WHERE NOT EXISTS (SELECT 1 FROM bl c WHERE c.supersedes = b.baseline_id) GROUP BY 1), "
       "j AS (SELECT cur.row_number, cur.scheduled_at, o.recorded_at AS pp, n, bs, rs, rev, lck FROM cur JOIN status o ON o.status_id = cur.supersedes AND o.status = 'postponed' LEFT JOIN bt ON bt.event_id = cur.event_id WHERE cur.status = 'occurred') "
       + rules_sql(_T, "j", [("event_id", "no_baseline", "n IS NULL"), ("event_id", "several_baselines", "n > 1"), ("event_id", "baseline_unlocked", "n = 1 AND bs <> 'locked'"), ("event_id", "baseline_unapproved", "n = 1 AND bs = 'locked' AND rs <> 'approved'"),
           ("event_id", "reviewed_too_early", "n = 1 AND bs = 'locked' AND NOT coalesce(rev >= pp, false)"), ("event_id", "locked_too_late", "n = 1 AND bs = 'locked' AND NOT coalesce(lck < scheduled_at, false)")]), "event", "status", "baseline")
def after_postponement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.after_postponement(view(spark, sf_dir, "status"), _frame(spark, sf_dir, _BL, "baseline"))


_LATE = [(c, "after_lock", f"baseline_status = 'locked' AND {c} > locked_at") for c in ("recorded_at", "as_of", "reviewed_at", "published_at", "observed_at")]


@query(f"WITH {_B} " + rules_sql(_P, "bl", [
    ("version", "version_form", "NOT regexp_full_match(version, 'v[1-9][0-9]*')"), ("review_status", "pending_with_reviewer", "review_status = 'pending' AND (reviewed_by IS NOT NULL OR reviewed_at IS NOT NULL)"), ("reviewed_by", "review_without_reviewer", "review_status IN ('approved', 'rejected') AND (reviewed_by IS NULL OR reviewed_at IS NULL)"),
    ("baseline_status", "draft_with_lock", "baseline_status = 'draft' AND (is_locked OR locked_at IS NOT NULL OR record_hash IS NOT NULL OR hash_algorithm IS NOT NULL)"), ("supersedes", "draft_supersedes", "baseline_status = 'draft' AND (supersedes IS NOT NULL OR supersession_reason IS NOT NULL)"),
    ("is_locked", "locked_without_flag", "baseline_status = 'locked' AND NOT is_locked"), ("record_hash", "locked_without_hash", "baseline_status = 'locked' AND record_hash IS NULL"), ("hash_algorithm", "not_sha256", "baseline_status = 'locked' AND hash_algorithm IS NULL"),
    ("review_status", "locked_unapproved", "baseline_status = 'locked' AND review_status <> 'approved'"), ("record_hash", "hash_form", "baseline_status = 'locked' AND hash_algorithm = 'sha256' AND NOT regexp_full_match(record_hash, '[0-9a-fA-F]{64}')"), *_LATE]), "event", "baseline")
def baseline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.baseline_state(_frame(spark, sf_dir, _BL, "baseline"))


_VN = "CASE WHEN regexp_full_match({v}, 'v[1-9][0-9]*') THEN CAST(substr({v}, 2) AS BIGINT) END"


@query(f"WITH {_B}, p AS (SELECT b.*, {_VN.format(v='b.version')} AS vn, {_VN.format(v='c.version')} AS pv FROM bl b LEFT JOIN bl c ON b.supersedes = c.baseline_id) " + rules_sql(_P, "p", [
    ("supersedes", "reason_without_target", "supersession_reason IS NOT NULL AND supersedes IS NULL"), ("baseline_status", "unlocked_supersedes", "supersedes IS NOT NULL AND baseline_status <> 'locked'"), ("supersession_reason", "missing_reason", "supersedes IS NOT NULL AND supersession_reason IS NULL"),
    ("version", "not_greater", "supersedes <> baseline_id AND vn <= pv"), ("supersedes", "must_supersede", "supersedes IS NULL AND baseline_status = 'locked' AND vn > 1")]), "event", "baseline")
def baseline_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.baseline_supersession(_frame(spark, sf_dir, _BL, "baseline"))


_STATES, _TIMES = ("hash_status", "storage_status", "licence_status"), ("published_at", "observed_at")


@query(f"WITH {_V}, m AS (SELECT * FROM evi WHERE entity_type = 'pre_earnings_baseline'), d AS (SELECT * FROM baseline WHERE baseline_status = 'draft' AND baseline_id IN (SELECT entity_id FROM m WHERE used_for_score)), g AS (SELECT entity_id, " + ", ".join([f"bool_or({c} IS NULL) AS no_{c}" for c in _STATES] + [f"max({c}) AS last_{c}" for c in _TIMES])
       + " FROM m GROUP BY 1), j AS (SELECT b.*, g.* FROM baseline b JOIN g ON b.baseline_id = g.entity_id WHERE baseline_status = 'locked') " + rules_sql(_P, "d", [("baseline_status", "draft_evidence_used", "true")]) + " UNION ALL "
       + rules_sql(_P, "j", [("baseline_id", f"evidence_without_{c}", f"no_{c}") for c in _STATES] + [("baseline_id", f"evidence_{c}_after_lock", f"last_{c} > locked_at") for c in _TIMES]), "event", "baseline", "evidence")
def baseline_evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.baseline_evidence_rules(view(spark, sf_dir, "baseline"), _frame(spark, sf_dir, _EVI, "evidence"), _STATES, _TIMES)


# ---- monitor: activations, checkpoints, resolutions

_TG = """SELECT target, CAST(target AS BIGINT) AS row_number, CASE WHEN target % 9 = 4 THEN 'pending' ELSE 'activated' END AS activation_state, target % 7 <> 3 AS enabled, target % 11 <> 5 AS access_permitted, CASE WHEN target % 6 = 2 THEN 'bot' ELSE 'human:a' END AS approved_by, CAST(1 AS BIGINT) AS initialization_generation,
  CASE WHEN target % 8 = 1 THEN 'R-x' ELSE first_id END AS initialization_run_id, first_at - INTERVAL '1' HOUR + CASE WHEN target % 5 = 2 THEN INTERVAL '2' HOUR ELSE INTERVAL '0' HOUR END AS activated_at, target % 4 = 0 AS autonomous, CASE WHEN target % 10 = 9 THEN 'level_1' ELSE 'level_2' END AS monitoring_level,
  CASE WHEN target % 3 = 0 THEN target + 1 END AS schedule_source FROM {firsts}"""
_FIRSTS = "SELECT user_id AS target, 'R-' || CAST(min(event_id) AS STRING) AS first_id, min(ts) AS first_at FROM {events} GROUP BY user_id"
_TARGETS = f", fi AS ({_FIRSTS.format(events='events')}), tg AS ({_TG.format(firsts='fi')})"
_OK = "activation_state = 'activated' AND enabled AND access_permitted AND initialization_run_id = run_id AND activated_at <= started_at"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = spark.sql(_FIRSTS, events=view(spark, sf_dir, "events"))
    return spark.sql(_TG, firsts=firsts)


@query(records._RUNS + _TARGETS + f", f AS (SELECT target, min(row_number) AS row_number, arg_min(run_id, row_number) AS run_id, arg_min(started_at, row_number) AS started_at FROM runs GROUP BY 1), j AS (SELECT f.row_number, NOT coalesce({_OK} AND approved_by LIKE 'human:%', false) AS bad FROM f LEFT JOIN tg USING (target)), i AS (SELECT runs.row_number, NOT coalesce({_OK}, false) AS bad FROM runs JOIN tg USING (target) WHERE result = 'initialized') "
       + rules_sql("monitor_run", "j", [("run_id", "not_authorised", "bad")]) + " UNION ALL " + rules_sql("monitor_run", "i", [("result", "no_matching_activation", "bad")]))
def initial_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, targets = records._runs(spark, sf_dir), _targets(spark, sf_dir).drop("row_number")
    return monitor.initial_activation(runs, targets).union(monitor.initialized_runs(runs.withColumn("generation", F.lit(1).cast("long")), targets))


_CP = "CAST(target AS BIGINT) AS row_number, target, CASE WHEN target % 5 = 1 THEN 'R-old' WHEN target % 5 <> 2 THEN pending END AS pending_run_id, CASE target % 6 WHEN 0 THEN 'healthy' WHEN 1 THEN 'stopped' ELSE 'pending_human_review' END AS state, CASE WHEN target % 12 = 6 THEN 'X' END AS resolution_id"


@query(records._RUNS + records._OPEN + _TARGETS + f""", la AS (SELECT target, arg_max(coalesce(error_code, ''), row_number) AS code, max((result = 'change_detected')::INT) AS changed FROM runs GROUP BY 1),
  cp AS (SELECT {_CP} FROM (SELECT la.target, un.pending_run_id AS pending FROM la LEFT JOIN un USING (target))), j AS (SELECT cp.*, enabled, autonomous, un.pending_run_id AS op, un.pending_run_id IS NOT NULL AND NOT autonomous AS waiting, code IN ('state_unavailable', 'persistence_error') AS fatal, changed FROM cp JOIN tg USING (target) LEFT JOIN un USING (target) LEFT JOIN la USING (target)) """
       + rules_sql("monitor_checkpoint", "j", [("pending_run_id", "pending_lost", "waiting AND pending_run_id IS DISTINCT FROM op"), ("state", "not_pending", "waiting AND state <> CASE WHEN fatal THEN 'stopped' ELSE 'pending_human_review' END"), ("pending_run_id", "pending_kept", "NOT waiting AND pending_run_id IS NOT NULL"),
           ("state", "pending_without_change", "NOT waiting AND state = 'pending_human_review'"), ("resolution_id", "resolution_missing", "resolution_id IS NULL AND changed = 1 AND NOT waiting AND state = 'healthy' AND NOT autonomous"), ("state", "disabled_but_active", "NOT enabled AND state NOT IN ('disabled', 'uninitialized', 'stopped')")]))
def checkpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = records._runs(spark, sf_dir)
    resolved = records._resolutions(runs)
    open_ = runs.select("target").distinct().join(monitor.unresolved_changes(runs, resolved).select("target", F.col("pending_run_id").alias("pending")), "target", "left")
    checkpoints = spark.sql(f"SELECT {_CP} FROM {{open_}}", open_=open_)
    return monitor.state_expectations(checkpoints, runs, resolved, _targets(spark, sf_dir))


_RS = """SELECT event_id AS row_number, 'RS-' || CAST(event_id AS STRING) AS resolution_id, CASE WHEN event_id % 7 = 0 THEN 'bot' ELSE 'human:a' END AS resolved_by, user_id AS target, 'R-' || CAST(CAST(floor(event_id / 3) AS BIGINT) AS STRING) AS run_id, ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL '-2' HOUR ELSE INTERVAL '0' HOUR END AS resolved_at,
  CASE WHEN event_id % 23 = 0 THEN 'RS-' || CAST(event_id AS STRING) WHEN event_id % 3 <> 0 THEN 'RS-' || CAST(event_id - 1 - CASE WHEN event_id % 13 = 0 THEN 3 ELSE 0 END AS STRING) END AS supersedes FROM {events}"""
_RSC = f"WITH rs AS ({_RS.format(events='events')}), p AS (SELECT a.*, b.row_number AS pn, b.target AS pt, b.run_id AS pr, b.resolved_at AS pa, lag(a.resolution_id) OVER (PARTITION BY a.run_id ORDER BY a.row_number) AS last FROM rs a LEFT JOIN rs b ON a.supersedes = b.resolution_id)"


@query(_RSC + " " + rules_sql("monitor_resolution", "p", [
    ("resolved_by", "not_human", "resolved_by NOT LIKE 'human:%'"), ("supersedes", "supersedes_itself", "supersedes = resolution_id"), ("supersedes", "later_parent", "pn >= row_number"), ("supersedes", "other_source", "pn IS NOT NULL AND (pt <> target OR pr <> run_id)"),
    ("resolved_at", "not_later", "resolved_at <= pa"), ("supersedes", "not_current", "supersedes IS NOT NULL AND supersedes IS DISTINCT FROM last"), ("supersedes", "must_supersede", "supersedes IS NULL AND last IS NOT NULL")]))
def resolution_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_RS, events=view(spark, sf_dir, "events"))
    return monitor.resolution_records(rows).union(monitor.resolution_lineage(rows))


@query(_RSC + " SELECT run_id, arg_max(resolution_id, row_number) AS resolution_id FROM rs GROUP BY 1 HAVING arg_max(resolution_id, row_number) NOT IN (SELECT supersedes FROM rs WHERE supersedes IS NOT NULL)")
def effective_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.effective_resolutions(spark.sql(_RS, events=view(spark, sf_dir, "events"))).select("run_id", "resolution_id")


# ---- schedules

_CAL = "SELECT CAST(c_custkey AS BIGINT) AS target, concat(CAST(DATE '2024-02-01' + CAST(c_custkey % 30 AS INT) AS STRING), '=results;2024-03=later | ', CASE WHEN c_custkey % 4 = 0 THEN '2024-02-06=meeting' ELSE 'none' END) AS schedule FROM {customer}"
_CT = "SELECT CAST(c_custkey AS BIGINT) AS target, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey + 1 AS BIGINT) END AS schedule_source, CASE WHEN c_custkey % 5 = 0 THEN DATE '2024-02-07' END AS event_date, c_custkey % 7 <> 0 AS enabled, CASE WHEN c_custkey % 11 = 0 THEN 'suspended' ELSE 'activated' END AS activation_state, CASE WHEN c_custkey % 13 = 0 THEN 'level_1' ELSE 'level_2' END AS monitoring_level, c_custkey % 17 <> 0 AS access_permitted FROM {customer}"
_DAY, _AT = "DATE '2024-02-05'", "TIMESTAMP '2024-02-05 01:00:00'"
_OBSERVED = f"""WITH ca AS ({_CAL.format(customer='customer')}), ct AS ({_CT.format(customer='customer')}), pd AS (SELECT target AS source, list_min(list_filter(list_transform(list_filter(list_transform(string_split(replace(schedule, '|', ';'), ';'), lambda e: trim(split_part(e, '=', 1))), lambda e: regexp_full_match(e, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')), lambda x: try_cast(x AS DATE)), lambda x: x >= {_DAY})) AS observed FROM ca),
  ob AS (SELECT ct.target, observed FROM ct JOIN pd ON pd.source = ct.schedule_source WHERE observed IS NOT NULL)"""


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = view(spark, sf_dir, "customer")
    targets = spark.sql(_CT, customer=customer)
    return targets, schedule.observed_dates(targets, spark.sql(_CAL, customer=customer), F.expr(_DAY))


@query(_OBSERVED + " SELECT target, CAST(observed AS VARCHAR) AS observed, 'published' AS status FROM ob UNION ALL SELECT target, NULL, 'unresolved' FROM ct WHERE schedule_source IS NOT NULL AND target NOT IN (SELECT target FROM ob)")
def observed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, observed = _calendar(spark, sf_dir)
    missing = schedule.unresolved_sources(targets, observed).select("target", F.lit(None).cast("string").alias("observed"), F.lit("unresolved").alias("status"))
    return observed.select("target", F.col("observed").cast("string").alias("observed"), F.lit("published").alias("status")).union(missing)


@query(_OBSERVED + f""", pl AS (SELECT ct.target, coalesce(observed, event_date) AS d FROM ct LEFT JOIN ob USING (target) WHERE enabled AND activation_state = 'activated' AND monitoring_level = 'level_2' AND access_permitted)
  SELECT target, CAST(d AS VARCHAR) AS event_date FROM pl WHERE d = {_DAY} OR (d > {_DAY} AND len(list_filter(generate_series({_DAY} + INTERVAL 1 DAY, d::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) <= 5)""")  # fmt: skip
def active_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, observed = _calendar(spark, sf_dir)
    return schedule.active_plan(targets, F.expr(_AT), observed).select("target", F.col("event_date").cast("string").alias("event_date"))


_REF = "SELECT CAST(c_custkey AS BIGINT) AS target, CASE WHEN c_custkey % 19 <> 0 THEN TIMESTAMP '2024-02-05 03:00:00' - INTERVAL '1' HOUR * (c_custkey % 120) END AS reference, CASE WHEN c_custkey % 4 <> 1 THEN DATE '2024-02-02' + CAST(c_custkey % 15 AS INT) END AS event_date, c_custkey % 8 = 1 AS event_required FROM {customer}"
_NOW_AT = "TIMESTAMP '2024-02-05 03:00:00'"


@query(f"""WITH rf AS ({_REF.format(customer='customer')}), w AS (SELECT *, {_NOW_AT} AS now, CASE WHEN event_date IS NULL AND event_required THEN 'event_day' WHEN event_date = {_DAY} THEN 'event_day' WHEN event_date > {_DAY} AND len(list_filter(generate_series({_DAY} + INTERVAL 1 DAY, event_date::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) <= 5 THEN 'event_window' ELSE 'normal' END AS win, reference AS s FROM rf), h AS (SELECT *, CASE win WHEN 'event_day' THEN 12 WHEN 'event_window' THEN 24 ELSE 60 END AS hrs FROM w)
  SELECT target, 'state_unavailable' AS error_code, 'stale gap exceeded ' || CAST(hrs AS VARCHAR) || '-hour ' || win || ' threshold' AS error_detail FROM h WHERE s IS NULL OR {records._BIZ} > 3600 * hrs""")  # fmt: skip
def stale_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_REF, customer=view(spark, sf_dir, "customer"))
    return schedule.stale_failures(rows, F.expr(_NOW_AT)).select("target", "error_code", "error_detail")


_ACK = "SELECT event_id AS row_number, user_id AS target, ts + INTERVAL '1' DAY * (event_id % 5) AS acknowledged_at, CASE WHEN event_id % 9 <> 0 THEN ts - INTERVAL '1' HOUR * (event_id % 50) END AS gap_end FROM {events} WHERE event_id % 4 = 0"
_CK = "SELECT user_id AS target, CASE WHEN user_id % 3 = 0 THEN 'healthy' ELSE 'stopped' END AS state, CASE WHEN user_id % 5 = 0 THEN 'timeout' ELSE 'state_unavailable' END AS error_code, min(ts) + INTERVAL '12' HOUR AS last_success_at FROM {events} GROUP BY user_id"
_START = "TIMESTAMP '2024-01-20 00:00:00'"


@query(f"WITH ac AS ({_ACK.format(events='events')}), ck AS ({_CK.format(events='events')}), j AS (SELECT ac.*, state, error_code, last_success_at FROM ac LEFT JOIN ck USING (target)) " + rules_sql("monitor_gap_acknowledgement", "j", [
    ("target", "not_stale", "NOT coalesce(state = 'stopped' AND error_code = 'state_unavailable', false)"), ("acknowledged_at", "from_later", f"acknowledged_at > {_START}"), ("gap_end", "gap_closed", "gap_end IS NULL OR gap_end < last_success_at")]))
def new_acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "events")
    return schedule.new_acknowledgements(spark.sql(_ACK, events=events), spark.sql(_CK, events=events), F.expr(_START))
