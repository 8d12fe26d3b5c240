"""Registered queries: row checks, keys, references, point in time and lineage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation, keys, lineage, pointintime as pit, rowchecks
from ..operators.issues import check, report
from ..sources.specs import ColumnSpec, TableSpec
from .views import view, with_views

ISSUE = "'{t}' AS \"table\", CAST(row_number AS BIGINT) AS row_number, '{c}' AS \"column\", '{k}' AS code"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "", *views: str):
    """Register a query under its function's name, with its SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def rules_sql(table: str, source: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {ISSUE.format(t=table, c=c, k=k)} FROM {source} WHERE {cond}" for c, k, cond in rules)


# ---- flagship: expected against reported


@query(
    """SELECT event_id, baseline_id, CAST(consensus_revenue AS DOUBLE) AS expected, CAST(revenue AS DOUBLE) AS actual,
      CASE WHEN consensus_revenue <> 0 THEN (CAST(revenue AS DOUBLE) - CAST(consensus_revenue AS DOUBLE)) / abs(CAST(consensus_revenue AS DOUBLE)) * 100 END AS pct,
      CASE WHEN consensus_revenue = 0 OR abs((CAST(revenue AS DOUBLE) - CAST(consensus_revenue AS DOUBLE)) / abs(CAST(consensus_revenue AS DOUBLE)) * 100) <= 1.0 THEN 'in_line'
        WHEN revenue > consensus_revenue THEN 'above' ELSE 'below' END AS band
    FROM baseline b JOIN actual a ON a.k = b.k WHERE baseline_status = 'locked' AND NOT uses_post_event_data AND locked_at IS NOT NULL""",
    "event", "baseline", "actual",
)
def flagship_consensus_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = evaluation.eligible_baselines(view(spark, sf_dir, "baseline"))
    rows = eligible.join(view(spark, sf_dir, "actual"), "k")
    pct = evaluation.pct_change(F.col("revenue").cast("double"), F.col("consensus_revenue").cast("double"))
    return rows.select("event_id", "baseline_id", F.col("consensus_revenue").cast("double").alias("expected"), F.col("revenue").cast("double").alias("actual"), pct.alias("pct"), evaluation.band(pct).alias("band"))


# ---- row checks

ORDERS = TableSpec(
    "orders",
    (
        ColumnSpec("id", "integer", required=True), ColumnSpec("status", required=True, allowed=("F", "O")), ColumnSpec("price", "decimal", minimum=1000, maximum=400000),
        ColumnSpec("day", "date", required=True), ColumnSpec("flag", "boolean"), ColumnSpec("note", required=True),
    ),
)
_RAW = """raw AS (SELECT o_orderkey + 2 AS row_number, CASE WHEN o_orderkey % 17 = 0 THEN 'x' || CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey AS STRING) END AS id, o_orderstatus AS status,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS price, CASE WHEN o_orderkey % 19 = 0 THEN '2024/01/05' WHEN o_orderkey % 29 = 0 THEN '2023-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day,
  CASE WHEN o_orderkey % 13 = 0 THEN 'yes' WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'false' END AS flag, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE o_orderpriority END AS note FROM {orders})"""


@query(
    "WITH " + _RAW.format(orders="orders") + " " + rules_sql("orders", "raw", [
        ("id", "required", "trim(coalesce(id, '')) = ''"), ("id", "not_integer", "trim(coalesce(id, '')) <> '' AND NOT regexp_full_match(id, '[+-]?[0-9]+')"),
        ("status", "required", "trim(coalesce(status, '')) = ''"), ("status", "not_allowed", "status NOT IN ('F', 'O')"),
        ("price", "not_decimal", "trim(price) <> '' AND try_cast(price AS DECIMAL(38, 10)) IS NULL"), ("price", "below_minimum", "try_cast(price AS DECIMAL(38, 10)) < 1000"), ("price", "above_maximum", "try_cast(price AS DECIMAL(38, 10)) > 400000"),
        ("day", "required", "trim(coalesce(day, '')) = ''"), ("day", "not_date", "trim(day) <> '' AND (NOT regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(day AS DATE) IS NULL)"),
        ("flag", "not_boolean", "lower(flag) NOT IN ('true', 'false')"), ("note", "required", "trim(coalesce(note, '')) = ''"),
    ])
)
def rowcheck_required_types_enum_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _RAW.removeprefix("raw AS (").removesuffix(")")
    return rowchecks.row_checks(spark.sql(sql, orders=view(spark, sf_dir, "orders")), ORDERS)


@query(
    """SELECT row_number, who, regexp_full_match(who, 'human:\\S.*') AS is_human, regexp_full_match(who, '(human|system_policy):\\S.*') AS is_authorizer FROM
    (SELECT row_number, CASE row_number % 4 WHEN 0 THEN 'human:' || name WHEN 1 THEN 'system_policy:' || exchange WHEN 2 THEN 'human:' ELSE name END AS who FROM company)""", "company")  # fmt: skip
def identifier_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "company").selectExpr("row_number", "CASE row_number % 4 WHEN 0 THEN 'human:' || name WHEN 1 THEN 'system_policy:' || exchange WHEN 2 THEN 'human:' ELSE name END AS who")
    return rows.select("row_number", "who", rowchecks.is_human(F.col("who")).alias("is_human"), rowchecks.is_authorizer(F.col("who")).alias("is_authorizer"))


# ---- keys and references


@query(
    """SELECT 'lineitem' AS "table", row_number, 'l_partkey,l_suppkey,l_returnflag' AS "column", 'duplicate_key' AS code, first_row FROM
    (SELECT l_orderkey * 8 + l_linenumber AS row_number, min(l_orderkey * 8 + l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag) AS first_row FROM lineitem) WHERE row_number > first_row""")  # fmt: skip
def dup_keys_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "lineitem").withColumn("row_number", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return keys.duplicate_keys(rows, "lineitem", ["l_partkey", "l_suppkey", "l_returnflag"])


@query(rules_sql("review", "review", [("baseline_id", "missing_reference", "baseline_id NOT IN (SELECT baseline_id FROM baseline)")]), "event", "baseline", "review")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.missing_references(view(spark, sf_dir, "review"), "review", ["baseline_id"], view(spark, sf_dir, "baseline"), ["baseline_id"])


@query(rules_sql("status", "status", [("supersedes", "missing_reference", "supersedes IS NOT NULL AND supersedes NOT IN (SELECT status_id FROM status)")]), "event", "status")
def fk_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "status")
    return keys.missing_references(rows, "status", ["supersedes"], rows, ["status_id"], nullable=True)


_ENTITIES = "(SELECT 'earnings_event' AS t, event_id AS i FROM event UNION ALL SELECT 'pre_earnings_baseline', baseline_id FROM baseline UNION ALL SELECT 'pre_note', event_id FROM event UNION ALL SELECT 'company_master', company_id FROM company)"


@query(f"SELECT {ISSUE.format(t='evidence', c='entity_type,entity_id', k='missing_entity')} FROM evidence LEFT JOIN {_ENTITIES} e ON entity_type = e.t AND entity_id = e.i WHERE e.i IS NULL", "company", "event", "baseline", "evidence")
def fk_polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, baseline, company = (view(spark, sf_dir, n) for n in ("event", "baseline", "company"))
    ids = keys.entity_ids({"earnings_event": (event, "event_id"), "pre_earnings_baseline": (baseline, "baseline_id"), "pre_note": (event, "event_id"), "company_master": (company, "company_id")})
    return keys.missing_entities(view(spark, sf_dir, "evidence"), "evidence", "entity_type", "entity_id", ids)


@query(rules_sql("hypothesis", "hypothesis", [("parent_id", "missing_reference", "parent_id IS NOT NULL AND parent_id NOT IN (SELECT hypothesis_id FROM hypothesis)")]), "hypothesis")
def parent_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "hypothesis")
    return keys.missing_references(rows, "hypothesis", ["parent_id"], rows, ["hypothesis_id"], nullable=True)


# ---- point in time

_CURRENT = "tails AS (SELECT * FROM status s WHERE NOT EXISTS (SELECT 1 FROM status t WHERE t.supersedes = s.status_id)), cur AS (SELECT * FROM tails WHERE event_id IN (SELECT event_id FROM tails GROUP BY 1 HAVING count(*) = 1))"
_TIMED = _CURRENT + ", timed AS (SELECT e.*, cur.status, coalesce(CASE WHEN cur.status = 'occurred' THEN cur.occurred_at ELSE cur.scheduled_at END, e.scheduled_at) AS event_time FROM event e LEFT JOIN cur ON e.event_id = cur.event_id)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.effective_times(view(spark, sf_dir, "event"), view(spark, sf_dir, "status"))


@query(f"WITH {_TIMED} SELECT event_id, status, date_diff('second', TIMESTAMP '1990-01-01', event_time)::BIGINT AS at_s FROM timed", "event", "status")
def effective_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select("event_id", "status", F.expr("timestampdiff(SECOND, TIMESTAMP '1990-01-01 00:00:00', event_time)").alias("at_s"))


@query(f"WITH {_TIMED}, j AS (SELECT b.*, event_time FROM baseline b JOIN timed ON b.event_id = timed.event_id) " + rules_sql("pre_earnings_baseline", "j", [
    (c, "not_before_event", f"{c} >= event_time") for c in ("as_of", "recorded_at", "locked_at")] + [("uses_post_event_data", "post_event_data", "uses_post_event_data")]), "event", "status", "baseline")
def lookahead_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.look_ahead(view(spark, sf_dir, "baseline"), _timed(spark, sf_dir), ["as_of", "recorded_at", "locked_at"])


@query(f"WITH {_TIMED}, j AS (SELECT r.*, event_time FROM review r JOIN timed ON r.event_id = timed.event_id), l AS (SELECT r.*, b.event_id AS be, baseline_status FROM review r JOIN baseline b ON r.baseline_id = b.baseline_id) "
       + rules_sql("post_earnings_review", "j", [("recorded_at", "not_after_event", "recorded_at <= event_time")]) + " UNION ALL "
       + rules_sql("post_earnings_review", "l", [("baseline_id", "other_event", "be <> event_id"), ("baseline_id", "draft_baseline", "baseline_status = 'draft'")]), "event", "status", "baseline", "review")
def review_after_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = view(spark, sf_dir, "review")
    return report([pit.review_times(reviews, _timed(spark, sf_dir)), pit.review_links(reviews, view(spark, sf_dir, "baseline"))])


_VERSIONS = "SELECT 'sv' || CAST(p_size % 3 AS STRING) AS scoring_version, CAST(concat(CAST(1995 + p_size % 4 AS STRING), '-06-01') AS DATE) AS effective_from FROM {part}"


@query("WITH v AS (SELECT scoring_version AS sv, max(effective_from) AS f FROM (" + _VERSIONS.format(part="part") + ") GROUP BY 1), j AS (SELECT b.*, f FROM baseline b LEFT JOIN v ON scoring_version = sv) "
       + rules_sql("pre_earnings_baseline", "j", [("scoring_version", "undefined", "f IS NULL"), ("scoring_version", "not_effective", "CAST(as_of AS DATE) < f")]), "event", "baseline")
def score_version_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.score_versions(view(spark, sf_dir, "baseline"), spark.sql(_VERSIONS, part=view(spark, sf_dir, "part")), "pre_earnings_baseline", "as_of")


_KPI = """SELECT row_number, 'EVT-' || CAST(k AS STRING) AS event_id, k, n, used_for_score, CASE WHEN l_partkey % 3 = 0 THEN 'actual' ELSE 'expected' END AS value_type,
  CASE WHEN l_partkey % 37 = 0 THEN 'CMP-x' ELSE NULL END AS other, l_partkey FROM {evidence}"""


@query(f"WITH {_TIMED}, q AS ({_KPI.format(evidence='evidence')}), j AS (SELECT q.*, coalesce(other, company_id) AS company_id, company_id AS ec, event_time, event_time + INTERVAL '1' HOUR * (l_partkey % 7 - 4) AS recorded_at FROM q JOIN timed ON q.event_id = timed.event_id) "
       + rules_sql("kpi_observation", "j", [("company_id", "other_company", "company_id <> ec"), ("value_type", "score_uses_actual", "used_for_score AND value_type <> 'expected'"),
           ("recorded_at", "score_after_event", "used_for_score AND recorded_at >= event_time"), ("recorded_at", "actual_before_event", "value_type = 'actual' AND recorded_at < event_time")]), "event", "status", "evidence")
def kpi_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _timed(spark, sf_dir)
    kpis = spark.sql(_KPI, evidence=view(spark, sf_dir, "evidence")).join(timed.select("event_id", F.col("company_id").alias("c"), F.col("event_time").alias("t")), "event_id")
    kpis = kpis.withColumn("company_id", F.coalesce("other", "c")).withColumn("recorded_at", F.expr("t + INTERVAL '1' HOUR * (l_partkey % 7 - 4)")).drop("c", "t")
    return pit.kpi_rules(kpis, timed)


_TIMES = "shipped + INTERVAL '1' HOUR * (l_partkey % 5) AS published_at, shipped + INTERVAL '1' HOUR * (l_suppkey % 6) AS observed_at, shipped + INTERVAL '1' HOUR * 5 AS recorded_at"
_CONTEXT = """ctx AS (SELECT 'earnings_event' AS t, event_id AS i, event_id, CAST(NULL AS TIMESTAMP) AS as_of FROM event UNION ALL SELECT 'pre_note', event_id, event_id, NULL FROM event UNION ALL SELECT 'pre_earnings_baseline', baseline_id, event_id, as_of FROM baseline),
 j AS (SELECT e.*, event_time, coalesce(ctx.as_of, event_time) AS cutoff, used_for_score AND (entity_type LIKE 'pre\\_%' ESCAPE '\\') AS pre FROM ev e LEFT JOIN (ctx JOIN timed ON ctx.event_id = timed.event_id) ON entity_type = ctx.t AND entity_id = ctx.i)"""


@query(f"WITH {_TIMED}, ev AS (SELECT *, {_TIMES} FROM evidence), {_CONTEXT} " + rules_sql("evidence", "j", [("entity_id", "no_event", "pre AND event_time IS NULL")]
       + [(c, "after_cutoff", f"pre AND {c} > cutoff") for c in ("published_at", "observed_at", "recorded_at")] + [("recorded_at", "not_before_event", "pre AND recorded_at >= event_time"), ("component", "post_event_component", "pre AND event_time IS NOT NULL AND component = 'actual_result'")]), "event", "status", "baseline", "evidence")
def evidence_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, baseline = view(spark, sf_dir, "event"), view(spark, sf_dir, "baseline")
    plain = event.select(F.col("event_id").alias("entity_id"), "event_id", F.lit(None).alias("as_of"))
    contexts = {"earnings_event": plain, "pre_note": plain, "pre_earnings_baseline": baseline.select(F.col("baseline_id").alias("entity_id"), "event_id", "as_of")}
    evidence = view(spark, sf_dir, "evidence").selectExpr("*", *_TIMES.split(", "))
    return pit.evidence_cutoffs(pit.evidence_context(evidence, contexts, _timed(spark, sf_dir)), ("actual_result",))


@query(f"WITH ev AS (SELECT *, {_TIMES} FROM evidence) " + rules_sql("evidence", "ev", [("published_at", "after_observed", "published_at > observed_at"), ("observed_at", "after_recorded", "observed_at > recorded_at")]), "evidence")
def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.evidence_order(view(spark, sf_dir, "evidence").selectExpr("*", *_TIMES.split(", ")))


_SOME = "coalesce(storage_status, licence_status, hash_status, location, content_hash) IS NOT NULL"
_NEEDS = "hash_status IN ('verified', 'recorded_unverified', 'mismatch')"


@query(rules_sql("evidence", "evidence", [(c, "incomplete_metadata", f"{_SOME} AND {c} IS NULL") for c in ("storage_status", "licence_status", "hash_status")] + [
    ("location", "stored_without_location", "storage_status = 'stored' AND location IS NULL"), ("licence_status", "stored_without_licence", "storage_status = 'stored' AND licence_status IS DISTINCT FROM 'permitted'"),
    ("location", "location_without_storage", "location IS NOT NULL AND storage_status IS DISTINCT FROM 'stored'"), ("content_hash", "hash_missing", f"{_NEEDS} AND content_hash IS NULL"),
    ("content_hash", "hash_form", f"{_NEEDS} AND NOT regexp_full_match(content_hash, '[0-9a-fA-F]{{64}}')"), ("content_hash", "hash_unexpected", "hash_status IN ('not_recorded', 'not_applicable') AND content_hash IS NOT NULL"),
    ("hash_status", "hash_mismatch", "hash_status = 'mismatch'")]), "evidence")
def evidence_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.evidence_metadata(view(spark, sf_dir, "evidence"))


_ALL3 = "entry_price IS NOT NULL AND stop_price IS NOT NULL AND target_price IS NOT NULL"


@query(rules_sql("post_earnings_review", "review", [("decision", "prices_without_trade", "decision = 'NO_TRADE' AND coalesce(entry_price, stop_price, target_price) IS NOT NULL"), ("entry_price", "missing_price", f"decision <> 'NO_TRADE' AND NOT ({_ALL3})"),
    ("entry_price", "long_order", f"decision = 'LONG' AND {_ALL3} AND NOT (stop_price < entry_price AND entry_price < target_price)"), ("entry_price", "short_order", f"decision = 'SHORT' AND {_ALL3} AND NOT (target_price < entry_price AND entry_price < stop_price)")]), "event", "review")
def trade_price_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.trade_prices(view(spark, sf_dir, "review"))


@query("""SELECT 'post_earnings_review' AS "table", row_number, concat_ws(',', CASE WHEN price_before IS NULL THEN 'price_before' END, CASE WHEN price_after IS NULL THEN 'price_after' END, CASE WHEN price_source IS NULL THEN 'price_source' END) AS missing
  FROM review WHERE coalesce(return_1d, return_5d) IS NOT NULL AND (price_before IS NULL OR price_after IS NULL OR price_source IS NULL)""", "event", "review")  # fmt: skip
def return_reference_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.return_references(view(spark, sf_dir, "review"), ["return_1d", "return_5d"], ["price_before", "price_after", "price_source"])


@query(f"WITH {_CURRENT}, req AS (SELECT event_id FROM review UNION SELECT event_id FROM baseline WHERE v = 2 UNION SELECT event_id FROM event WHERE o_totalprice > 400000) SELECT event_id FROM req WHERE event_id NOT IN (SELECT event_id FROM cur)", "event", "status", "baseline", "review")
def lifecycle_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = [view(spark, sf_dir, "review"), view(spark, sf_dir, "baseline").filter("v = 2"), view(spark, sf_dir, "event").filter("o_totalprice > 400000")]
    return pit.without_status(pit.lifecycle_required(triggers), view(spark, sf_dir, "status"))


@query(f"WITH {_CURRENT}, req AS (SELECT event_id FROM baseline UNION SELECT event_id FROM event WHERE o_totalprice > 400000), j AS (SELECT r.*, coalesce(cur.status, '') AS status, cur.recorded_at AS confirmed_at, baseline_status FROM review r JOIN req ON r.event_id = req.event_id LEFT JOIN cur ON r.event_id = cur.event_id LEFT JOIN baseline b ON r.baseline_id = b.baseline_id) "
       + rules_sql("post_earnings_review", "j", [("event_id", "event_cancelled", "status = 'cancelled'"), ("event_id", "not_occurred", "status NOT IN ('occurred', 'cancelled')"), ("event_id", "return_without_occurrence", "status <> 'occurred' AND (return_1d IS NOT NULL OR return_5d IS NOT NULL)"),
           ("baseline_id", "baseline_not_locked", "status = 'occurred' AND baseline_status <> 'locked'"), ("recorded_at", "before_confirmation", "status = 'occurred' AND recorded_at < confirmed_at")]), "event", "status", "baseline", "review")
def lifecycle_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = pit.lifecycle_required([view(spark, sf_dir, "baseline"), view(spark, sf_dir, "event").filter("o_totalprice > 400000")])
    return pit.review_gate(view(spark, sf_dir, "review"), view(spark, sf_dir, "status"), view(spark, sf_dir, "baseline"), required, ("return_1d", "return_5d"))


# ---- lineage


@query(f"WITH {_CURRENT} SELECT event_id, status_id, status FROM cur", "event", "status")
def current_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.current(view(spark, sf_dir, "status"), "event_id", "status_id", "supersedes").select("event_id", "status_id", "status")


@query(f"WITH {_CURRENT} SELECT event_id, count(*) AS n_tails FROM tails GROUP BY 1 HAVING count(*) <> 1", "event", "status")
def multi_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.tail_counts(view(spark, sf_dir, "status"), "event_id", "status_id", "supersedes")


_PARENT = "p AS (SELECT s.*, t.row_number AS pr, t.event_id AS pe, t.status AS ps, t.recorded_at AS prec, t.scheduled_at AS psch FROM status s LEFT JOIN status t ON s.supersedes = t.status_id)"


@query(f"WITH {_PARENT}, o AS (SELECT * FROM p WHERE supersedes IS NOT NULL AND supersedes <> status_id) SELECT 'event_status_history' AS \"table\", row_number, 'supersedes' AS \"column\", 'supersedes_itself' AS code FROM p WHERE supersedes = status_id UNION ALL SELECT 'event_status_history', row_number, 'supersedes', 'missing_parent' FROM o WHERE pr IS NULL UNION ALL SELECT 'event_status_history', row_number, 'supersedes', 'later_parent' FROM o WHERE pr >= row_number UNION ALL SELECT 'event_status_history', row_number, 'supersedes', 'other_key' FROM o WHERE pe <> event_id", "event", "status")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.check_lineage(view(spark, sf_dir, "status"), "event_status_history", "event_id", "status_id", "supersedes")


@query(f"WITH {_PARENT}, w AS (SELECT *, lag(status_id) OVER (PARTITION BY event_id ORDER BY row_number) AS last FROM p WHERE supersedes IS NULL OR (pr IS NOT NULL AND supersedes <> status_id)) " + rules_sql("event_status_history", "w", [("supersedes", "not_current", "supersedes IS NOT NULL AND last IS DISTINCT FROM supersedes")]), "event", "status")
def lineage_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.branches(view(spark, sf_dir, "status"), "event_status_history", "event_id", "status_id", "supersedes")


# Which status may follow which.
TRANSITIONS = {"scheduled": ("postponed", "occurred", "cancelled"), "postponed": ("postponed", "occurred", "cancelled")}


@query(f"WITH {_PARENT} " + rules_sql("event_status_history", "p", [("status", "transition", "ps IS NOT NULL AND NOT (ps IN ('scheduled', 'postponed') AND status IN ('postponed', 'occurred', 'cancelled'))")]), "event", "status")
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.bad_transitions(view(spark, sf_dir, "status"), "event_status_history", "status_id", "supersedes", "status", TRANSITIONS)


@query(f"WITH {_PARENT} " + rules_sql("event_status_history", "p", [("occurred_at", "occurred_without_time", "status = 'occurred' AND occurred_at IS NULL"), ("occurred_at", "time_without_occurrence", "status <> 'occurred' AND occurred_at IS NOT NULL"),
    ("recorded_at", "not_later", "recorded_at <= prec"), ("scheduled_at", "postponed_earlier", "status = 'postponed' AND scheduled_at <= psch"), ("scheduled_at", "terminal_moves_schedule", "status IN ('occurred', 'cancelled') AND scheduled_at <> psch")]), "event", "status")
def status_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage.with_parent(view(spark, sf_dir, "status"), "status_id", "supersedes", ["recorded_at", "scheduled_at"])
    st = F.col("status")
    return check(rows, "event_status_history", [("occurred_at", "occurred_without_time", (st == "occurred") & F.col("occurred_at").isNull()), ("occurred_at", "time_without_occurrence", (st != "occurred") & F.col("occurred_at").isNotNull()),
        ("recorded_at", "not_later", F.col("recorded_at") <= F.col("parent_recorded_at")), ("scheduled_at", "postponed_earlier", (st == "postponed") & (F.col("scheduled_at") <= F.col("parent_scheduled_at"))),
        ("scheduled_at", "terminal_moves_schedule", st.isin("occurred", "cancelled") & (F.col("scheduled_at") != F.col("parent_scheduled_at")))])


@query("""WITH w AS (SELECT *, CASE WHEN regexp_full_match(version, 'v[1-9][0-9]*') THEN CAST(substr(version, 2) AS BIGINT) END AS vn FROM baseline),
  x AS (SELECT *, max(vn) OVER (PARTITION BY event_id ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM w) """ + rules_sql("pre_earnings_baseline", "x", [("version", "version_form", "vn IS NULL"), ("version", "version_order", "vn <= most")]), "event", "baseline")  # fmt: skip
def baseline_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.version_issues(view(spark, sf_dir, "baseline"), "pre_earnings_baseline", "event_id", "version")


@query("WITH ec AS (SELECT entity_id, count(*) AS n, max(CAST(used_for_score AS INT)) AS used FROM evidence WHERE entity_type = 'pre_earnings_baseline' GROUP BY 1), j AS (SELECT b.*, n, used FROM baseline b LEFT JOIN ec ON baseline_id = entity_id WHERE baseline_status = 'locked') "
       + rules_sql("pre_earnings_baseline", "baseline", [("review_status", "locked_unapproved", "baseline_status = 'locked' AND review_status <> 'approved'"), ("supersedes", "draft_supersedes", "baseline_status = 'draft' AND supersedes IS NOT NULL"),
           ("supersedes", "must_supersede", "baseline_status = 'locked' AND v > 1 AND supersedes IS NULL"), ("as_of", "after_lock", "baseline_status = 'locked' AND as_of > locked_at"), ("recorded_at", "after_lock", "baseline_status = 'locked' AND recorded_at > locked_at")])
       + " UNION ALL " + rules_sql("pre_earnings_baseline", "j", [("baseline_id", "no_evidence", "n IS NULL"), ("baseline_id", "no_score_evidence", "used = 0")]), "event", "baseline", "evidence")
def baseline_lock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    baselines = view(spark, sf_dir, "baseline")
    return report([pit.lock_state(baselines), pit.baseline_evidence(baselines, view(spark, sf_dir, "evidence"))])


@query("WITH h AS (SELECT *, md5(CAST(consensus_revenue AS STRING)) AS hash, k // 2 AS ev FROM baseline WHERE baseline_status = 'locked'), w AS (SELECT *, lag(hash) OVER (PARTITION BY ev, version ORDER BY row_number) AS last FROM h) "
       + rules_sql("pre_earnings_baseline", "w", [("hash", "modified_in_place", "last <> hash")]), "event", "baseline")
def locked_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "baseline").filter("baseline_status = 'locked'").withColumn("hash", F.md5(F.col("consensus_revenue").cast("string"))).withColumn("ev", F.floor(F.col("k") / 2))
    return lineage.modified_in_place(rows, "pre_earnings_baseline", ["ev", "version"], "hash")
