"""Registered queries of the gates between stages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import gates, observe, review
from ..sources.tables import dealt
from .monitor_rules import _TARGET
from .validation import rules_sql
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, with_views(sql, *views) if views else sql
        return f

    return add


_RELEASE = """SELECT row_number, CASE WHEN k % 61 = 0 THEN 'EVT-none' ELSE event_id END AS event_id, CASE WHEN k % 17 = 0 THEN '0000x' ELSE lpad(CAST(o_custkey AS STRING), 4, '0') END AS ticker,
  CASE q WHEN 1 THEN 'q1' WHEN 2 THEN CASE WHEN k % 5 = 0 THEN 'q2' ELSE 'half_year' END WHEN 3 THEN 'q3' ELSE 'full_year' END AS scope, announced_on + INTERVAL '1' DAY * (k % 9 - 7) AS locked_at FROM {event}"""


@query("WITH r AS (" + _RELEASE.format(event="event") + "), j AS (SELECT r.*, e.announced_on, c.ticker AS ct, CASE e.q WHEN 1 THEN 'q1' WHEN 2 THEN 'half_year' WHEN 3 THEN 'q3' ELSE 'full_year' END AS es FROM r LEFT JOIN event e ON r.event_id = e.event_id LEFT JOIN company c ON e.company_id = c.company_id) "
       + rules_sql("release", "j", [("event_id", "missing_event", "announced_on IS NULL"), ("ticker", "other_ticker", "ticker <> ct"), ("scope", "other_period", "scope <> es AND announced_on IS NOT NULL"), ("locked_at", "locked_after_announcement", "CAST(locked_at AS DATE) > CAST(announced_on AS DATE)")]), "company", "event")
def evaluation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "event")
    return gates.evaluation_context(spark.sql(_RELEASE, event=events), events, view(spark, sf_dir, "company"))


@query("WITH t AS (" + _TARGET.format(orders="orders") + ") " + rules_sql("monitor_target", "t", [("enabled", "disabled", "NOT enabled"), ("automation_level", "not_level_2", "automation_level <> 'level_2'"), ("terms_status", "terms_not_reviewed", "terms_status <> 'candidate_specific_review_completed'"), ("active_from", "outside_window", "TIMESTAMP '1998-01-01 00:00:00' < active_from OR TIMESTAMP '1998-01-01 00:00:00' > active_until")]))
def operational_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.operational(spark.sql(_TARGET, orders=view(spark, sf_dir, "orders")), F.expr("TIMESTAMP '1998-01-01 00:00:00'"))


_CHAIN = """SELECT DISTINCT row_number, k, n, evidence_id, CASE WHEN n > 1 AND k % 3 = 0 THEN 'correction' WHEN k % 29 = 0 THEN 'retraction_notice' ELSE 'original' END AS status,
  CASE WHEN n > 1 AND k % 3 = 0 AND k % 7 > 0 THEN 'EV-' || CAST(k AS STRING) || '-' || CAST(n - 1 AS STRING) WHEN k % 31 = 0 THEN 'EV-none' END AS supersedes, 'event' AS entity_type, CAST(CASE WHEN k % 37 = 0 THEN n ELSE 0 END AS STRING) AS entity_id FROM {evidence}"""


@query("WITH e AS (" + _CHAIN.format(evidence="evidence") + "), j AS (SELECT e.*, p.evidence_id AS pid, p.entity_id AS pe FROM e LEFT JOIN e p ON e.supersedes = p.evidence_id) " + rules_sql("evidence", "j", [("supersedes", "successor_without_parent", "status IN ('correction', 'retraction_notice') AND supersedes IS NULL"), ("supersedes", "original_with_parent", "status = 'original' AND supersedes IS NOT NULL"), ("supersedes", "missing_parent", "supersedes IS NOT NULL AND pid IS NULL"), ("entity_id", "other_entity", "pe <> entity_id")]), "evidence")
def evidence_status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt first: whole rows hardly repeat, so that what is distinct in each file's part would all be held at once.
    return gates.evidence_status(spark.sql(_CHAIN, evidence=dealt(view(spark, sf_dir, "evidence"), "row_number")))


_BUNDLE = """SELECT row_number, CASE WHEN k % 43 = 0 THEN -1 ELSE k END AS evaluation_id, CASE WHEN k % 19 = 0 THEN 'EVT-x' ELSE event_id END AS event_id, CASE WHEN k % 23 = 0 THEN 'CMP-x' ELSE company_id END AS company_id, scheduled_at + INTERVAL '1' HOUR * (k % 11 - 2) AS observed_at FROM {event}"""


@query("WITH b AS (" + _BUNDLE.format(event="event") + "), j AS (SELECT b.*, e.event_id AS ee, e.company_id AS ec, e.scheduled_at AS ea FROM b LEFT JOIN event e ON b.evaluation_id = e.k) " + rules_sql("bundle", "j", [("evaluation_id", "missing_evaluation", "ee IS NULL"), ("event_id", "other_event", "event_id <> ee"), ("company_id", "other_company", "company_id <> ec"), ("observed_at", "before_evaluation", "observed_at < ea")]), "event")
def bundle_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "event")
    evaluations = events.select(F.col("k").alias("evaluation_id"), "event_id", "company_id", F.col("scheduled_at").alias("evaluated_at"))
    return gates.bundle_identity(spark.sql(_BUNDLE, event=events), evaluations)


_CARRY = "SELECT o_orderkey AS row_number, o_orderkey - o_orderkey % 50 % 2 AS review_id, o_custkey % 400 AS group_id, o_custkey % 800 AS company_id, CAST(o_orderdate AS TIMESTAMP) AS reviewed_at FROM {orders}"


@query("WITH r AS (" + _CARRY.format(orders="orders") + "), n AS (SELECT review_id, count(*) AS n FROM r GROUP BY 1), g AS (SELECT group_id, count(DISTINCT company_id) AS cs FROM r GROUP BY 1), j AS (SELECT * FROM r JOIN n USING (review_id) JOIN g USING (group_id)) " + rules_sql("review", "j", [("review_id", "repeated_review", "n > 1"), ("company_id", "several_companies", "cs > 1"), ("reviewed_at", "from_later", "reviewed_at > TIMESTAMP '2001-01-01 00:00:00'")]))
def carryover_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.carryover_gates(spark.sql(_CARRY, orders=view(spark, sf_dir, "orders")), F.expr("TIMESTAMP '2001-01-01 00:00:00'"))


@query("""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS ls FROM pages), l AS (SELECT page_id, unnest(hs) AS h, unnest(ls) AS t FROM a),
  k AS (SELECT page_id, CASE WHEN regexp_matches(lower(t), 'ing|tion') THEN 'release' WHEN regexp_matches(lower(t), 'the|de') THEN 'material' END AS kind FROM l)
  SELECT page_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def page_document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit(r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>')
    links = view(spark, sf_dir, "pages").select("page_id", F.explode(F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("h"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))).alias("a"))
    kind = text.classify_document(F.col("a.t"), F.concat(F.lit("https://a.example/"), F.col("a.h")), {"release": ("ing", "tion"), "material": ("the", "de")}, suffix="")
    return links.select("page_id", kind.alias("kind")).filter("kind is not null").groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT page_id, regexp_replace(html, '(?s)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<!--.*?-->', '', 'g') AS b FROM pages), s AS (SELECT page_id, list_filter(list_transform(string_split_regex(b, '<[^>]*>'), lambda x: trim(x)), lambda x: x <> '') AS a FROM v),
  n AS (SELECT page_id, unnest(a) AS node, generate_subscripts(a, 1) AS pos FROM s), f AS (SELECT *, lead(node) OVER (PARTITION BY page_id ORDER BY pos) AS following, nullif(regexp_extract(node, '([0-9]+)', 1), '') AS day FROM n),
  r AS (SELECT page_id, day, CASE WHEN trim(regexp_replace(node, '[0-9]+', '', 'g')) <> '' THEN trim(regexp_replace(node, '[0-9]+', '', 'g')) ELSE following END AS label, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM f WHERE day IS NOT NULL) SELECT page_id, day, md5(label) AS label_md5, n, count(*) OVER (PARTITION BY page_id) <= 12 AS plausible FROM r""")  # fmt: skip
def page_schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.schedule_rows(view(spark, sf_dir, "pages"), date="[0-9]+").select("page_id", "day", F.md5("label").alias("label_md5"), "n", "plausible")
