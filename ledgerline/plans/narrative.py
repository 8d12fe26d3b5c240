"""Registered queries: prose of releases and covers of sessions, planted by ids over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation, narrative, reaction
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


_N = "CAST({0} AS STRING)"
_PAGES = """SELECT doc_id, 1 AS page_no, concat('決算短信', chr(10), ' 直近に公表されている業績予想からの修正の有無', CASE WHEN doc_id % 3 = 0 THEN ':有' WHEN doc_id % 3 = 1 THEN '：無' ELSE ' 不明' END, chr(10), CASE WHEN doc_id % 4 = 0 THEN '直近に公表されている配当予想からの修正の有無有' ELSE '' END) AS text FROM {documents}
  UNION ALL SELECT doc_id, 2, concat('目次 各セグメントの経営成績', chr(10), '経営環境は古い値上げです。') FROM {documents}
  UNION ALL SELECT doc_id, 3, concat('各セグメントの経営成績', chr(10), CASE WHEN doc_id % 5 = 0 THEN '経営環境は厳しい。' ELSE '' END, ' 当期の経営環境は原材料高', chr(10), '騰が続いた。', CASE WHEN doc_id % 2 = 0 THEN '取引は堅調で売上が増えた！' ELSE '取引は売上が増えた！' END, '採用費などの費用が増えた。新規出店により増収。食品',
    CAST(doc_id % 7 AS STRING), '事業の売上高は', CASE WHEN doc_id % 3 = 0 THEN '1,' ELSE '' END, CAST(200 + doc_id % 90 AS STRING), '百万円となった。', CASE WHEN doc_id % 6 = 1 THEN '冷凍事業の売上高は5億円。' ELSE '' END, 'セグメント', CASE WHEN doc_id % 4 < 2 THEN '損失は△' WHEN doc_id % 4 = 2 THEN '損失は' ELSE '利益は' END, CAST(doc_id % 50 AS STRING), '.5千円。',
    CASE WHEN doc_id % 8 = 0 THEN '物流事業の売上高は▲30円、セグメント利益は−4円でした。' ELSE '' END) FROM {documents} WHERE doc_id % 11 <> 10
  UNION ALL SELECT doc_id, 4, concat('業績予想などの将来予測情報', chr(10), '業績は', CASE WHEN doc_id % 3 = 2 THEN '未定。' ELSE '順調です。' END, source) FROM {documents} WHERE doc_id % 13 <> 12"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAGES, documents=view(spark, sf_dir, "documents"))


_LINES = "array_to_string(list_filter(list_transform(string_split(translate({0}, '！？：', '!?:'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '')"
_YEN = "CAST(replace(regexp_replace({0}, '[△▲−]', '-'), ',', '') AS DOUBLE) * CASE {1} WHEN '百万円' THEN 1000000 WHEN '千円' THEN 1000 WHEN '億円' THEN 100000000 ELSE 1 END"


@query(f"""WITH p AS ({_PAGES.format(documents='documents')}), l AS (SELECT doc_id, {_LINES.format('text')} AS line FROM p WHERE page_no = 3), a AS (SELECT doc_id, regexp_extract_all(line, '{narrative.SEGMENT}') AS ms FROM l),
m AS (SELECT doc_id, unnest(ms) AS x, generate_subscripts(ms, 1) - 1 AS pos FROM a), g AS (SELECT doc_id, pos, {", ".join(f"regexp_extract(x, '{narrative.SEGMENT}', {i}) AS g{i}" for i in range(1, 7))} FROM m)
SELECT doc_id, pos::INT AS pos, g1 AS category, '売上高' AS name, {_YEN.format('g2', 'g3')} AS value FROM g UNION ALL SELECT doc_id, pos::INT, g1, 'セグメント' || g4, CASE WHEN g4 = '損失' THEN -abs({_YEN.format('g5', 'g6')}) ELSE {_YEN.format('g5', 'g6')} END FROM g""")
def segment_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.segment_figures(_pages(spark, sf_dir).filter("page_no = 3"))


def _rules_sql() -> str:
    each = []
    for n, (kind, subject, section, required, some, status) in enumerate(narrative.RULES):
        holds = " AND ".join(f"contains(s, '{t}')" for t in required) + " AND (" + " OR ".join(f"contains(s, '{t}')" for t in some) + ")"
        each.append(f"SELECT doc_id, {n} AS n, '{kind}' AS finding_type, '{subject}' AS subject, arg_min(trim(s), pos) AS statement, '{status}' AS status, any_value(page_no)::BIGINT AS page_no FROM se WHERE section = '{section}' AND {holds} GROUP BY 1")
    for n, (kind, subject, pattern) in enumerate(narrative.FLAGS, start=len(narrative.RULES)):
        each.append(f"SELECT doc_id, {n}, '{kind}', '{subject}', regexp_extract(line, '{pattern}', 0), CASE WHEN regexp_extract(line, '{pattern}', 1) = '有' THEN 'changed' ELSE 'unchanged' END, 1 FROM l JOIN ok USING (doc_id) WHERE page_no = 1 AND regexp_matches(line, '{pattern}')")
    return f"""WITH p AS ({_PAGES.format(documents='documents')}), l AS (SELECT doc_id, page_no, text, {_LINES.format('text')} AS line FROM p),
k AS (SELECT doc_id, m AS section, max(page_no) AS page_no FROM p, (VALUES ('{narrative.RESULTS_OF_SEGMENTS}'), ('{narrative.OUTLOOK}')) v(m) WHERE contains(text, m) GROUP BY 1, 2), ok AS (SELECT doc_id FROM k GROUP BY 1 HAVING count(*) = 2),
sp AS (SELECT doc_id, section, page_no, regexp_extract_all(line, '[^。！？]*[。！？]|[^。！？]+$') AS ss FROM k JOIN l USING (doc_id, page_no) JOIN ok USING (doc_id)), se AS (SELECT doc_id, section, page_no, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM sp)
""" + " UNION ALL ".join(each)


@query(_rules_sql())
def narrative_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.findings(_pages(spark, sf_dir))


@query(f"WITH p AS ({_PAGES.format(documents='documents')}) SELECT DISTINCT doc_id, m AS section FROM p, (VALUES ('{narrative.RESULTS_OF_SEGMENTS}'), ('{narrative.OUTLOOK}')) v(m) WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND contains(q.text, m))")
def narrative_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.missing_sections(_pages(spark, sf_dir))


_METRICS = """SELECT o_orderkey AS doc_id, metric, CAST(CASE metric WHEN 'revenue' THEN o_totalprice ELSE o_totalprice * (o_orderkey % 140 - 70) / 100 END AS DOUBLE) AS actual, CAST(o_totalprice * CASE WHEN o_orderkey % 17 = 3 THEN 0 ELSE 0.8 END AS DOUBLE) AS prior, CAST(o_totalprice * 4 AS DOUBLE) AS forecast,
  CAST(CASE metric WHEN 'revenue' THEN 25.0 + o_orderkey % 5 * 0.1 WHEN 'operating_profit' THEN (o_orderkey % 140 - 70) * 1.25 - 100 + o_orderkey % 3 * 0.2 END AS DOUBLE) AS reported_yoy, CASE WHEN o_orderkey % 19 = 4 THEN 'unknown' ELSE 'JPY' END AS actual_unit, CASE WHEN o_orderkey % 23 = 5 THEN NULL ELSE 'JPY' END AS prior_unit, 'JPY' AS forecast_unit
  FROM {orders}"""
_BOTH = " UNION ALL ".join(_METRICS.replace("metric,", f"'{m}' AS metric,", 1).replace("CASE metric", f"CASE '{m}'") for m in ("revenue", "operating_profit"))


@query(f"""WITH m AS ({_BOTH.format(orders='orders')}), c AS (SELECT *, coalesce(actual_unit = 'JPY' AND prior_unit = 'JPY', false) AS yen, round((actual / nullif(prior, 0) - 1) * 100, 1) AS g FROM m)
SELECT doc_id, metric, CASE WHEN yen THEN 'year_over_year_reconciliation' ELSE 'money_unit_presence' END AS check_type, CASE WHEN yen AND coalesce(round(abs(g - reported_yoy), 9) <= 0.3, false) THEN 'passed' ELSE 'review_required' END AS status FROM c
UNION ALL SELECT a.doc_id, 'operating_profit', 'operating_margin_sanity', CASE WHEN coalesce(b.actual / nullif(a.actual, 0) * 100 BETWEEN -50 AND 50, false) THEN 'passed' ELSE 'review_required' END FROM m a JOIN m b USING (doc_id) WHERE a.metric = 'revenue' AND b.metric = 'operating_profit' AND a.actual_unit = 'JPY' AND b.actual_unit = 'JPY'""")
def metric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.consistency_checks(spark.sql(_BOTH, orders=view(spark, sf_dir, "orders")))


# Bundles of announcements: dates as numbers of days, so that both engines build them alike.
_B = """SELECT announcement_id AS id, CAST(announced_at AS DATE) AS d, announcement_id % 13 AS m FROM {announcement}"""


@query(f"""WITH b AS ({_B.format(announcement='announcement')}), n AS (SELECT id, d, m, CASE isodow(d) WHEN 1 THEN d - 3 WHEN 7 THEN d - 2 ELSE d - 1 END AS pre, list_filter(list_transform(range(1, 10), lambda k: d + k::INT), lambda x: isodow(x) < 6)[1:5] AS nx FROM b),
f AS (SELECT *, CASE m WHEN 1 THEN list_reverse(nx) WHEN 2 THEN [d] || nx[1:4] ELSE nx END AS nd FROM n),
need AS (SELECT DISTINCT id, unnest([pre, d] || nd) AS day FROM f),
s AS (SELECT id, m, unnest([pre, d] || nx) AS day, generate_subscripts([pre, d] || nx, 1) AS pos FROM f),
s2 AS (SELECT id, m, pos, CASE WHEN m = 4 AND pos = 7 THEN day + 1 ELSE day END AS day FROM s WHERE NOT (m = 3 AND pos = 3)),
sx AS (SELECT *, lag(day) OVER (PARTITION BY id ORDER BY CASE WHEN m = 5 THEN -pos ELSE pos END) AS last FROM s2)
SELECT bundle_id, day::VARCHAR AS day, code FROM (SELECT id AS bundle_id, NULL::DATE AS day, 'announcement_zone' AS code FROM f WHERE m = 6 UNION ALL SELECT id, NULL, 'next_dates_order' FROM f WHERE m = 1 UNION ALL SELECT id, NULL, 'next_date_not_after' FROM f WHERE m = 2
UNION ALL SELECT id, day, 'weekend' FROM s2 WHERE isodow(day) > 5 UNION ALL SELECT id, day, 'session_zone' FROM s2 WHERE m = 7 UNION ALL SELECT id, day, 'other_date' FROM s2 WHERE m = 8 UNION ALL SELECT id, day, 'not_before_close' FROM s2 WHERE m = 9
UNION ALL SELECT id, day, 'not_ascending' FROM sx WHERE day <= last UNION ALL SELECT id, day, 'missing_session' FROM need WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.id = need.id AND s2.day = need.day)
UNION ALL SELECT DISTINCT id, day, 'surplus_session' FROM s2 WHERE NOT EXISTS (SELECT 1 FROM need WHERE s2.id = need.id AND s2.day = need.day))""", "announcement")
def session_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.sql(_B, announcement=view(spark, sf_dir, "announcement"))
    n = b.select("id", "d", "m", F.expr("date_add(d, CASE dayofweek(d) WHEN 2 THEN -3 WHEN 1 THEN -2 ELSE -1 END)").alias("pre"), F.expr("slice(filter(sequence(date_add(d, 1), date_add(d, 9)), x -> weekday(x) < 5), 1, 5)").alias("nx"))
    bundles = n.select(F.col("id").alias("bundle_id"), F.expr("concat(CAST(d AS STRING), 'T15:00:00', CASE WHEN m = 6 THEN '+00:00' ELSE '+09:00' END)").alias("announced_at"), F.col("pre").alias("pre_event_close_date"), F.expr("CASE m WHEN 1 THEN reverse(nx) WHEN 2 THEN concat(array(d), slice(nx, 1, 4)) ELSE nx END").alias("next_dates"))
    s = n.select("id", "m", F.posexplode(F.concat(F.array("pre", "d"), "nx")).alias("pos", "day")).filter("NOT (m = 3 AND pos = 2)").withColumn("day", F.expr("CASE WHEN m = 4 AND pos = 6 THEN date_add(day, 1) ELSE day END"))
    clock = lambda day, hour: F.concat(day.cast("string"), F.lit("T"), hour, F.expr("CASE WHEN m = 7 THEN '+08:00' ELSE '+09:00' END"))
    sessions = s.select(F.col("id").alias("bundle_id"), F.expr("CASE WHEN m = 5 THEN -pos ELSE pos END").alias("pos"), F.col("day").alias("trading_date"), clock(F.expr("CASE WHEN m = 8 THEN date_add(day, -1) ELSE day END"), F.lit("09:00:00")).alias("open_at"), clock(F.col("day"), F.expr("CASE WHEN m = 9 THEN '09:00:00' ELSE '15:30:00' END")).alias("close_at"))
    return reaction.session_cover(bundles, sessions).withColumn("day", F.col("day").cast("string"))


# ---- evaluations: metrics of each event's first baseline against its results, with units, scopes and repeated figures planted.
_EXPECTED = """SELECT k AS event_id, 0 AS pos, 'revenue' AS metric, 'JPY' AS unit, CAST(consensus_revenue AS DOUBLE) AS consensus, CAST(guidance_revenue AS DOUBLE) AS guidance FROM {baseline} WHERE v = 1
  UNION ALL SELECT k, 1, 'profit', 'JPY', CASE WHEN k % 3 <> 0 THEN CAST(consensus_revenue AS DOUBLE) / 2 END, CAST(guidance_revenue AS DOUBLE) / 2 FROM {baseline} WHERE v = 1"""
_REPORTED = """SELECT k AS event_id, 'revenue' AS metric, 'actual' AS kind, 0 AS pos, CAST(revenue AS DOUBLE) AS value, CASE WHEN k % 11 = 1 THEN 'unknown' ELSE 'JPY' END AS unit, CASE WHEN k % 7 = 2 THEN 'q1' ELSE 'full_year' END AS scope FROM {actual} WHERE k % 13 <> 4
  UNION ALL SELECT k, 'profit', 'actual', 1, CAST(profit AS DOUBLE), 'JPY', 'full_year' FROM {actual} UNION ALL SELECT k, 'profit', 'actual', 0, 1.0, 'unknown', 'q1' FROM {actual}
  UNION ALL SELECT k, 'revenue', 'forecast', 2, CAST(revenue AS DOUBLE) * 1.05, 'JPY', CASE WHEN k % 5 = 3 THEN 'half_year' ELSE 'full_year' END FROM {actual} WHERE k % 2 = 0 AND k % 13 <> 4
  UNION ALL SELECT k, 'profit', 'forecast', 3, CAST(profit AS DOUBLE), CASE WHEN k % 9 = 5 THEN 'unknown' ELSE 'JPY' END, 'full_year' FROM {actual} WHERE k % 4 = 1"""
_EVENTS = "SELECT k AS event_id, baseline_id, concat('DA-', CAST(k AS STRING)) AS analysis_id, 'full_year' AS expected_scope FROM {baseline} WHERE v = 1"


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    baseline, actual = view(spark, sf_dir, "baseline"), view(spark, sf_dir, "actual")
    events = spark.sql(_EVENTS, baseline=baseline)
    return events, evaluation.metric_rows(events, spark.sql(_EXPECTED, baseline=baseline), spark.sql(_REPORTED, actual=actual))


_WITHIN = "CASE WHEN {e} = 0 OR abs(({a} - {e}) / abs({e}) * 100) <= 1 THEN '{same}' WHEN {a} > {e} THEN '{up}' ELSE '{down}' END"
_METRICS_SQL = f"""WITH e AS ({_EXPECTED.format(baseline='baseline')}), p AS ({_REPORTED.format(actual='actual')}), l AS (SELECT event_id, metric, kind, arg_max(struct_pack(value := value, unit := unit, scope := scope), pos) AS x FROM p GROUP BY 1, 2, 3),
j AS (SELECT e.*, a.x.value AS av, a.x.unit AS au, a.x.scope AS asc_, f.x.value AS fv, f.x.unit AS fu, f.x.scope AS fs FROM e LEFT JOIN l a ON a.event_id = e.event_id AND a.metric = e.metric AND a.kind = 'actual' LEFT JOIN l f ON f.event_id = e.event_id AND f.metric = e.metric AND f.kind = 'forecast'),
w AS (SELECT *, CASE WHEN au = 'JPY' THEN av END AS act, CASE WHEN fu = 'JPY' AND fs = 'full_year' THEN fv END AS fc FROM j),
mr AS (SELECT event_id, pos, metric, CASE WHEN asc_ = 'full_year' AND consensus <> 0 THEN (act - consensus) / abs(consensus) * 100 END AS difference_pct, CASE WHEN asc_ = 'full_year' AND act IS NOT NULL AND consensus IS NOT NULL THEN {_WITHIN.format(a='act', e='consensus', same='in_line', up='above', down='below')} END AS result,
  CASE WHEN guidance <> 0 THEN (fc - guidance) / abs(guidance) * 100 END AS revision_pct, CASE WHEN fc IS NOT NULL THEN {_WITHIN.format(a='fc', e='guidance', same='unchanged', up='up', down='down')} END AS revision, CASE WHEN fc <> 0 THEN act / abs(fc) * 100 END AS progress_pct,
  list_filter([CASE WHEN au <> 'JPY' THEN metric || ':actual_unit' END, CASE WHEN act IS NOT NULL AND consensus IS NOT NULL AND asc_ <> 'full_year' THEN metric || ':period' END, CASE WHEN fv IS NOT NULL AND fc IS NULL THEN metric || ':forecast' END], lambda x: x IS NOT NULL) AS lims FROM w)"""


@query(f"{_METRICS_SQL} SELECT event_id, pos, metric, difference_pct, result, revision_pct, revision, progress_pct, array_to_string(lims, ',') AS limitations FROM mr", "event", "baseline", "actual")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1].withColumn("limitations", F.array_join("limitations", ","))


@query(f"""{_METRICS_SQL}, vt AS (SELECT event_id, 'market_expectation' AS d, CASE result WHEN 'above' THEN 1 WHEN 'below' THEN -1 ELSE 0 END AS v FROM mr WHERE result IS NOT NULL UNION ALL SELECT event_id, 'company_guidance', CASE revision WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END FROM mr WHERE revision IS NOT NULL),
ds AS (SELECT event_id, d, sign(sum(v))::INT AS s FROM vt GROUP BY 1, 2), dd AS (SELECT event_id, sum(s) AS t, max(abs(s)) AS m, string_agg(d || '=' || s, ',' ORDER BY d) AS dims FROM ds GROUP BY 1),
c AS (SELECT event_id, count(result) AS n_comparisons, count(revision) AS n_guidance, count(progress_pct) AS n_progress, array_to_string(flatten(list(lims ORDER BY pos)), ',') AS limitations FROM mr GROUP BY 1), ee AS ({_EVENTS.format(baseline='baseline')}),
o AS (SELECT ee.*, n_comparisons, n_guidance, n_progress, limitations, coalesce(dims, '') AS dimensions, CASE WHEN t IS NULL THEN 'inconclusive' WHEN t > 0 THEN 'positive' WHEN t < 0 THEN 'negative' WHEN m > 0 THEN 'mixed' ELSE 'in_line' END AS overall FROM ee JOIN c USING (event_id) LEFT JOIN dd USING (event_id))
SELECT event_id, 'EE-' || left(sha256(baseline_id || '|' || analysis_id), 16) AS evaluation_id, n_comparisons, n_guidance, n_progress, dimensions, overall, CASE overall WHEN 'inconclusive' THEN 'insufficient_data' ELSE 'evaluated' END AS status, limitations, CASE overall WHEN 'inconclusive' THEN 'evaluation_not_available' ELSE 'ready_for_market_reaction_tracking' END AS next_stage FROM o""", "event", "baseline", "actual")
def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.evaluations(*_evaluated(spark, sf_dir))
    return out.withColumns({"limitations": F.array_join("limitations", ","), "dimensions": F.array_join(F.transform("dimensions", lambda d: F.concat(d["dimension"], F.lit("="), d["sign"].cast("string"))), ",")})
