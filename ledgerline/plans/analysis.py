"""Registered queries: documents, evaluation, market reaction, review and carry-over, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import documents as docs, evaluation as ev, reaction, review
from ..sources.tables import new_folder
from ..streaming import monitor_stream
from . import records
from .validation import rules_sql
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "", *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


# ---- documents

_LINES = "ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), lines AS (SELECT doc_id, pos, trim(raw) AS line FROM ls WHERE trim(raw) <> '')"
_RELEASE = """SELECT l_orderkey AS doc_id, concat('Report', chr(10), 'Revenue', chr(10), CAST(CAST(max(l_extendedprice) AS DECIMAL(18, 2)) AS STRING), chr(10), '△', CAST(CAST(min(l_extendedprice) AS DECIMAL(18, 2)) AS STRING), chr(10),
  'note', chr(10), CASE WHEN l_orderkey % 5 = 0 THEN 'none' ELSE CAST(CAST(count(*) AS BIGINT) * 1000 AS STRING) END) AS text FROM {lineitem} GROUP BY l_orderkey"""


@query(f"WITH {_LINES} SELECT doc_id, pos::INT AS pos, md5(line) AS line_md5 FROM lines")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.lines(view(spark, sf_dir, "documents")).select("doc_id", "pos", F.md5("line").alias("line_md5"))


@query(f"WITH documents AS ({_RELEASE.format(lineitem='lineitem')}), {_LINES}, a AS (SELECT doc_id, min(pos) AS p0 FROM lines WHERE line = 'Revenue' GROUP BY 1), n AS (SELECT l.doc_id, l.pos, CASE WHEN line LIKE '△%' THEN -CAST(substr(line, 2) AS DOUBLE) ELSE try_cast(line AS DOUBLE) END AS v FROM lines l JOIN a ON a.doc_id = l.doc_id AND l.pos > p0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n WHERE v IS NOT NULL) SELECT doc_id, coalesce(max(CASE WHEN k = 1 THEN v END), 0) AS v1, coalesce(max(CASE WHEN k = 2 THEN v END), 0) AS v2, coalesce(max(CASE WHEN k = 3 THEN v END), 0) AS v3, count(CASE WHEN k <= 3 THEN 1 END) = 3 AS parseable FROM r GROUP BY 1")
def doc_numeric_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs.lines(spark.sql(_RELEASE, lineitem=view(spark, sf_dir, "lineitem")))
    out = docs.numeric_run(rows, docs.first_match(rows, "^Revenue$"), 3)
    return out.select("doc_id", *[F.coalesce(F.get("values", F.lit(i)), F.lit(0.0)).alias(f"v{i + 1}") for i in range(3)], "parseable")


@query("""SELECT doc_id, CASE WHEN (length(text) - length(replace(text, '%%%', ''))) / 3 >= 2 THEN '%%%' WHEN (length(text) - length(replace(text, '###', ''))) / 3 >= 2 THEN '###' WHEN (length(text) - length(replace(text, '!!', ''))) / 2 >= 2 THEN '!!' END AS unit FROM documents""")
def doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = {"%%%": 1.0, "###": 1000.0, "!!": 1000000.0}
    return view(spark, sf_dir, "documents").select("doc_id", docs.unit(F.col("text"), units).alias("unit"))


@query("""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.]*\\.|[^.]+$') AS a FROM documents), t AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS pos FROM s), u AS (SELECT doc_id, pos, trim(raw) AS sentence FROM t WHERE trim(raw) <> ''),
  r AS (SELECT doc_id, 'growth' AS rule, pos, sentence FROM u WHERE contains(sentence, 'the') AND (contains(sentence, 'tion') OR contains(sentence, 'ing')) UNION ALL SELECT doc_id, 'cost', pos, sentence FROM u WHERE contains(sentence, 'de') AND contains(sentence, 'la'))
  SELECT doc_id, rule, min(pos)::BIGINT AS pos, md5(arg_min(sentence, pos)) AS sentence_md5 FROM r GROUP BY 1, 2""")  # fmt: skip
def doc_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.sentence_rules(docs.sentences(view(spark, sf_dir, "documents"), ends="."), {"growth": (("the",), ("tion", "ing")), "cost": (("de", "la"), ())})
    return found.select("doc_id", "rule", "pos", F.md5("sentence").alias("sentence_md5"))


@query(f"WITH {_LINES} SELECT doc_id, max(pos)::INT AS page_no, md5(arg_max(line, pos)) AS page_md5 FROM lines WHERE contains(line, 'the ') GROUP BY 1")
def doc_last_marker_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs.lines(view(spark, sf_dir, "documents")).withColumnsRenamed({"pos": "page_no", "line": "text"})
    return docs.last_page_with(pages, "the ").select("doc_id", "page_no", F.md5("text").alias("page_md5"))


_YEARS = """SELECT o_custkey AS company, CAST(year(o_orderdate) AS BIGINT) AS fy, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2)) * (o_orderkey % 160 - 40)) AS DOUBLE) / 100 AS profit, count(*) AS n FROM {orders} GROUP BY o_custkey, year(o_orderdate)"""
_WIDE = "y AS (" + _YEARS.format(orders="orders") + "), w AS (SELECT a.company, a.fy, a.revenue AS actual, p.revenue AS prior, a.profit, a.n, round((a.revenue / p.revenue - 1) * 100, 2) AS yoy FROM y a LEFT JOIN y p ON a.company = p.company AND a.fy = p.fy + 1)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.sql(_YEARS, orders=view(spark, sf_dir, "orders"))
    actual = years.select("company", "fy", F.lit("actual").alias("value_kind"), F.col("revenue").alias("value"), "profit", "n")
    prior = years.select("company", (F.col("fy") + 1).alias("fy"), F.lit("prior").alias("value_kind"), F.col("revenue").alias("value"))
    pivoted = docs.by_kind(actual.drop("profit", "n").unionByName(prior), ["company", "fy"], ["actual", "prior"]).filter("actual is not null")
    return pivoted.join(years.select("company", "fy", "profit", "n"), ["company", "fy"])


@query(f"WITH {_WIDE} SELECT company, fy, yoy FROM w")
def derived_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.derived_yoy(_wide(spark, sf_dir)).select("company", "fy", "yoy")


@query(f"WITH {_WIDE} SELECT company, fy, round(actual / (prior * 1.1) * 100, 2) AS progress FROM w")
def derived_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.derived_progress(_wide(spark, sf_dir).withColumn("forecast", F.col("prior") * F.lit(1.1))).select("company", "fy", "progress")


@query(f"WITH {_WIDE} SELECT company, fy, concat_ws(',', CASE WHEN abs(yoy + CASE WHEN fy % 3 = 0 THEN 0.5 ELSE 0.1 END - yoy) > 0.3 THEN 'yoy_differs' END, CASE WHEN n % 5 = 0 THEN 'unit_missing' END, CASE WHEN abs(profit / actual * 100) > 50 THEN 'margin_out_of_range' END) AS failed FROM w")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs.derived_yoy(_wide(spark, sf_dir)).withColumn("reported_yoy", F.expr("yoy + CASE WHEN fy % 3 = 0 THEN 0.5D ELSE 0.1D END")).withColumn("unit", F.expr("CASE WHEN n % 5 <> 0 THEN 'yen' END"))
    return docs.consistency(rows).select("company", "fy", F.concat_ws(",", "failed").alias("failed"))


# ---- evaluation

_PCT = "(CAST(guidance_revenue AS DOUBLE) - CAST(consensus_revenue AS DOUBLE)) / abs(CAST(consensus_revenue AS DOUBLE)) * 100"


@query(f"SELECT baseline_id, CASE WHEN consensus_revenue = 0 OR abs({_PCT}) <= 1.0 THEN 'unchanged' WHEN {_PCT} > 0 THEN 'up' ELSE 'down' END AS revision FROM baseline", "event", "baseline")
def guidance_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "baseline").select("baseline_id", ev.revision(F.col("guidance_revenue").cast("double"), F.col("consensus_revenue").cast("double")).alias("revision"))


@query("SELECT baseline_id, CASE WHEN consensus_revenue <> 0 THEN CAST(revenue AS DOUBLE) / abs(CAST(consensus_revenue AS DOUBLE)) * 100 END AS progress FROM baseline JOIN actual ON baseline.k = actual.k", "event", "baseline", "actual")
def forecast_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "baseline").join(view(spark, sf_dir, "actual"), "k").select("baseline_id", ev.progress(F.col("revenue").cast("double"), F.col("consensus_revenue").cast("double")).alias("progress"))


@query("""WITH s AS (SELECT l_orderkey AS event_id, l_returnflag AS category, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos, CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END AS revenue, CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice * (l_discount - l_tax) END AS profit FROM lineitem),
  g AS (SELECT event_id, category, arg_min(revenue, pos) FILTER (revenue IS NOT NULL) AS revenue, arg_min(profit, pos) FILTER (profit IS NOT NULL) AS profit FROM s GROUP BY 1, 2)
  SELECT event_id, category, revenue, CASE WHEN profit IS NULL THEN 'reported_only' WHEN profit > 0 THEN 'profit' WHEN profit < 0 THEN 'loss' ELSE 'even' END AS result FROM g""")  # fmt: skip
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS event_id", "l_returnflag AS category", "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos", "CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END AS revenue", "CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice * (l_discount - l_tax) END AS profit")
    return ev.segment_rollup(rows, ["event_id", "category"], "pos").select("event_id", "category", "revenue", "result")


_STOP = ("the", "and", "may", "with", "because", "even", "if", "of", "de", "la", "le", "les")
_STOPS = ", ".join(f"'{s}'" for s in _STOP)
_TOKENS = "list_filter(list_distinct(list_transform(regexp_extract_all({c}, '([A-Za-z]+|[\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}]{{2,}})'), lambda t: lower(t))), lambda t: t NOT IN (" + _STOPS + "))"


@query(f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS.format(c='text')} AS t FROM documents)")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text"), _STOP).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


_POSITIVE, _NEGATIVE = ("tion", "eau", "keit"), ("ing", "ent", "ver", "cion")
_SIGN = "sign(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in _POSITIVE) + " - " + " - ".join(f"contains(lower(text), '{w}')::INT" for w in _NEGATIVE) + ")::INT"


@query(f"SELECT doc_id, {_SIGN} AS polarity FROM documents")
def text_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select("doc_id", text.polarity(F.col("text"), _POSITIVE, _NEGATIVE).alias("polarity"))


_HF = f"""h AS (SELECT conv_id, 'H-' || conv_id || '-' || turn AS hypothesis_id, {_TOKENS.format(c='text')} AS t, {_SIGN} AS direction FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, 'F-' || conv_id || '-' || turn AS finding_id, {_TOKENS.format(c='text')} AS t, {_SIGN} AS direction FROM conversations WHERE role = 'assistant'),
 hf AS (SELECT DISTINCT hypothesis_id, finding_id FROM (SELECT conv_id, hypothesis_id, unnest(t) AS w FROM h) a JOIN (SELECT conv_id, finding_id, unnest(t) AS w FROM f) b ON a.conv_id = b.conv_id AND a.w = b.w)"""


def _hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = view(spark, sf_dir, "conversations")
    some = lambda role, name, p: turns.filter(F.col("role") == role).select("conv_id", F.concat(F.lit(p), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias(name), text.tokens(F.col("text"), _STOP).alias("tokens"), text.polarity(F.col("text"), _POSITIVE, _NEGATIVE).alias("direction"))
    return some("user", "hypothesis_id", "H-"), some("assistant", "finding_id", "F-")


@query(f"WITH {_HF} SELECT * FROM hf")
def hypothesis_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _hypotheses(spark, sf_dir)
    return ev.hypothesis_links(h, f, on="conv_id")


_RESULT = """, v AS (SELECT h.hypothesis_id, h.direction AS d, sum(f.direction) AS net, sum(CASE WHEN f.direction = h.direction THEN 1 ELSE 0 END) AS same, sum(CASE WHEN f.direction = -h.direction THEN 1 ELSE 0 END) AS against FROM h LEFT JOIN hf ON h.hypothesis_id = hf.hypothesis_id LEFT JOIN f ON f.finding_id = hf.finding_id GROUP BY 1, 2),
 hr AS (SELECT hypothesis_id, CASE WHEN net IS NULL OR d = 0 THEN 'pending' WHEN same > 0 AND against = 0 AND sign(net) = d THEN 'supported' WHEN against > 0 AND same = 0 AND sign(net) = -d THEN 'invalidated' ELSE 'mixed' END AS result FROM v)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _hypotheses(spark, sf_dir)
    return ev.hypothesis_results(h, ev.hypothesis_links(h, f, on="conv_id"), f)


@query(f"WITH {_HF} {_RESULT} SELECT * FROM hr")
def hypothesis_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


_VOTES = """SELECT o_orderkey AS event_id, 'earnings' AS dimension, CASE WHEN o_totalprice > 250000 THEN 1 ELSE -1 END AS vote FROM {orders} WHERE o_orderkey % 10 <> 9 UNION ALL
  SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'guidance' ELSE 'segments' END, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END FROM {lineitem} WHERE l_orderkey % 10 < 6"""
_DIM = "d AS (SELECT event_id, dimension, sign(sum(vote))::INT AS sign FROM (" + _VOTES.format(orders="orders", lineitem="lineitem") + ") GROUP BY 1, 2)"


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dimension_votes(spark.sql(_VOTES, orders=view(spark, sf_dir, "orders"), lineitem=view(spark, sf_dir, "lineitem")))


@query(f"WITH {_DIM} SELECT * FROM d")
def dimension_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimensions(spark, sf_dir)


@query(f"WITH {_DIM} SELECT o_orderkey AS event_id, CASE WHEN s IS NULL THEN 'inconclusive' WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' WHEN a > 0 THEN 'mixed' ELSE 'in_line' END AS overall FROM orders LEFT JOIN (SELECT event_id, sum(sign) AS s, max(abs(sign)) AS a FROM d GROUP BY 1) x ON o_orderkey = x.event_id")
def overall_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.overall(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")), _dimensions(spark, sf_dir))


# ---- market reaction

_MS = """s AS (SELECT ticker, ts::DATE AS day, arg_min(price, ts) AS open, arg_max(price, ts) AS close FROM price WHERE isodow(ts) < 6 GROUP BY 1, 2), sn AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS no FROM s),
 b AS (SELECT a.*, p.price AS before FROM announcement a ASOF LEFT JOIN price p ON a.ticker = p.ticker AND a.announced_at > p.ts), c AS (SELECT b.*, p.price AS after FROM b ASOF LEFT JOIN price p ON b.ticker = p.ticker AND b.announced_at < p.ts),
 n AS (SELECT c.*, (SELECT count(*) FROM sn WHERE sn.ticker = c.ticker AND sn.day <= c.announced_at::DATE) AS passed, (SELECT count(*) FROM sn WHERE sn.ticker = c.ticker AND sn.day < c.announced_at::DATE) AS earlier FROM c),
 ms AS (SELECT n.ticker, announcement_id, corporate_action, z.close AS pre_close, CASE WHEN session = 'intraday' THEN before ELSE z.close END AS reference, CASE WHEN session = 'after_close' THEN x.open ELSE after END AS immediate, x.close AS next_close, y.close AS fifth_close, announced_at
   FROM n LEFT JOIN sn x ON x.ticker = n.ticker AND x.no = passed + 1 LEFT JOIN sn y ON y.ticker = n.ticker AND y.no = passed + 5 LEFT JOIN sn z ON z.ticker = n.ticker AND z.no = CASE WHEN session = 'after_close' THEN passed ELSE earlier END)"""
_STAGES = reaction.STAGES
_RX = _MS + ", rp AS (SELECT *, " + ", ".join(f"CASE WHEN NOT corporate_action AND {r} <> 0 THEN round(({s} / {r} - 1) * 100, 4) END AS {s}_pct" for s, r in zip(_STAGES, ("reference", "pre_close", "pre_close"), strict=True)) + " FROM ms), rd AS (SELECT *, " + ", ".join(
    f"CASE WHEN corporate_action THEN 'not_comparable' WHEN {s}_pct IS NULL THEN 'pending' WHEN {s}_pct > 0.5 THEN 'positive' WHEN {s}_pct < -0.5 THEN 'negative' ELSE 'muted' END AS {s}_dir" for s in _STAGES) + """ FROM rp),
 rx AS (SELECT *, CASE WHEN 'not_comparable' IN (immediate_dir, next_close_dir, fifth_close_dir) THEN 'not_comparable' WHEN 'pending' IN (immediate_dir, next_close_dir, fifth_close_dir) THEN 'pending' WHEN immediate_dir = 'muted' AND next_close_dir = 'muted' AND fifth_close_dir = 'muted' THEN 'muted'
   WHEN immediate_dir IN ('positive', 'negative') AND fifth_close_dir <> immediate_dir AND fifth_close_dir <> 'muted' THEN 'reversed' WHEN immediate_dir IN ('positive', 'negative') AND fifth_close_dir = immediate_dir THEN CASE WHEN abs(fifth_close_pct) > abs(immediate_pct) THEN 'extended' ELSE 'sustained' END ELSE 'mixed' END AS path FROM rd)"""  # fmt: skip


def _milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.milestones(view(spark, sf_dir, "announcement"), view(spark, sf_dir, "price"))


def _reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.reactions(_milestones(spark, sf_dir))


@query(f"WITH {_MS} SELECT ticker, announcement_id, pre_close, reference, immediate, next_close, fifth_close FROM ms", "price", "announcement")
def milestones_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _milestones(spark, sf_dir).drop("announced_at", "session", "corporate_action")


@query(f"WITH {_MS} " + " UNION ALL ".join(f"SELECT announcement_id, '{role}' AS role, {c} AS price, CASE WHEN {c} IS NULL THEN 'pending' WHEN corporate_action THEN 'not_comparable' WHEN pre_close IS NULL THEN 'pending' ELSE 'observed' END AS status, " + ("CAST(NULL AS DOUBLE)" if c == "pre_close" else f"CASE WHEN NOT corporate_action AND pre_close <> 0 THEN round(({c} / pre_close - 1) * 100, 4) END") + " AS return_pct FROM ms" for role, c in reaction.ROLES.items()), "price", "announcement")
def milestone_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.milestone_rows(_milestones(spark, sf_dir))


@query(f"WITH {_RX}, tr AS (SELECT announcement_id, corporate_action, pre_close IS NOT NULL AND immediate_pct IS NOT NULL AND next_close_pct IS NOT NULL AND fifth_close_pct IS NOT NULL AS whole FROM rx) SELECT announcement_id, CASE WHEN corporate_action THEN 'not_comparable' WHEN whole THEN 'complete' ELSE 'tracking' END AS status, CASE WHEN corporate_action THEN 'manual_review_required' WHEN whole THEN 'ready_for_post_event_validation' ELSE 'awaiting_price_milestones' END AS next_stage FROM tr", "price", "announcement")
def reaction_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reactions(spark, sf_dir).select("announcement_id", "status", "next_stage")


_CONTEXT = "SELECT k AS row_number, 'BU-' || CAST(k AS STRING) AS bundle_id, event_id, lpad(CAST(o_custkey + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END AS STRING), 4, '0') AS ticker, CASE WHEN k % 31 = 0 THEN 'holiday' ELSE session END AS session, scheduled_at + CASE WHEN k % 29 = 0 THEN INTERVAL '6' MINUTE ELSE INTERVAL '5' MINUTE END AS announced_at FROM {event}"
_PAID = "SELECT 'BU-' || CAST(l_orderkey AS STRING) AS bundle_id, CASE WHEN l_partkey % 41 = 0 THEN 'USD' ELSE 'JPY' END AS currency FROM {lineitem}"
_CONTEXT_RULES = [
    ("event_id", "not_one_occurrence", "coalesce(n_oc, 0) <> 1 OR oat IS NULL"), ("event_id", "occurrence_superseded", "sid IN (SELECT supersedes FROM status WHERE supersedes IS NOT NULL)"), ("session", "other_session", "session <> es"),
    ("ticker", "other_ticker", "ticker <> ct"), ("announced_at", "other_time", "announced_at <> oat"), ("currency", "other_currency", "lc IS NULL OR lc <> 'JPY' OR mc <> 'JPY'"),
]


@query(f"WITH bu AS ({_CONTEXT.format(event='event')}), pd AS (SELECT bundle_id, min(currency) AS lc, max(currency) AS mc FROM ({_PAID.format(lineitem='lineitem')}) GROUP BY 1), oc AS (SELECT event_id, count(*) AS n_oc, min(occurred_at) AS oat, min(status_id) AS sid FROM status WHERE status = 'occurred' GROUP BY 1), "
  "j AS (SELECT bu.*, lc, mc, n_oc, oat, sid, e.session AS es, c.ticker AS ct FROM bu JOIN event e USING (event_id) JOIN company c ON c.company_id = e.company_id LEFT JOIN oc USING (event_id) LEFT JOIN pd USING (bundle_id)) " + rules_sql("bundle", "j", _CONTEXT_RULES), "company", "event", "status")  # fmt: skip
def bundle_dataset_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, companies = view(spark, sf_dir, "event"), view(spark, sf_dir, "company").withColumn("currency", F.lit("JPY"))
    prices = spark.sql(_PAID, lineitem=view(spark, sf_dir, "lineitem"))
    return reaction.dataset_context(spark.sql(_CONTEXT, event=events), events, view(spark, sf_dir, "status"), companies, prices)


@query(f"WITH {_RX} SELECT announcement_id, immediate_pct, next_close_pct, fifth_close_pct FROM rx", "price", "announcement")
def event_window_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reactions(spark, sf_dir).select("announcement_id", *[f"{s}_pct" for s in _STAGES])


@query(f"WITH {_RX} SELECT announcement_id, immediate_dir, next_close_dir, fifth_close_dir, path FROM rx", "price", "announcement")
def reaction_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reactions(spark, sf_dir).select("announcement_id", *[f"{s}_dir" for s in _STAGES], "path")


_OBSERVED = "SELECT event_id AS row_number, CASE event_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'immediate' ELSE 'next_close' END AS role, ts, ts + INTERVAL '1' MINUTE * (event_id % 7 - 3) AS announced_at, user_id AS bundle_id, CASE WHEN event_id % 41 = 0 THEN 'USD' ELSE 'JPY' END AS currency, value - 10 AS price, event_id % 53 = 0 AS adjusted FROM {events}"
_T = "'observation' AS \"table\", row_number, "


@query(f"WITH o AS ({_OBSERVED.format(events='events')}) SELECT {_T} 'ts' AS \"column\", 'not_before' AS code FROM o WHERE role = 'before' AND ts >= announced_at UNION ALL SELECT {_T} 'ts', 'not_after' FROM o WHERE role <> 'before' AND ts <= announced_at")
def timing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.timing_checks(spark.sql(_OBSERVED, events=view(spark, sf_dir, "events")))


_BUNDLES = "SELECT o_orderkey AS bundle_id, o_custkey % 50 AS ticker, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * (8 + o_orderkey % 9) AS announced_at, CASE o_orderkey % 3 WHEN 0 THEN 'before_open' WHEN 1 THEN 'intraday' ELSE 'after_close' END AS announcement_session, CAST(o_orderdate AS DATE) - 1 AS pre_close_date, CAST(o_orderdate AS DATE) + 1 AS next_date, CAST(o_orderdate AS DATE) + 5 AS fifth_date FROM {orders}"
_VERIFIED = "SELECT DISTINCT o_custkey % 50 AS ticker, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '9' HOUR AS open_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '15' HOUR AS close_at FROM {orders}"
_SEEN = """SELECT l_orderkey * 10 + l_linenumber AS row_number, l_orderkey AS bundle_id, CASE l_linenumber % 5 WHEN 0 THEN 'fifth_business_day_close' WHEN 1 THEN 'pre_event_close' WHEN 2 THEN 'immediate_post_announcement' WHEN 3 THEN 'pre_announcement_reference' ELSE 'next_business_day_close' END AS role,
  CASE l_partkey % 5 WHEN 0 THEN 'official_open' WHEN 1 THEN 'official_close' WHEN 2 THEN 'minute_bar_close' WHEN 3 THEN 'vwap_after_announcement' ELSE 'manual_trade_price' END AS price_kind, CAST(o_orderdate AS DATE) + CAST(l_suppkey % 7 - 1 AS INT) AS trading_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(l_suppkey % 7 - 1 AS INT) AS TIMESTAMP) + INTERVAL '1' HOUR * (8 + l_partkey % 9) AS price_at FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
_INSIDE = "('minute_bar_close', 'vwap_after_announcement', 'manual_trade_price')"
_TIMING = [
    ("price_at", "not_before", "role IN ('pre_announcement_reference', 'pre_event_close') AND price_at >= announced_at"),
    ("price_at", "not_after", "role = 'immediate_post_announcement' AND price_at <= announced_at"),
    ("trading_date", "unexpected_date", "trading_date <> CASE role WHEN 'pre_event_close' THEN pre_close_date WHEN 'pre_announcement_reference' THEN CAST(announced_at AS DATE) WHEN 'immediate_post_announcement' THEN CASE WHEN announcement_session = 'after_close' THEN next_date ELSE CAST(announced_at AS DATE) END WHEN 'next_business_day_close' THEN next_date ELSE fifth_date END"),
    ("role", "reference_not_intraday", "role = 'pre_announcement_reference' AND announcement_session <> 'intraday'"),
    ("price_kind", "kind_not_of_session", f"role = 'immediate_post_announcement' AND CASE WHEN announcement_session = 'intraday' THEN price_kind NOT IN {_INSIDE} ELSE price_kind NOT IN ('official_open', 'manual_trade_price') END"),
    ("trading_date", "no_verified_session", "open_at IS NULL"),
    ("price_at", "not_at_open", "price_kind = 'official_open' AND price_at <> open_at"),
    ("price_at", "not_at_close", "price_kind = 'official_close' AND price_at <> close_at"),
    ("price_at", "outside_session", f"price_kind IN {_INSIDE} AND NOT price_at BETWEEN open_at AND close_at"),
]


@query(f"WITH bu AS ({_BUNDLES.format(orders='orders')}), vs AS ({_VERIFIED.format(orders='orders')}), ob AS ({_SEEN.format(orders='orders', lineitem='lineitem')}), j AS (SELECT * FROM ob JOIN bu USING (bundle_id) LEFT JOIN vs ON vs.ticker = bu.ticker AND vs.day = ob.trading_date) " + " UNION ALL ".join(f"SELECT {_T} '{c}' AS \"column\", '{code}' AS code FROM j WHERE {rule}" for c, code, rule in _TIMING)
  + " UNION ALL SELECT 'bundle', bundle_id, 'announcement_session', 'no_reference' FROM bu WHERE announcement_session = 'intraday' AND bundle_id NOT IN (SELECT bundle_id FROM ob WHERE role = 'pre_announcement_reference')")
def bundle_timing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = view(spark, sf_dir, "orders"), view(spark, sf_dir, "lineitem")
    return reaction.bundle_timing_checks(spark.sql(_SEEN, orders=orders, lineitem=lineitem), spark.sql(_BUNDLES, orders=orders), spark.sql(_VERIFIED, orders=orders))


@query(f"""WITH o AS ({_OBSERVED.format(events='events')}), b AS (SELECT bundle_id, count(DISTINCT currency) AS cs, count(role) AS n, count(DISTINCT role) AS rs FROM o GROUP BY 1), j AS (SELECT * FROM o JOIN b USING (bundle_id))
  SELECT {_T} 'currency' AS "column", 'several_currencies' AS code FROM j WHERE cs > 1 UNION ALL SELECT {_T} 'role', 'repeated_role' FROM j WHERE n > rs UNION ALL SELECT {_T} 'price', 'not_positive' FROM j WHERE price <= 0 UNION ALL SELECT {_T} 'adjusted', 'adjusted_price' FROM j WHERE adjusted""")  # fmt: skip
def price_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.price_checks(spark.sql(_OBSERVED, events=view(spark, sf_dir, "events")))


_SESSIONS = "SELECT o_orderkey AS row_number, o_custkey % 50 AS ticker, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '9' HOUR AS open_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * (8 + o_orderkey % 9) AS close_at FROM {orders}"


@query(f"""WITH s AS ({_SESSIONS.format(orders='orders')}), w AS (SELECT *, lag(day) OVER (PARTITION BY ticker ORDER BY row_number) AS last FROM s)
  SELECT 'session' AS "table", row_number, 'day' AS "column", 'weekend' AS code FROM w WHERE isodow(day) > 5 UNION ALL SELECT 'session', row_number, 'open_at', 'not_before_close' FROM w WHERE open_at >= close_at UNION ALL SELECT 'session', row_number, 'day', 'not_ascending' FROM w WHERE day <= last""")  # fmt: skip
def session_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.session_checks(spark.sql(_SESSIONS, orders=view(spark, sf_dir, "orders")))


# ---- review and carry-over

_EARN = "CASE announcement_id % 5 WHEN 0 THEN 'inconclusive' WHEN 1 THEN 'negative' WHEN 2 THEN 'negative' ELSE 'positive' END"
_DIRS = [f"{s}_dir" for s in _STAGES]
_REVIEW = _RX + f""", rv0 AS (SELECT *, {_EARN} AS earnings, CASE WHEN 'not_comparable' IN ({", ".join(_DIRS)}) THEN 'blocked' WHEN 'pending' IN ({", ".join(_DIRS)}) THEN 'provisional' ELSE 'complete' END AS state FROM rx),
 rv AS (SELECT *, CASE WHEN immediate_dir = 'not_comparable' THEN 'not_comparable' WHEN immediate_dir = 'pending' OR earnings = 'inconclusive' OR immediate_dir = 'muted' THEN 'insufficient_evidence' WHEN earnings = 'positive' AND immediate_dir = 'negative' THEN 'possible_higher_hurdle_than_recorded' WHEN earnings = 'negative' AND immediate_dir = 'positive' THEN 'possible_lower_hurdle_than_recorded' ELSE 'earnings_and_market_aligned' END AS interpretation,
   CASE WHEN path = 'reversed' THEN 'reversed_by_fifth_business_day' WHEN immediate_dir = 'not_comparable' THEN 'not_comparable' WHEN 'pending' IN ({", ".join(_DIRS)}) THEN 'pending' WHEN next_close_dir <> immediate_dir AND next_close_dir NOT IN ('muted', 'pending') THEN 'changed_by_next_business_day' WHEN immediate_dir = next_close_dir AND next_close_dir = fifth_close_dir THEN 'same_direction' ELSE 'mixed' END AS transition FROM rv0)"""


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = [F.col(d) for d in _DIRS]
    rows = _reactions(spark, sf_dir).withColumn("earnings", F.expr(_EARN)).withColumn("state", review.review_state(dirs))
    return rows.withColumn("interpretation", review.interpretation(F.col("earnings"), dirs[0])).withColumn("transition", review.transition(F.col("path"), dirs))


@query(f"WITH {_RX} " + " UNION ALL ".join(f"SELECT announcement_id, '{s}' AS stage, {i} AS stage_no, {s}_dir AS direction, {s}_pct AS pct FROM rx" for i, s in enumerate(_STAGES)), "price", "announcement")
def market_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.market_stages(_reactions(spark, sf_dir), _STAGES)


@query(f"WITH {_REVIEW} SELECT announcement_id, state, interpretation, transition FROM rv", "price", "announcement")
def reason_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("announcement_id", "state", "interpretation", "transition")


@query(f"WITH {_HF} {_RESULT}, c AS (SELECT CAST(split_part(hypothesis_id, '-', 2) AS BIGINT) AS conv_id, * FROM hr) SELECT conv_id, CASE WHEN count(*) = sum((result = 'pending')::INT) THEN 'pending' WHEN count(*) = sum((result = 'supported')::INT) THEN 'success' WHEN count(*) = sum((result = 'invalidated')::INT) THEN 'failure' ELSE 'partial_success' END AS forecast_result, coalesce(string_agg(CASE WHEN result = 'supported' THEN hypothesis_id END, ',' ORDER BY hypothesis_id), '') AS supported, coalesce(string_agg(CASE WHEN result = 'pending' THEN hypothesis_id END, ',' ORDER BY hypothesis_id), '') AS pending FROM c GROUP BY 1 UNION ALL SELECT DISTINCT conv_id + 1000000, 'pending', '', '' FROM conversations WHERE conv_id % 5 = 0")
def forecast_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("conv_id", F.split_part("hypothesis_id", F.lit("-"), F.lit(2)).cast("long"))
    reviews = view(spark, sf_dir, "conversations").select("conv_id").distinct()
    reviews = rows.select("conv_id").union(reviews.filter("conv_id % 5 = 0").select(F.col("conv_id") + 1_000_000)).distinct()  # the latter have no hypotheses
    return review.forecast_result(rows, "conv_id", reviews).join(review.ids_by_result(rows, "conv_id"), "conv_id", "left").select("conv_id", "forecast_result", F.concat_ws(",", "supported_ids").alias("supported"), F.concat_ws(",", "pending_ids").alias("pending"))




@query(f"WITH {_REVIEW} SELECT announcement_id, array_to_string(CASE WHEN transition = 'mixed' THEN ['path ' || path, 'state ' || state, 'mixed'] ELSE ['path ' || path, 'state ' || state] END, '|') AS learning FROM rv", "price", "announcement")
def learning_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir).selectExpr("announcement_id", "array('path ' || path, 'state ' || state) AS what_worked", "array('state ' || state, CASE WHEN transition = 'mixed' THEN 'mixed' ELSE 'path ' || path END) AS what_failed")
    return rows.select("announcement_id", F.concat_ws("|", review.learning(rows, ["what_worked", "what_failed"])).alias("learning"))


@query("""WITH w AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders), i AS (SELECT *, 'PEL-' || substr(sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(version AS VARCHAR))), 1, 16) AS review_id FROM w)
  SELECT o_orderkey, version, review_id, lag(review_id) OVER (PARTITION BY o_custkey ORDER BY version) AS supersedes_review_id FROM i""")  # fmt: skip
def review_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.version_chain(view(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "version", "review_id", "supersedes_review_id")


@query(f"""WITH {_REVIEW}, q AS (SELECT announcement_id AS row_number, CASE WHEN announcement_id % 17 = 0 THEN 'complete' ELSE state END AS st, state, announcement_id % 9 = 0 AS rep, announcement_id % 11 = 0 AS late FROM rv)
  SELECT 'review' AS "table", row_number, 'sources' AS "column", 'repeated_source' AS code FROM q WHERE rep UNION ALL SELECT 'review', row_number, 'source_time', 'future_source' FROM q WHERE late UNION ALL SELECT 'review', row_number, 'state', 'state_differs' FROM q WHERE st <> state""", "price", "announcement")  # fmt: skip
def review_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir).selectExpr("announcement_id AS row_number", "CASE WHEN announcement_id % 17 = 0 THEN 'complete' ELSE state END AS state", "CASE WHEN announcement_id % 9 = 0 THEN array('a', 'b', 'a') ELSE array('a', 'b') END AS sources",
        "announced_at AS reviewed_at", "CASE WHEN announcement_id % 11 = 0 THEN announced_at + INTERVAL '1' DAY ELSE announced_at END AS source_time", *[f"{d} AS dir{i}" for i, d in enumerate(_DIRS)])
    return review.contract(rows)


@query(f"""WITH {_REVIEW}, l AS (SELECT announcement_id AS review_id, 'worked' AS field, unnest(['path ' || path, 'state ' || state]) AS text FROM rv UNION ALL SELECT announcement_id, 'failed', unnest(['transition ' || transition]) FROM rv)
  SELECT field, text, count(DISTINCT review_id) AS n_reviews, min(review_id) AS first_review_id FROM l GROUP BY 1, 2""", "price", "announcement")  # fmt: skip
def carryover_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir).selectExpr("announcement_id AS review_id", "array('path ' || path, 'state ' || state) AS worked", "array('transition ' || transition) AS failed")
    return review.aggregate_learning(rows, ["worked", "failed"]).select("field", "text", "n_reviews", "first_review_id")


@query(f"WITH {_REVIEW} SELECT earnings, interpretation, transition, count(DISTINCT announcement_id) AS n_reviews, count(DISTINCT ticker) AS n_events FROM rv GROUP BY 1, 2, 3", "price", "announcement")
def carryover_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir).withColumnsRenamed({"announcement_id": "review_id", "ticker": "event_id"})
    return review.aggregate_divergences(rows, ["earnings", "interpretation", "transition"])


# ---- stream


@query(f"SELECT run_id, target, result, version_after, error_count, state FROM ({records.ORACLES['transition_batch']})")
def transition_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query's rows from a stream: all events through keyed state, into a table in the shared folder."""
    base = new_folder(spark, "transition")
    given = view(spark, sf_dir, "events")
    alone = given.inputFiles()[0].endswith("/events.parquet")  # a stream reads folders
    source = spark.readStream.schema(given.schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else source.parquet(f"{sf_dir}/events.parquet")
    observed = spark.sql(records._OBS.format(sha="sha2(event_type, 256)", events="{events}"), events=events).drop("ts", "document_id")
    out = monitor_stream.run_to_table(monitor_stream.transition_stream(observed), f"{base}/runs", f"{base}/state")
    return out.select("run_id", "target", "result", "version_after", "error_count", "state")
