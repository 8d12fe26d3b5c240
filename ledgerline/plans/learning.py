"""Registered queries: reasons, learning lists, what reviews teach together, and the review contract, on the reviews, hypotheses and evaluations of the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation as ev, learning
from ..sources.tables import staged_rows
from . import analysis
from .views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Items of reviews in SQL that both engines run. rv: reviews; hy: hypotheses with their results; ac, bl: results and baselines.
_REVIEWS = """SELECT announcement_id AS review_id, announcement_id + 2 AS row_number, ticker AS group_id, announcement_id AS review_no, ticker * 100 + announcement_id % 3 AS event_id, earnings, path AS reaction_path, CASE WHEN corporate_action THEN 'present' ELSE 'none_detected' END AS corporate_action_status,
  announced_at AS reviewed_at, concat('B-', CAST(announcement_id AS STRING)) AS baseline_id, concat('E-', CAST(announcement_id AS STRING)) AS evaluation_id, concat('T-', CAST(announcement_id AS STRING)) AS tracking_id,
  CASE WHEN announcement_id % 13 = 6 THEN 2 ELSE 1 END AS version, CAST(NULL AS STRING) AS supersedes_review_id, CASE WHEN announcement_id % 13 = 7 THEN 'complete' ELSE state END AS status,
  CASE WHEN announcement_id % 13 = 8 THEN 'learning_record_ready' WHEN state = 'complete' THEN 'learning_record_ready' WHEN state = 'provisional' THEN 'awaiting_market_milestones' ELSE 'comparison_blocked' END AS next_stage FROM {rv}"""
_VERIFIED = """SELECT r.announcement_id AS review_id, h.turn AS pos, h.hypothesis_id, concat(CASE WHEN h.turn % 4 = 0 THEN '会社予想: ' ELSE '' END, substr(h.text, 1, 20)) AS hypothesis_text, CASE h.result WHEN 'invalidated' THEN 'rejected' WHEN 'mixed' THEN 'partially_supported' ELSE h.result END AS result,
  CASE WHEN r.announcement_id % 13 = 11 THEN {one} ELSE {two} END AS source_ids, CASE WHEN h.result = 'invalidated' THEN {inv} ELSE {none} END AS invalidation_ids FROM {rv} r JOIN {hy} h ON h.conv_id = r.ticker"""
_STAGED = "SELECT announcement_id AS review_id, '{name}' AS stage, CASE WHEN {c}_dir IN ('pending', 'not_comparable') THEN {c}_dir ELSE 'complete' END AS status, {c}_dir AS direction, {c}_pct AS return_pct, concat('T-', CAST(CASE WHEN announcement_id % 13 = 4 THEN announcement_id + 1 ELSE announcement_id END AS STRING)) AS source_id FROM {rv} WHERE announcement_id % 13 <> {gone}"
_SOURCES = """SELECT announcement_id AS review_id, 'pre_event_baseline' AS record_type, concat('B-', CAST(announcement_id AS STRING)) AS record_id, announced_at AS recorded_at FROM {rv}
  UNION ALL SELECT announcement_id, 'pre_event_baseline', concat('B-', CAST(announcement_id AS STRING)), announced_at FROM {rv} WHERE announcement_id % 13 = 2
  UNION ALL SELECT announcement_id, 'earnings_evaluation', concat('E-', CAST(announcement_id AS STRING)), announced_at FROM {rv} WHERE announcement_id % 13 <> 1
  UNION ALL SELECT announcement_id, 'market_reaction_tracking', concat('T-', CAST(announcement_id AS STRING)), announced_at + CASE WHEN announcement_id % 13 = 5 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END FROM {rv}
  UNION ALL SELECT review_id, CASE WHEN review_id % 13 = 3 AND pos = 0 THEN 'note' ELSE 'pre_event_hypothesis' END, hypothesis_id, CAST(NULL AS TIMESTAMP) FROM {vf}
  UNION ALL SELECT review_id, 'hypothesis_invalidation', concat('I-', hypothesis_id), CAST(NULL AS TIMESTAMP) FROM {vf} WHERE result = 'rejected' AND review_id % 13 <> 10"""
_NAMES = dict(zip(learning.STAGES, ("immediate", "next_close", "fifth_close"), strict=True))


def _staged_sql(rv: str) -> str:
    return " UNION ALL ".join(_STAGED.format(name=n, c=c, rv=rv, gone=9 if c == "fifth_close" else -1) for n, c in _NAMES.items())


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """reviews, verifications, numeric, guidance, stages, sources. What several of them are made from is written once, not worked out again for each use."""
    rv = staged_rows(analysis._reviews(spark, sf_dir))
    turns = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("H-"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("hypothesis_id"), "text")
    hy = analysis._results(spark, sf_dir).join(turns, "hypothesis_id")
    arrays = {"one": "array(h.hypothesis_id)", "two": "array(h.hypothesis_id, concat('E-', CAST(r.announcement_id AS STRING)))", "inv": "array(concat('I-', h.hypothesis_id))", "none": "CAST(array() AS array<string>)"}
    vf = staged_rows(spark.sql(_VERIFIED.format(rv="{rv}", hy="{hy}", **arrays), rv=rv, hy=hy))
    base = staged_rows(view(spark, sf_dir, "baseline").filter("v = 1").join(view(spark, sf_dir, "actual"), "k").join(rv.select(F.col("announcement_id").alias("k")), "k").select("k", "revenue", "consensus_revenue", "guidance_revenue"))
    source = F.concat(F.lit("E-"), F.col("k").cast("string"))
    band = lambda column: ev.band(ev.pct_change(F.col("revenue").cast("double"), F.col(column).cast("double")))
    numeric = base.select(F.col("k").alias("review_id"), source.alias("source_id"), F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.lit("revenue").alias("metric_name"), band("consensus_revenue").alias("result")), F.struct(F.lit(1).alias("pos"), F.lit("guided_revenue").alias("metric_name"), band("guidance_revenue").alias("result")))))
    guidance = base.filter("k % 3 <> 1").select(F.col("k").alias("review_id"), F.lit(0).alias("pos"), F.lit("revenue").alias("metric_name"), ev.revision(F.col("consensus_revenue").cast("double"), F.col("guidance_revenue").cast("double")).alias("revision"), source.alias("source_id"))
    return spark.sql(_REVIEWS, rv=rv), vf, numeric, guidance, spark.sql(_staged_sql("{rv}"), rv=rv), spark.sql(_SOURCES, rv=rv, vf=vf.select("review_id", "pos", "hypothesis_id", "result"))


_BAND = "CASE WHEN {e} = 0 OR abs((revenue::DOUBLE - {e}::DOUBLE) / abs({e}::DOUBLE) * 100) <= 1 THEN '{same}' WHEN revenue::DOUBLE > {e}::DOUBLE THEN '{up}' ELSE '{down}' END"
_BASE = (
    f"WITH {analysis._REVIEW}, {analysis._HF} {analysis._RESULT}, hy AS (SELECT c.conv_id, c.turn, c.text, hr.hypothesis_id, hr.result FROM hr JOIN conversations c ON hr.hypothesis_id = 'H-' || c.conv_id || '-' || c.turn), r AS ({_REVIEWS.format(rv='rv')}), "
    + "vf AS (" + _VERIFIED.format(rv="rv", hy="hy", one="[h.hypothesis_id]", two="[h.hypothesis_id, concat('E-', CAST(r.announcement_id AS STRING))]", inv="['I-' || h.hypothesis_id]", none="[]::VARCHAR[]") + "), "
    + "bs AS (SELECT a.k, revenue, consensus_revenue, guidance_revenue FROM baseline b JOIN actual a ON a.k = b.k JOIN rv ON rv.announcement_id = a.k WHERE v = 1), "
    + f"nm AS (SELECT k AS review_id, 0 AS pos, 'revenue' AS metric_name, {_BAND.format(e='consensus_revenue', same='in_line', up='above', down='below')} AS result, 'E-' || k AS source_id FROM bs UNION ALL SELECT k, 1, 'guided_revenue', {_BAND.format(e='guidance_revenue', same='in_line', up='above', down='below')}, 'E-' || k FROM bs), "
    + f"gd AS (SELECT k AS review_id, 'revenue' AS metric_name, {_BAND.replace('revenue::', 'consensus_revenue::').format(e='guidance_revenue', same='unchanged', up='up', down='down')} AS revision, 'E-' || k AS source_id FROM bs WHERE k % 3 <> 1), "
    + f"st AS ({_staged_sql('rv')}), so AS ({_SOURCES.format(rv='rv', vf='vf')})"
)
_VIEWS = ("price", "announcement", "event", "baseline", "actual")
_JOIN = lambda value, when: f"coalesce(string_agg({value}, '|' ORDER BY pos) FILTER (WHERE {when}), '')"
_TOLD = f"""{_BASE},
v1 AS (SELECT review_id, {_JOIN('hypothesis_id', "result = 'supported'")} AS sup, {_JOIN('hypothesis_id', "result = 'rejected'")} AS rej, {_JOIN('hypothesis_id', "result = 'pending'")} AS pen, {_JOIN('array_to_string(invalidation_ids, chr(124))', 'len(invalidation_ids) > 0')} AS trig, list_sort(list(DISTINCT result) FILTER (WHERE hypothesis_text LIKE '会社予想:%')) AS rd FROM vf GROUP BY 1),
n1 AS (SELECT review_id, {_JOIN('metric_name', "result = 'above'")} AS above, {_JOIN('metric_name', "result = 'below'")} AS below FROM nm GROUP BY 1),
s1 AS (SELECT review_id, any_value(direction) FILTER (WHERE stage LIKE 'imm%') AS d0, any_value(direction) FILTER (WHERE stage LIKE 'next%') AS d1, any_value(direction) FILTER (WHERE stage LIKE 'fifth%') AS d2 FROM st GROUP BY 1),
w AS (SELECT r.*, coalesce(sup, '') AS sup, coalesce(rej, '') AS rej, coalesce(pen, '') AS pen, coalesce(trig, '') AS trig, rd, coalesce(above, '') AS above, coalesce(below, '') AS below, n1.review_id IS NULL AS no_n, gd.metric_name || ':' || gd.revision AS gr, coalesce(d0, 'pending') AS d0, coalesce(d1, 'pending') AS d1, coalesce(d2, 'pending') AS d2
  FROM r LEFT JOIN v1 USING (review_id) LEFT JOIN n1 USING (review_id) LEFT JOIN s1 USING (review_id) LEFT JOIN gd USING (review_id)),
told AS (SELECT *, CASE WHEN rd IS NULL THEN 'not_recorded' WHEN rd = ['supported'] THEN 'supported' WHEN rd = ['rejected'] THEN 'contradicted' WHEN rd = ['pending'] THEN 'insufficient_evidence' ELSE 'mixed' END AS rdr,
  CASE WHEN d0 = 'not_comparable' THEN 'not_comparable' WHEN d0 IN ('pending', 'muted') OR earnings NOT IN ('positive', 'negative') THEN 'insufficient_evidence' WHEN earnings = 'positive' AND d0 = 'negative' THEN 'possible_higher_hurdle_than_recorded' WHEN earnings = 'negative' AND d0 = 'positive' THEN 'possible_lower_hurdle_than_recorded' ELSE 'earnings_and_market_aligned' END AS expectation,
  CASE WHEN reaction_path = 'reversed' THEN 'reversed_by_fifth_business_day' WHEN d0 = 'not_comparable' THEN 'not_comparable' WHEN 'pending' IN (d0, d1, d2) THEN 'pending' WHEN d1 <> d0 AND d1 <> 'muted' THEN 'changed_by_next_business_day' WHEN d0 = d1 AND d1 = d2 THEN 'same_direction' ELSE 'mixed' END AS transit,
  list_filter([{", ".join(f"CASE d{i} WHEN 'pending' THEN '{n}:awaiting_price' WHEN 'not_comparable' THEN '{n}:not_comparable' END" for i, n in enumerate(learning.STAGES))}, CASE WHEN no_n THEN 'no_numeric_comparison' END, CASE WHEN pen <> '' THEN 'pending_hypotheses' END], lambda x: x IS NOT NULL) AS missing FROM w)"""
_LISTS = f"""{_TOLD},
tx AS (SELECT review_id, coalesce(list(hypothesis_text ORDER BY pos) FILTER (WHERE result = 'supported'), []) AS kept, coalesce(list(hypothesis_text ORDER BY pos) FILTER (WHERE result IN ('rejected', 'partially_supported')), []) AS weak, coalesce(list(hypothesis_text ORDER BY pos) FILTER (WHERE result = 'pending'), []) AS open, coalesce(list(hypothesis_text ORDER BY pos) FILTER (WHERE result = 'rejected'), []) AS gone FROM vf GROUP BY 1),
al AS (SELECT told.*, coalesce(kept, []) AS kept, coalesce(weak, []) AS weak, coalesce(gone, []) AS gone, coalesce(open, []) || CASE WHEN no_n THEN ['numeric_expectations'] ELSE [] END AS additional, gd.review_id IS NOT NULL AS has_g FROM told LEFT JOIN tx USING (review_id) LEFT JOIN gd USING (review_id)),
raw AS (SELECT review_id, group_id, review_no, unnest(['maintain_criteria', 'weaken_candidates', 'additional_indicators', 'recurring_errors_to_prevent', 'supported_but_not_generalized', 'rejected_assumptions', 'next_event_checks']) AS field,
  unnest([kept, weak, additional, list_filter([CASE WHEN expectation LIKE 'possible%' THEN 'results_are_not_expectations' END, CASE WHEN transit LIKE '%business_day' THEN 'check_each_stage' END, CASE WHEN corporate_action_status <> 'none_detected' THEN 'no_return_with_corporate_action' END], lambda x: x IS NOT NULL), kept, gone,
    additional || list_transform(list_sort(list_distinct(list_filter(string_split(below || '|' || above, '|'), lambda x: x <> ''))), lambda x: 'compare:' || x) || missing || CASE WHEN has_g THEN ['recheck_guidance:revenue'] ELSE [] END]) AS texts FROM al),
fl AS (SELECT review_id, group_id, review_no, field, unnest(texts) AS text, generate_subscripts(texts, 1) AS pos FROM raw),
fi AS (SELECT review_id, group_id, review_no, field, text, min(pos) AS pos FROM fl GROUP BY 1, 2, 3, 4, 5)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql, *_VIEWS)
        return f

    return add


def _told(items: tuple[DataFrame, ...]) -> DataFrame:
    reviews, verified, numeric, guidance, stages, _ = items
    return learning.reasons(reviews.select("review_id", "earnings", "reaction_path"), verified, numeric, guidance, stages)


def _lists(items: tuple[DataFrame, ...]) -> DataFrame:
    return learning.learning_lists(items[0], items[1], items[3], _told(items))


@query(f"{_TOLD} SELECT review_id, sup AS supported, rej AS rejected, pen AS pending, above, below, coalesce(gr, '') AS revisions, trig AS triggered, rdr AS guidance_read, expectation, transit AS transition, array_to_string(missing, '|') AS missing FROM told")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _told(_items(spark, sf_dir))
    names = {"supported": "supported_hypothesis_ids", "rejected": "rejected_hypothesis_ids", "pending": "pending_hypothesis_ids", "above": "above_expectation_metrics", "below": "below_expectation_metrics", "revisions": "guidance_revisions", "triggered": "triggered_invalidation_record_ids", "missing": "missing_or_blocked_reasons"}
    return told.select("review_id", *[F.array_join(c, "|").alias(n) for n, c in names.items()], F.col("company_guidance_read_result").alias("guidance_read"), F.col("market_expectation_interpretation").alias("expectation"), F.col("reaction_transition").alias("transition"))


@query(f"{_LISTS}, o AS (SELECT review_id, field, string_agg(text, '|' ORDER BY pos) AS texts FROM (SELECT review_id, field, text, pos FROM fi WHERE field <> 'rejected_assumptions' UNION ALL SELECT review_id, field, text, pos FROM fl WHERE field = 'rejected_assumptions') GROUP BY 1, 2) SELECT review_id, field, texts FROM o")
def review_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.array_join(f, "|").alias("texts"), F.size(f).alias("n")) for f in learning.FIELDS])
    return _lists(_items(spark, sf_dir)).select("review_id", F.inline(cells)).filter("n > 0").drop("n")


@query(f"""{_LISTS}, ct AS (SELECT group_id, field, text, count(*) AS occurrence_count, min(struct_pack(a := review_no, b := pos)) AS first, array_to_string(list(review_id ORDER BY review_no)[1:100], '|') AS ids FROM fi WHERE field NOT IN ('additional_indicators', 'supported_but_not_generalized') GROUP BY 1, 2, 3)
SELECT group_id, field, md5(text) AS text_md5, row_number() OVER (PARTITION BY group_id, field ORDER BY first, text) AS place, occurrence_count, ids AS source_review_ids FROM ct""")
def carryover_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    out = learning.carried_learning(items[0], _lists(items))
    return out.select("group_id", "field", F.md5("text").alias("text_md5"), "place", "occurrence_count", F.array_join("source_review_ids", "|").alias("source_review_ids"))


@query(f"""{_TOLD}, kd AS (SELECT * FROM told WHERE expectation LIKE 'possible%'), evs AS (SELECT group_id, earnings, expectation, transit, event_id, min(review_no) AS n FROM kd GROUP BY 1, 2, 3, 4, 5),
e2 AS (SELECT group_id, earnings, expectation, transit, count(*) AS n_events, array_to_string(list(event_id ORDER BY n)[1:100], '|') AS events FROM evs GROUP BY 1, 2, 3, 4)
SELECT group_id, earnings AS earnings_assessment, expectation AS market_expectation_interpretation, transit AS reaction_transition, count(*) AS occurrence_count, any_value(n_events) AS n_events, min(review_no) AS first_no, array_to_string(list(review_id ORDER BY review_no)[1:100], '|') AS source_review_ids, any_value(events) AS source_event_ids FROM kd JOIN e2 USING (group_id, earnings, expectation, transit) GROUP BY 1, 2, 3, 4""")
def carryover_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return learning.divergences(items[0], _told(items)).withColumns({c: F.array_join(c, "|") for c in ("source_review_ids", "source_event_ids")})


@query(f"""{_BASE}, sp AS (SELECT review_id, count(*) AS n, count(DISTINCT (record_type, record_id)) AS nk, count(DISTINCT record_id) AS ni, max(recorded_at) AS latest, sum((record_type = 'pre_event_baseline')::INT) AS nb, sum((record_type = 'earnings_evaluation')::INT) AS ne, sum((record_type = 'market_reaction_tracking')::INT) AS nt FROM so GROUP BY 1),
sg AS (SELECT review_id, count(DISTINCT stage) AS ns, count(*) AS n, bool_or(status = 'pending') AS p, bool_or(status = 'not_comparable') AS b, bool_and(status = 'complete') AS c FROM st GROUP BY 1),
i AS (SELECT r.review_id, 'supersedes_review_id' AS col, 'version_chain' AS code FROM r WHERE (version = 1) <> (supersedes_review_id IS NULL)
  UNION ALL SELECT review_id, 'stages', 'stage_set' FROM sg WHERE ns <> 3 OR n <> 3 UNION ALL SELECT review_id, 'sources', 'repeated_source' FROM sp WHERE n <> nk UNION ALL SELECT review_id, 'sources', 'ambiguous_source_id' FROM sp WHERE n <> ni
  UNION ALL SELECT review_id, 'sources', 'primary_source_count' FROM sp WHERE nb <> 1 OR ne <> 1 OR nt <> 1 UNION ALL SELECT r.review_id, 'sources', 'future_source' FROM r JOIN sp USING (review_id) WHERE latest > reviewed_at
  UNION ALL SELECT r.review_id, 'status', 'complete_without_stages' FROM r JOIN sg USING (review_id) WHERE r.status = 'complete' AND NOT c UNION ALL SELECT r.review_id, 'status', 'provisional_without_pending' FROM r JOIN sg USING (review_id) WHERE r.status = 'provisional' AND NOT p
  UNION ALL SELECT r.review_id, 'status', 'blocked_without_reason' FROM r JOIN sg USING (review_id) WHERE r.status = 'blocked' AND NOT b
  UNION ALL SELECT review_id, 'next_stage', 'next_stage' FROM r WHERE next_stage <> CASE r.status WHEN 'complete' THEN 'learning_record_ready' WHEN 'provisional' THEN 'awaiting_market_milestones' ELSE 'comparison_blocked' END
  UNION ALL SELECT review_id, col, 'unresolved_reference' FROM (SELECT review_id, 'verifications' AS col, unnest(source_ids) AS id FROM vf UNION ALL SELECT review_id, 'numeric', source_id FROM nm UNION ALL SELECT review_id, 'guidance', source_id FROM gd UNION ALL SELECT review_id, 'stages', source_id FROM st) e WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.review_id = e.review_id AND so.record_id = e.id)
  UNION ALL SELECT review_id, 'verifications', 'not_a_pre_event_hypothesis' FROM vf WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.review_id = vf.review_id AND so.record_id = vf.hypothesis_id AND record_type = 'pre_event_hypothesis')
  UNION ALL SELECT review_id, 'invalidations', 'not_a_hypothesis_invalidation' FROM (SELECT review_id, unnest(invalidation_ids) AS id FROM vf) e WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.review_id = e.review_id AND so.record_id = e.id AND record_type = 'hypothesis_invalidation')
  UNION ALL SELECT st.review_id, 'stages', 'other_primary_source' FROM st WHERE source_id <> 'T-' || st.review_id UNION ALL SELECT review_id, 'verifications', 'uncited_source' FROM vf WHERE len(source_ids) < 2)
SELECT DISTINCT 'review' AS "table", i.review_id + 2 AS row_number, col AS "column", code FROM i""")
def review_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.review_contract(*_items(spark, sf_dir))
