"""Registered queries: hashes, URLs, monitor runs, calendars, pages and notifications, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import calendar, hashing, text
from ..operators import monitor, observe
from ..sources.tables import dealt
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


# ---- hashes

_PLAIN = "regexp_replace(regexp_replace(CAST(CAST({c} AS DECIMAL(38, 10)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_HASH = f"sha256(to_json([['baseline_id', baseline_id], ['event_id', event_id], ['consensus_revenue', {_PLAIN.format(c='consensus_revenue')}], ['locked_at', strftime(locked_at, '%Y-%m-%dT%H:%M:%SZ')], ['supersedes', coalesce(supersedes, '')], ['v', CAST(v AS VARCHAR)], ['uses_post_event_data', CAST(uses_post_event_data AS VARCHAR)]]))"


def _record_hash() -> F.Column:
    kinds = {"baseline_id": "string", "event_id": "string", "consensus_revenue": "decimal", "locked_at": "datetime", "supersedes": "string", "v": "integer", "uses_post_event_data": "boolean"}
    return hashing.record_hash([(c, hashing.canonical(F.col(c), k)) for c, k in kinds.items()])


@query(f"SELECT baseline_id, {_HASH} AS record_hash FROM baseline", "event", "baseline")
def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "baseline").select("baseline_id", _record_hash().alias("record_hash"))


@query(f"WITH s AS (SELECT *, {_HASH} AS h FROM baseline), j AS (SELECT *, CASE WHEN k % 47 = 0 THEN md5(h) ELSE upper(h) END AS stored FROM s) " + rules_sql("pre_earnings_baseline", "j", [("record_hash", "hash_mismatch", "lower(stored) <> h")]), "event", "baseline")
def hash_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.issues import check

    stored = lambda h: F.when(F.col("k") % 47 == 0, F.md5(h)).otherwise(F.upper(h))
    rows = dealt(view(spark, sf_dir, "baseline"), "baseline_id")
    return check(rows, "pre_earnings_baseline", [("record_hash", "hash_mismatch", text.let(_record_hash(), lambda h: F.lower(stored(h)) != h))])


@query("SELECT n_nationkey, sha256(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey, 'region': {'r_name': r_name, 'r_regionkey': r_regionkey}})) AS json_hash FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def canonical_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = view(spark, sf_dir, "nation"), view(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").withColumn("region", F.struct("r_regionkey", "r_name"))
    return rows.select("n_nationkey", hashing.json_hash(rows, ["n_nationkey", "n_name", "n_regionkey", "region"]).alias("json_hash"))


@query("SELECT event_id, 'EE-' || substr(sha256(concat_ws('|', event_id, company_id)), 1, 16) AS evaluation_id FROM event", "event")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "event").select("event_id", hashing.short_id("EE-", [F.col("event_id"), F.col("company_id")]).alias("evaluation_id"))


_SUMS = "sha256(concat_ws(',', count(*)::VARCHAR, " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8)) + "))"


@query(f"""WITH o AS (SELECT o_custkey AS key, sha256(to_json({{'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}})) AS h FROM orders), c AS (SELECT c_custkey AS key, sha256(to_json({{'c_mktsegment': c_mktsegment, 'c_name': c_name}})) AS h FROM customer)
  SELECT key, 'orders' AS "table", count(*) AS rows, {_SUMS} AS content_hash FROM o GROUP BY 1 UNION ALL SELECT key, 'customer', count(*), {_SUMS} FROM c GROUP BY 1""")  # fmt: skip
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus")
    customer = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    return hashing.manifest({"orders": orders, "customer": customer}, "key")


# ---- pages

_URL = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$'"
_CANON = f"lower(regexp_extract(url, {_URL}, 1)) || '://' || lower(regexp_extract(url, {_URL}, 2)) || regexp_extract(url, {_URL}, 3) || regexp_extract(url, {_URL}, 4)"


@query(f"SELECT page_id, {_CANON} AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, sha256('[["source_url",' || to_json({_CANON}) || '],["title",' || coalesce(to_json(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')), 'null') || '],["document_id",' || to_json(CAST(page_id AS VARCHAR)) || '],["published_at",null],["stable_metadata",[["lang",' || to_json(regexp_extract(html, 'lang="([a-z]*)"', 1)) || '],["size","' || CAST(length(html) % 97 AS VARCHAR) || '"]]]]') AS fingerprint FROM pages""")
def metadata_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages")
    meta = F.create_map(F.lit("size"), (F.length("html") % 97).cast("string"), F.lit("lang"), F.regexp_extract("html", 'lang="([a-z]*)"', 1))
    return pages.select("page_id", hashing.metadata_fingerprint(text.canonical_url(F.col("url")), observe.page_title(F.col("html")), F.col("page_id").cast("string"), F.lit(None).cast("string"), meta).alias("fingerprint"))


@query()
def canonical_title_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages").select("page_id", text.canonical_title(observe.page_title(F.col("html"))).alias("title"))



_PROBLEM = """CASE WHEN u NOT LIKE '%://%' THEN 'malformed' WHEN lower(regexp_extract(u, '^([A-Za-z]+):', 1)) <> 'https' THEN 'not_https' WHEN regexp_extract(u, '://([^/?#]*)', 1) LIKE '%@%' THEN 'user_info'
  WHEN regexp_matches(regexp_extract(u, '://([^/?#]*)', 1), ':[0-9]+$') AND regexp_extract(u, '://([^/?#]*)', 1) NOT LIKE '%:443' THEN 'port' WHEN regexp_extract(u, '://([^/?#]*)', 1) LIKE '10.%' THEN 'private_host' WHEN regexp_matches(u, '[?&](token|key|secret|password)=') THEN 'secret_in_query' END"""
_PLANT = "CASE page_id % 11 WHEN 1 THEN replace(url, '://', '://me@') WHEN 2 THEN replace(url, '.com', '.com:8080') WHEN 3 THEN 'https://10.0.0.1/x' WHEN 4 THEN 'https://a.example.org/?token=1' WHEN 5 THEN 'nothing' ELSE url END"


@query(f"SELECT page_id, {_PROBLEM} AS problem FROM (SELECT page_id, {_PLANT} AS u FROM pages)")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages").select("page_id", text.url_problem(F.expr(_PLANT)).alias("problem"))


@query("""WITH p AS (SELECT page_id, page_id % 50 AS target, sha256(CASE WHEN page_id % 3 = 0 THEN url ELSE html END) AS digest, length(html) AS size FROM pages), w AS (SELECT *, lag(digest) OVER o AS d, lag(size) OVER o AS s FROM p WINDOW o AS (PARTITION BY target ORDER BY page_id))
  SELECT page_id, digest, d IS NOT NULL AND d <> digest AS changed, coalesce(s <> size, false) AS replacement_suspected FROM w""")  # fmt: skip
def page_digest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 50).alias("target"), F.sha2(F.expr("CASE WHEN page_id % 3 = 0 THEN url ELSE html END"), 256).alias("digest"), F.length("html").alias("size"))
    return observe.digest_changes(pages)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) IS NULL THEN 'unreadable' ELSE 'ok' END AS status FROM events")
def index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.json_fields(view(spark, sf_dir, "events"), "props", "k bigint").select("event_id", "k", F.when(F.col("k").isNull(), "unreadable").otherwise("ok").alias("status"))


@query("""SELECT event_id, CASE c WHEN 401 THEN 'authentication_required' WHEN 403 THEN 'authentication_required' WHEN 404 THEN 'source_unavailable' WHEN 408 THEN 'timeout' WHEN 429 THEN 'rate_limited' ELSE CASE WHEN c >= 500 THEN 'source_unavailable' END END AS error, c IN (408, 429) OR c >= 500 AS retryable
  FROM (SELECT event_id, 200 + event_id * 37 % 340 AS c FROM events)""")  # fmt: skip
def status_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("200 + event_id * 37 % 340")
    return view(spark, sf_dir, "events").select("event_id", observe.status_error(code).alias("error"), observe.is_retryable(code).alias("retryable"))


# ---- monitor

_OBS = "SELECT event_id AS row_number, user_id AS target, 'R-' || CAST(event_id AS STRING) AS run_id, ts, event_type <> 'error' AS succeeded, CASE WHEN event_type <> 'error' THEN {sha} END AS fingerprint, CASE WHEN event_type = 'error' THEN CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'state_unavailable' ELSE 'timeout' END END AS error_code, CAST(event_id % 61 AS STRING) AS document_id, CASE WHEN event_id % 3 <> 0 THEN 'e' || CAST(CAST(floor(event_id / 40) AS BIGINT) % 2 AS STRING) END AS etag, CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(floor(event_id / 90) AS BIGINT) % 2 AS STRING) END AS content_length FROM {events}"
_BEFORE = "(PARTITION BY target ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RUNS = f"""WITH obs AS ({_OBS.format(sha='sha256(event_type)', events='events')}),
 seen AS (SELECT *, last_value(CASE WHEN succeeded THEN struct_pack(f := fingerprint, e := etag, l := content_length, d := document_id) END IGNORE NULLS) OVER {_BEFORE} AS old FROM obs),
 tr AS (SELECT * EXCLUDE (old), old.f AS fb, old.e AS oe, old.l AS ol, old.d AS od, row_number() OVER (PARTITION BY target ORDER BY row_number) AS vn, lag(run_id) OVER (PARTITION BY target ORDER BY row_number) AS last_id FROM seen),
 res AS (SELECT * REPLACE (CASE WHEN NOT succeeded THEN error_code WHEN ambiguous THEN 'content_ambiguous' END AS error_code, CASE WHEN NOT succeeded OR ambiguous THEN 'error' WHEN fb IS NULL THEN 'initialized' WHEN fb = fingerprint THEN 'no_change' ELSE 'change_detected' END AS result, succeeded AND NOT ambiguous AS succeeded) FROM (SELECT *, '' AS result, coalesce(succeeded AND fb = fingerprint AND ((oe IS NOT NULL AND oe IS DISTINCT FROM etag) OR (ol IS NOT NULL AND ol IS DISTINCT FROM content_length)), false) AS ambiguous FROM tr)),
 runs AS (SELECT row_number, target, run_id, result, succeeded, error_code, true AS committed, ts - CASE WHEN row_number % 67 = 0 THEN INTERVAL '10' DAY ELSE INTERVAL '0' DAY END AS started_at, ts + INTERVAL '1' SECOND AS finished_at, CASE WHEN error_code IS NULL THEN fingerprint END AS fingerprint_after,
   CASE WHEN row_number % 107 = 0 THEN 'bad' ELSE fb END AS fingerprint_before, vn + CASE WHEN row_number % 103 = 0 THEN 1 ELSE 0 END AS version_after, CASE WHEN row_number % 101 = 0 THEN 'R-x' ELSE last_id END AS previous_run_id FROM res),
 resol AS (SELECT row_number, CASE WHEN row_number % 37 = 0 THEN 'R-none' ELSE run_id END AS run_id, target + CASE WHEN row_number % 31 = 0 THEN 1 ELSE 0 END AS target, finished_at + CASE WHEN row_number % 29 = 0 THEN INTERVAL '-1' HOUR ELSE INTERVAL '1' HOUR END AS resolved_at FROM runs WHERE row_number % 3 = 0 AND result IN ('change_detected', 'no_change') AND (result = 'change_detected' OR row_number % 5 = 0))"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_OBS.format(sha="sha2(event_type, 256)", events="{events}"), events=view(spark, sf_dir, "events"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = monitor.transitions(_observations(spark, sf_dir)).withColumn("last_id", F.lag("run_id").over(Window.partitionBy("target").orderBy("row_number")))
    return rows.selectExpr(
        "row_number", "target", "run_id", "result", "error IS NULL AS succeeded", "error AS error_code", "true AS committed", "ts - CASE WHEN row_number % 67 = 0 THEN INTERVAL '10' DAY ELSE INTERVAL '0' DAY END AS started_at",
        "ts + INTERVAL '1' SECOND AS finished_at", "CASE WHEN error IS NULL THEN fingerprint END AS fingerprint_after", "CASE WHEN row_number % 107 = 0 THEN 'bad' ELSE fingerprint_before END AS fingerprint_before",
        "version_after + CASE WHEN row_number % 103 = 0 THEN 1 ELSE 0 END AS version_after", "CASE WHEN row_number % 101 = 0 THEN 'R-x' ELSE last_id END AS previous_run_id",
    )


def _resolutions(runs: DataFrame) -> DataFrame:
    some = runs.filter("row_number % 3 = 0 AND result IN ('change_detected', 'no_change') AND (result = 'change_detected' OR row_number % 5 = 0)")
    return some.selectExpr("row_number", "CASE WHEN row_number % 37 = 0 THEN 'R-none' ELSE run_id END AS run_id", "target + CASE WHEN row_number % 31 = 0 THEN 1 ELSE 0 END AS target", "finished_at + CASE WHEN row_number % 29 = 0 THEN INTERVAL '-1' HOUR ELSE INTERVAL '1' HOUR END AS resolved_at")


@query(_RUNS + f""", w AS (SELECT *, lag(run_id) OVER (PARTITION BY target ORDER BY row_number) AS li, lag(finished_at) OVER (PARTITION BY target ORDER BY row_number) AS le, last_value(CASE WHEN succeeded THEN fingerprint_after END IGNORE NULLS) OVER {_BEFORE} AS lf, coalesce(last_value(version_after) OVER {_BEFORE}, 0) AS lv FROM runs) """
       + rules_sql("monitor_run", "w", [("previous_run_id", "not_previous", "previous_run_id IS DISTINCT FROM li"), ("started_at", "overlap", "started_at < le"), ("result", "first_not_initialized", "li IS NULL AND result <> 'initialized'"), ("result", "initialized_again", "li IS NOT NULL AND result = 'initialized'"),
           ("fingerprint_before", "fingerprint_gap", "fingerprint_before IS DISTINCT FROM lf"), ("version_after", "version_gap", "version_after <> lv + 1")]))
def monitor_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_lineage(_runs(spark, sf_dir))


_STATE = ", st AS (SELECT target, arg_max(version_after, row_number) AS version, arg_max(run_id, row_number) AS last_run_id, arg_max(fingerprint_after, CASE WHEN succeeded THEN row_number END) AS fingerprint, arg_max(coalesce(error_code, ''), row_number) AS error_code, arg_max(finished_at, CASE WHEN succeeded THEN row_number END) AS last_success_at FROM runs GROUP BY 1)"


@query(_RUNS + _STATE + " SELECT target, version, last_run_id, fingerprint, error_code FROM st")
def monitor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.replay(_runs(spark, sf_dir)).select("target", "version", "last_run_id", "fingerprint", F.coalesce("error_code", F.lit("")).alias("error_code"))


_CHECKPOINT = "target + CASE WHEN target % 13 = 0 THEN 100000 ELSE 0 END AS target, version + CASE WHEN target % 5 = 0 THEN 1 ELSE 0 END AS version, last_run_id, CASE WHEN target % 7 = 0 THEN 'old' ELSE fingerprint END AS fingerprint"


@query(_RUNS + _STATE + f""", cp AS (SELECT {_CHECKPOINT} FROM st), j AS (SELECT coalesce(cp.target, st.target) AS target, CASE WHEN st.target IS NULL THEN ['no_runs'] WHEN cp.target IS NULL THEN ['no_checkpoint'] ELSE
   list_filter([CASE WHEN cp.version IS DISTINCT FROM st.version THEN 'version' END, CASE WHEN cp.last_run_id IS DISTINCT FROM st.last_run_id THEN 'last_run_id' END, CASE WHEN cp.fingerprint IS DISTINCT FROM st.fingerprint THEN 'fingerprint' END], lambda x: x IS NOT NULL) END AS d FROM cp FULL JOIN st ON cp.target = st.target)
   SELECT target, unnest(d) AS difference FROM j""")  # fmt: skip
def checkpoint_vs_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = monitor.replay(_runs(spark, sf_dir))
    return monitor.checkpoint_differences(state.selectExpr(*_CHECKPOINT.replace("target + CASE", "target + CASE").split(", ")), state, ["version", "last_run_id", "fingerprint"])


_OPEN = ", op AS (SELECT * FROM runs WHERE result = 'change_detected' AND run_id NOT IN (SELECT run_id FROM resol)), un AS (SELECT target, count(*) AS n_open, arg_min(run_id, row_number) AS first_run_id, arg_max(run_id, row_number) AS pending_run_id FROM op GROUP BY 1)"


@query(_RUNS + _OPEN + " SELECT * FROM un")
def pending_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return monitor.unresolved_changes(runs, _resolutions(runs))


_EPISODE = """, lc AS (SELECT target, arg_max(coalesce(error_code, ''), row_number) AS code FROM runs GROUP BY 1), ed AS (SELECT runs.target, max(CASE WHEN coalesce(error_code, '') <> code THEN row_number END) AS edge FROM runs JOIN lc ON runs.target = lc.target GROUP BY 1),
 ep AS (SELECT runs.target, code, count(*) AS length, arg_min(run_id, row_number) AS episode_id FROM runs JOIN lc ON runs.target = lc.target JOIN ed ON runs.target = ed.target WHERE code <> '' AND (edge IS NULL OR row_number > edge) GROUP BY 1, 2)"""


@query(_RUNS + _EPISODE + " SELECT * FROM ep")
def error_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.error_episodes(_runs(spark, sf_dir))


@query(_RUNS + ", j AS (SELECT resol.*, r.target AS rt, r.result AS rr, r.finished_at AS rf FROM resol LEFT JOIN runs r ON resol.run_id = r.run_id) " + rules_sql("monitor_resolution", "j", [("run_id", "missing_run", "rt IS NULL"), ("run_id", "not_a_change", "rr <> 'change_detected'"), ("run_id", "other_target", "rt <> target"), ("resolved_at", "before_run", "resolved_at < rf")]))
def resolution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return monitor.resolution_rules(_resolutions(runs), runs)


_TRANSITIONS = _RUNS + """, n AS (SELECT *, CASE WHEN coalesce(error_code, '') <> coalesce(lag(error_code) OVER (PARTITION BY target ORDER BY row_number), '') THEN 1 ELSE 0 END AS fresh FROM res), i AS (SELECT *, sum(fresh) OVER (PARTITION BY target ORDER BY row_number ROWS UNBOUNDED PRECEDING) AS island, max(CASE WHEN result = 'change_detected' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY row_number ROWS UNBOUNDED PRECEDING) AS pend FROM n)
  SELECT run_id, target, result, vn AS version_after, CASE WHEN error_code IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY target, island ORDER BY row_number) END AS error_count, CASE WHEN error_code IN ('state_unavailable', 'persistence_error') THEN 'stopped' WHEN pend = 1 THEN 'pending_human_review' WHEN error_code IS NOT NULL THEN 'degraded' ELSE 'healthy' END AS state, error_code AS error,
   CASE WHEN result = 'change_detected' THEN 'Changed metadata fields: ' || CASE WHEN od IS DISTINCT FROM document_id THEN 'document_id' ELSE 'stable_metadata' END END AS summary, CASE (etag IS NOT NULL)::INT + (content_length IS NOT NULL)::INT WHEN 2 THEN 'available' WHEN 1 THEN 'partial' ELSE 'unavailable' END AS replacement_detection FROM i"""


@query(_TRANSITIONS)
def transition_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.transitions(_observations(spark, sf_dir)).select("run_id", "target", "result", "version_after", "error_count", "state", "error", "summary", "replacement_detection")


@query(_RUNS + """, s AS (SELECT target, version_after % 50 AS version, row_number % 2 AS attempt FROM runs), t AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY version DESC, attempt DESC) AS r FROM s) SELECT target, version, attempt, count(*) AS ties FROM t WHERE r = 1 GROUP BY 1, 2, 3""")
def current_state_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.current_state(_runs(spark, sf_dir).selectExpr("target", "version_after % 50 AS version", "row_number % 2 AS attempt"))


@query(_RUNS + ", l AS (SELECT target, arg_max(run_id, row_number) AS run_id, arg_max(result, row_number) AS result FROM runs GROUP BY 1) SELECT target, run_id FROM l WHERE result = 'change_detected' AND target % 2 = 0")
def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return monitor.handoffs(runs, runs.select("target").distinct().withColumn("autonomous", F.col("target") % 2 == 0)).select("target", "run_id")


_PLAN = _OPEN + _EPISODE + """, l AS (SELECT target, arg_max(run_id, row_number) AS run_id, arg_max(result, row_number) AS result FROM runs GROUP BY 1),
 pl AS (SELECT l.target, run_id, result, 'N-' || substr(sha256(concat_ws('|', CAST(l.target AS VARCHAR), result, CASE WHEN result = 'change_detected' THEN first_run_id ELSE episode_id END)), 1, 24) AS dedup_key FROM l LEFT JOIN un ON l.target = un.target LEFT JOIN ep ON l.target = ep.target WHERE result IN ('change_detected', 'error'))"""


@query(_RUNS + _PLAN + " SELECT * FROM pl")
def notification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return monitor.notification_plan(runs, _resolutions(runs))


@query(_RUNS + _PLAN + ", oi AS (SELECT dedup_key FROM pl WHERE target % 3 = 0 UNION ALL SELECT dedup_key FROM pl WHERE target % 6 = 0) SELECT target, dedup_key, CASE n WHEN 0 THEN 'create' WHEN 1 THEN 'append' ELSE 'ambiguous' END AS action FROM (SELECT target, pl.dedup_key, (SELECT count(*) FROM oi WHERE oi.dedup_key = pl.dedup_key) AS n FROM pl)")
def notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    plan = monitor.notification_plan(runs, _resolutions(runs))
    open_ = plan.filter("target % 3 = 0").select("dedup_key").union(plan.filter("target % 6 = 0").select("dedup_key"))
    return monitor.outbox(plan, open_).select("target", "dedup_key", "action")


@query("""WITH f AS (SELECT user_id AS target, CAST(CAST(ts + INTERVAL '9' HOUR AS DATE) AS VARCHAR) AS day, CASE WHEN value > 50 THEN 'no_bundle' ELSE 'timeout' END AS reason FROM events WHERE event_type = 'error')
  SELECT target, day, reason, 'F-' || substr(sha256(concat_ws('|', CAST(target AS VARCHAR), day, reason)), 1, 24) AS dedup_key, count(*) AS failures FROM f GROUP BY 1, 2, 3, 4""")  # fmt: skip
def failure_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr("user_id AS target", "ts AS occurred_at", "CASE WHEN value > 50 THEN 'no_bundle' ELSE 'timeout' END AS reason")
    return monitor.failure_plan(rows)


# ---- calendar

_SPAN = "CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_orderkey % 40 - 5) AS DATE) AS b"


@query(f"SELECT o_orderkey, CASE WHEN b > a THEN len(list_filter(generate_series(a + INTERVAL 1 DAY, b::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) ELSE 0 END::BIGINT AS n FROM (SELECT o_orderkey, {_SPAN} FROM orders)")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders").selectExpr("o_orderkey", *_SPAN.split(", ", 1)).select("o_orderkey", calendar.business_days_until(F.col("a"), F.col("b")).alias("n"))


@query("""WITH s AS (SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) + INTERVAL 1 HOUR * (event_id % 300 - 20) AS b FROM events)
  SELECT event_id, CASE WHEN b > a THEN list_sum(list_transform(generate_series(date_trunc('day', a), b, INTERVAL 1 DAY), lambda x: CASE WHEN isodow(x) < 6 THEN greatest(0, epoch(least(b, x + INTERVAL 1 DAY)) - epoch(greatest(a, x))) ELSE 0 END)) ELSE 0 END::BIGINT AS seconds FROM s""")  # fmt: skip
def business_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.expr("a + INTERVAL '1' HOUR * (event_id % 300 - 20)"))
    return rows.select("event_id", calendar.business_seconds(F.col("a"), F.col("b")).alias("seconds"))


_NOW = "TIMESTAMP '2024-02-05 12:00:00'"
_BIZ = "coalesce(list_sum(list_transform(generate_series(date_trunc('day', s), now, INTERVAL 1 DAY), lambda x: CASE WHEN isodow(x) < 6 THEN greatest(0, epoch(least(now, x + INTERVAL 1 DAY)) - epoch(greatest(s, x))) ELSE 0 END)), 0)"
_EVENT_DAY = "CASE WHEN target % 4 = 0 THEN NULL ELSE CAST(CAST(DATE '2024-02-02' AS TIMESTAMP) + INTERVAL '1' DAY * (target % 14) AS DATE) END"


def _stale_sql(at: str) -> str:
    return f""", b AS (SELECT target, {at} AS s, {_NOW} AS now, {_EVENT_DAY} AS d, target % 8 = 0 AS required FROM st), w AS (SELECT *, CASE WHEN d IS NULL AND required THEN 'event_day' WHEN d = DATE '2024-02-05' THEN 'event_day' WHEN d > DATE '2024-02-05' AND len(list_filter(generate_series(DATE '2024-02-06', d::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) <= 5 THEN 'event_window' ELSE 'normal' END AS win FROM b)
      SELECT target, win AS "window", s IS NULL OR {_BIZ} > 3600 * CASE win WHEN 'event_day' THEN 12 WHEN 'event_window' THEN 24 ELSE 60 END AS stale FROM w"""


def _stale(rows: DataFrame) -> DataFrame:
    now = F.expr(_NOW)
    rows = rows.withColumn("window", calendar.stale_window(now.cast("date"), F.expr(_EVENT_DAY), F.expr("target % 8 = 0")))
    return rows.select("target", "window", calendar.is_stale(F.col("s"), now, F.col("window")).alias("stale"))


@query(_RUNS + _STATE + _stale_sql("date_trunc('second', last_success_at) + INTERVAL 1 HOUR * (target % 150)"))
def stale_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = monitor.replay(_runs(spark, sf_dir))
    return _stale(state.withColumn("s", F.expr("date_trunc('second', CAST(last_success_at AS TIMESTAMP)) + INTERVAL '1' HOUR * (target % 150)")))


@query(_RUNS + _STATE + """, g AS (SELECT target, max(finished_at + INTERVAL '4' DAY) AS gap_end FROM runs WHERE row_number % 9 = 0 AND row_number NOT IN (SELECT row_number - 9 FROM runs WHERE row_number % 27 = 0) GROUP BY 1)
  SELECT st.target, epoch(date_trunc('second', greatest(last_success_at, gap_end)))::BIGINT AS reference_s FROM st LEFT JOIN g ON st.target = g.target""")  # fmt: skip
def stale_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    acks = runs.filter("row_number % 9 = 0").selectExpr("row_number AS ack_id", "CASE WHEN row_number % 27 = 0 THEN row_number - 9 END AS supersedes", "target", "finished_at + INTERVAL '4' DAY AS gap_end")
    return monitor_reference(monitor.replay(runs), acks).select("target", F.unix_timestamp(F.date_trunc("second", F.col("reference").cast("timestamp"))).alias("reference_s"))


def monitor_reference(state: DataFrame, acks: DataFrame) -> DataFrame:
    return observe.stale_reference(state, acks)


@query(_RUNS + f""", t AS (SELECT DISTINCT target, TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 1 HOUR * (target * 5 + 9) AS now, {_EVENT_DAY} AS d FROM runs)
  SELECT target, isodow(now) < 6 AND (coalesce(d = now::DATE OR (d > now::DATE AND len(list_filter(generate_series(now::DATE + INTERVAL 1 DAY, d::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) <= 5), false) OR hour(now) BETWEEN 17 AND 20) AS due FROM t""")  # fmt: skip
def due_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "events").select(F.col("user_id").alias("target")).distinct().withColumn("now", F.expr("TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' HOUR * (target * 5)"))
    return rows.select("target", calendar.is_due(F.col("now"), F.expr(_EVENT_DAY)).alias("due"))


_SCHEDULE = "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), '=first quarter 2099-01-01;2024-05-中旬=later | ', CAST(CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_orderkey % 90) AS DATE) AS STRING), '=second;2099-02-31=never')"


@query(f"SELECT o_orderkey, CAST(list_min(list_filter(list_transform(list_filter(list_transform(string_split(replace(s, '|', ';'), ';'), lambda e: trim(split_part(e, '=', 1))), lambda e: regexp_full_match(e, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')), lambda x: try_cast(x AS DATE)), lambda x: x >= a)) AS VARCHAR) AS next_day FROM (SELECT o_orderkey, {_SCHEDULE} AS s, CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_orderkey % 60) AS DATE) AS a FROM orders)")
def next_announcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SCHEDULE} AS s", "CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * (o_orderkey % 60) AS DATE) AS a")
    return rows.select("o_orderkey", calendar.next_date(F.col("s"), F.col("a")).cast("string").alias("next_day"))
