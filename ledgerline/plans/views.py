"""Domain tables as views over the star tables, in SQL that Spark and DuckDB both run.

The given tables hold no research records, so each is derived by key arithmetic, which also
plants violations. The views are inputs; the operators over them are written once in DataFrame
functions and, for the oracle, once in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "company": "SELECT 'CMP-' || CAST(c_custkey AS STRING) AS company_id, c_custkey + 2 AS row_number, lpad(CAST(c_custkey AS STRING), 4, '0') AS ticker, c_mktsegment AS exchange, c_name AS name FROM customer",
    "event": """SELECT 'EVT-' || CAST(o_orderkey AS STRING) AS event_id, o_orderkey AS k, o_orderkey + 2 AS row_number, 'CMP-' || CAST(o_custkey AS STRING) AS company_id, o_custkey,
        o_orderstatus AS st, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS announced_on,
        CASE o_orderkey % 3 WHEN 0 THEN 'before_open' WHEN 1 THEN 'intraday' ELSE 'after_close' END AS session,
        CAST(o_orderdate AS TIMESTAMP) + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '480' MINUTE WHEN 1 THEN INTERVAL '750' MINUTE ELSE INTERVAL '960' MINUTE END AS scheduled_at,
        CAST(year(o_orderdate) AS BIGINT) AS fy, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders""",
    "status": """SELECT 'S1-' || CAST(k AS STRING) AS status_id, event_id, k, k * 4 + 2 AS row_number, 'scheduled' AS status, CAST(NULL AS STRING) AS supersedes,
          scheduled_at - INTERVAL '30' DAY AS recorded_at, scheduled_at, CAST(NULL AS TIMESTAMP) AS occurred_at FROM event
        UNION ALL SELECT 'S2-' || CAST(k AS STRING), event_id, k, k * 4 + 3, 'postponed', CASE WHEN k % 97 = 0 THEN 'S1-' || CAST(k + 1 AS STRING) ELSE 'S1-' || CAST(k AS STRING) END,
          scheduled_at - INTERVAL '2' DAY, scheduled_at + CASE WHEN k % 31 = 0 THEN INTERVAL '-1' DAY ELSE INTERVAL '1' DAY END, CAST(NULL AS TIMESTAMP) FROM event WHERE st = 'P'
        UNION ALL SELECT 'S3-' || CAST(k AS STRING), event_id, k, k * 4 + 4, CASE WHEN st = 'O' THEN 'cancelled' ELSE 'occurred' END,
          CASE WHEN k % 89 = 0 THEN 'S9-' || CAST(k AS STRING) WHEN k % 83 = 0 THEN 'S3-' || CAST(k AS STRING) WHEN st = 'P' AND k % 2 = 0 THEN 'S2-' || CAST(k AS STRING) ELSE 'S1-' || CAST(k AS STRING) END,
          scheduled_at + INTERVAL '1' HOUR, scheduled_at, CASE WHEN st = 'O' THEN CAST(NULL AS TIMESTAMP) ELSE scheduled_at + INTERVAL '5' MINUTE END FROM event WHERE st IN ('F', 'P') OR k % 5 = 0""",
    "baseline": """SELECT 'B' || CAST(v AS STRING) || '-' || CAST(k AS STRING) AS baseline_id, event_id, k, k * 3 + v AS row_number, v,
          CASE WHEN k % 53 = 0 THEN 'version' || CAST(v AS STRING) WHEN k % 59 = 0 AND v = 2 THEN 'v1' ELSE 'v' || CAST(v AS STRING) END AS version,
          CASE WHEN k % 7 = 0 AND v = 1 THEN 'draft' ELSE 'locked' END AS baseline_status,
          CASE WHEN k % 7 = 0 AND v = 1 THEN 'pending' WHEN k % 61 = 0 THEN 'rejected' ELSE 'approved' END AS review_status,
          CASE WHEN v = 2 THEN 'B1-' || CAST(k AS STRING) END AS supersedes,
          CASE WHEN k % 41 = 0 THEN 'sv9' ELSE 'sv' || CAST(k % 3 AS STRING) END AS scoring_version, k % 37 = 0 AS uses_post_event_data,
          CAST(o_totalprice * (90 + k % 21) / 100 AS DECIMAL(18, 4)) AS consensus_revenue, CAST(o_totalprice * (80 + k % 11) / 100 AS DECIMAL(18, 4)) AS guidance_revenue,
          scheduled_at - INTERVAL '1' HOUR * (1 + k % 5) + CASE WHEN k % 50 = 0 THEN INTERVAL '7' HOUR ELSE INTERVAL '0' HOUR END AS locked_at,
          scheduled_at - INTERVAL '8' HOUR + CASE WHEN k % 43 = 0 THEN INTERVAL '9' HOUR ELSE INTERVAL '0' HOUR END AS as_of,
          scheduled_at - INTERVAL '7' HOUR AS recorded_at
        FROM (SELECT *, 1 AS v FROM event UNION ALL SELECT *, 2 AS v FROM event WHERE k % 4 = 0) e""",
    "review": """SELECT 'R-' || CAST(k AS STRING) AS review_id, event_id, k, k + 2 AS row_number, 'B1-' || CAST(CASE WHEN k % 71 = 0 THEN k + 1 WHEN k % 73 = 0 THEN k + 10000000 ELSE k END AS STRING) AS baseline_id,
          scheduled_at + INTERVAL '2' HOUR - CASE WHEN k % 33 = 0 THEN INTERVAL '5' HOUR ELSE INTERVAL '0' HOUR END AS recorded_at,
          CASE WHEN k % 3 = 0 THEN 'NO_TRADE' WHEN k % 3 = 1 THEN 'LONG' ELSE 'SHORT' END AS decision,
          CASE WHEN k % 3 <> 0 OR k % 45 = 0 THEN CAST(o_totalprice AS DECIMAL(18, 4)) END AS entry_price,
          CASE WHEN k % 3 <> 0 AND k % 29 <> 0 THEN CAST(o_totalprice * (95 + k % 11) / 100 AS DECIMAL(18, 4)) END AS stop_price,
          CASE WHEN k % 3 <> 0 THEN CAST(o_totalprice * (97 + k % 13) / 100 AS DECIMAL(18, 4)) END AS target_price,
          CASE WHEN k % 2 = 0 THEN CAST(k % 9 AS DOUBLE) END AS return_1d, CASE WHEN k % 10 = 0 THEN CAST(k % 7 AS DOUBLE) END AS return_5d,
          CASE WHEN k % 4 < 3 THEN CAST(o_totalprice AS DOUBLE) END AS price_before, CASE WHEN k % 6 <> 2 THEN CAST(o_totalprice AS DOUBLE) END AS price_after, CASE WHEN k % 8 <> 4 THEN 'XTKS' END AS price_source
        FROM event WHERE st IN ('F', 'P')""",
    "evidence": """SELECT 'EV-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS evidence_id, l_orderkey * 8 + l_linenumber AS row_number, l_orderkey AS k, l_linenumber AS n,
          CASE l_linenumber % 4 WHEN 0 THEN 'earnings_event' WHEN 1 THEN 'pre_earnings_baseline' WHEN 2 THEN 'pre_note' ELSE 'company_master' END AS entity_type,
          CASE l_linenumber % 4 WHEN 0 THEN 'EVT-' || CAST(l_orderkey AS STRING) WHEN 1 THEN 'B' || CAST(1 + l_partkey % 2 AS STRING) || '-' || CAST(l_orderkey AS STRING) WHEN 2 THEN 'EVT-' || CAST(l_orderkey + CASE WHEN l_partkey % 19 = 0 THEN 10000000 ELSE 0 END AS STRING) ELSE 'CMP-' || CAST(l_partkey AS STRING) END AS entity_id,
          l_suppkey % 3 <> 0 AS used_for_score, CASE l_suppkey % 7 WHEN 0 THEN 'actual_result' ELSE 'consensus' END AS component,
          CAST(l_shipdate AS TIMESTAMP) AS shipped, CAST(l_quantity AS BIGINT) AS qty, l_partkey, l_suppkey,
          CASE WHEN l_suppkey % 5 = 0 THEN 'stored' WHEN l_suppkey % 5 = 1 THEN 'not_stored' END AS storage_status,
          CASE WHEN l_suppkey % 5 < 2 AND l_partkey % 11 <> 0 THEN 'permitted' END AS licence_status,
          CASE WHEN l_suppkey % 5 = 0 AND l_partkey % 13 <> 0 THEN 's3://x/' || CAST(l_orderkey AS STRING) END AS location,
          CASE WHEN l_suppkey % 5 = 0 THEN 'verified' WHEN l_suppkey % 5 = 1 AND l_partkey % 3 = 0 THEN 'mismatch' WHEN l_suppkey % 5 = 1 THEN 'not_recorded' END AS hash_status,
          CASE WHEN l_suppkey % 5 = 0 AND l_partkey % 17 <> 0 THEN sha2(CAST(l_partkey AS STRING), 256) WHEN l_suppkey % 5 = 0 THEN 'zz' WHEN l_partkey % 23 = 0 THEN 'ab' END AS content_hash
        FROM lineitem""",
    "actual": "SELECT l_orderkey AS k, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DECIMAL(18, 4)) AS revenue, CAST(sum(CAST(l_extendedprice * (1 - l_discount) - l_extendedprice * l_tax * 8 AS DECIMAL(18, 4))) AS DECIMAL(18, 4)) AS profit, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "run": """SELECT event_id AS run_no, user_id AS target, ts, event_type, value, props, event_type <> 'error' AS succeeded,
          CASE WHEN event_type <> 'error' THEN sha2(event_type, 256) END AS fingerprint, 'E' || CAST(CAST(floor(value) AS BIGINT) % 2 AS STRING) AS error_code FROM events""",
    "price": "SELECT user_id AS ticker, event_id AS price_id, ts, CAST(value AS DOUBLE) AS price FROM events",
    "announcement": "SELECT user_id AS ticker, event_id AS announcement_id, ts AS announced_at, CASE WHEN hour(ts) < 9 THEN 'before_open' WHEN hour(ts) < 15 THEN 'intraday' ELSE 'after_close' END AS session, event_id % 29 = 0 AS corporate_action FROM events WHERE event_type = 'purchase'",
    "hypothesis": "SELECT conv_id * 1000 + turn AS row_number, conv_id, turn, 'H-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS hypothesis_id, CASE WHEN turn > 0 THEN 'H-' || CAST(conv_id AS STRING) || '-' || CAST(turn - CASE WHEN conv_id % 7 = 3 THEN 2 ELSE 1 END AS STRING) END AS parent_id, role, text FROM conversations",
}
#: What each view reads: tables and earlier views.
NEEDS = {"status": ["event"], "baseline": ["event"], "review": ["event"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    known = {*TABLES, *VIEWS}
    used = {t for t in re.findall(r"FROM (\w+)", VIEWS[name]) if t in known}
    sql = re.sub(r"FROM (\w+)", lambda m: f"FROM {{{m[1]}}}" if m[1] in known else m[0], VIEWS[name])
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in used})


def duck(name: str) -> str:
    """The view's body in DuckDB's names of functions."""
    return VIEWS[name].replace("sha2(CAST(l_partkey AS STRING), 256)", "sha256(CAST(l_partkey AS STRING))").replace("sha2(event_type, 256)", "sha256(event_type)")


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the views it names as common table expressions."""
    order = [n for n in VIEWS if n in {*names, *(x for m in names for x in NEEDS.get(m, []))}]
    ctes = ", ".join(f"{n} AS ({duck(n)})" for n in order)
    return f"WITH {ctes}, {sql.strip().removeprefix('WITH ')}" if sql.strip().startswith("WITH ") else f"WITH {ctes} {sql}"
