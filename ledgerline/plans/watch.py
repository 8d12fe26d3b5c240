"""Registered queries: the monitor with activations, resolutions and stale failures, as a stream with timers and as its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import new_folder
from ..streaming import watch_stream as stream
from ..streaming.monitor_stream import run_to_table
from . import records
from .views import view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_DAY = "CASE WHEN target % 4 = 0 THEN NULL ELSE CAST(CAST(DATE '2024-01-10' AS TIMESTAMP) + INTERVAL '1' DAY * (target % 14) AS DATE) END"
_TARGETS = f"""SELECT target, CASE WHEN target % 17 = 5 THEN 'draft' ELSE 'activated' END AS activation_state, target % 19 <> 7 AS enabled, true AS access_permitted, CASE WHEN target % 23 = 9 THEN 'workflow:x' ELSE 'system_policy:p' END AS approved_by,
  1 AS initialization_generation, 'R-' || CAST(CASE WHEN target % 11 = 4 THEN last ELSE first END AS STRING) AS initialization_run_id, TIMESTAMP '2023-12-01 00:00:00' AS activated_at, {_DAY} AS event_date, target % 8 = 0 AS event_required
  FROM (SELECT user_id AS target, min(event_id) AS first, max(event_id) AS last FROM {{events}} GROUP BY user_id) g"""
_RESOLUTIONS = """SELECT user_id AS target, 'R-' || CAST(CASE WHEN event_id % 35 = 0 THEN event_id + 1 ELSE event_id END AS STRING) AS run_id, ts + CASE WHEN event_id % 25 = 0 THEN INTERVAL '-2' HOUR ELSE INTERVAL '3' HOUR END AS resolved_at FROM {events} WHERE event_id % 5 = 0"""


def _rows(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """What the stream reads; ``events`` may be one. Targets are static."""
    observed = spark.sql(records._OBS.format(sha="sha2(event_type, 256)", events="{events}"), events=events).withColumnRenamed("ts", "at").drop("document_id")
    targets = spark.sql(_TARGETS, events=view(spark, sf_dir, "events"))
    return stream.prepared(observed, spark.sql(_RESOLUTIONS, events=events), targets)


def _shown(df: DataFrame) -> DataFrame:
    run = F.col("kind") == "run"
    return df.select("target", "kind", "run_id", "at_ms", "result", F.when(run, F.col("version_after")).alias("version_after"), F.when(run, F.col("error_count")).alias("error_count"))


def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twin's rows from a stream over the events, into a table in the shared folder."""
    base, given = new_folder(spark, "watch"), view(spark, sf_dir, "events")
    alone = given.inputFiles()[0].endswith("/events.parquet")  # a stream reads folders
    source = spark.readStream.schema(given.schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else source.parquet(f"{sf_dir}/events.parquet")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        out = run_to_table(stream.watched(_rows(spark, sf_dir, events)), f"{base}/rows", f"{base}/state")
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return _shown(out)


def watch_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, view(spark, sf_dir, "events"))
    end = rows.agg(F.max(F.unix_millis("at")).alias("end")).first()["end"]  # one row: where the stream's watermark ends
    return _shown(stream.expected(rows, F.lit(end)))


def _sql() -> str:
    live = """WITH g AS (SELECT user_id AS target, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1),
 gate AS (SELECT target, CASE WHEN target % 17 = 5 OR target % 19 = 7 OR target % 23 = 9 THEN NULL WHEN target % 11 = 4 THEN last ELSE first END AS begins FROM g),
 seen_all AS ("""
    base = records._TRANSITIONS.replace("WITH obs AS (", live, 1).replace(",\n seen AS", ",\n obs AS (SELECT a.* FROM seen_all a JOIN gate USING (target) WHERE row_number >= begins),\n seen AS", 1)
    head, last = base.rsplit("SELECT run_id, target, result, vn", 1)
    window = """CASE WHEN event_date IS NULL AND event_required THEN 12 WHEN event_date = day THEN 12 WHEN day < event_date AND len(list_filter(generate_series(day::TIMESTAMP + INTERVAL 1 DAY, event_date::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) <= 5 THEN 24 ELSE 60 END"""
    return head.rstrip() + f""",
 done AS (SELECT run_id, target, result, vn{last}),
 dated AS (SELECT d.*, i.ts, i.row_number, i.succeeded AS good FROM done d JOIN res i USING (run_id)),
 ok AS (SELECT target, row_number, date_trunc('second', ts) AS s, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY target ORDER BY row_number) AS next_ms FROM dated WHERE good),
 days AS (SELECT ok.*, k, CAST(s AS DATE) + k::INT AS day, {_DAY} AS event_date, target % 8 = 0 AS event_required FROM ok, range(8) t(k)),
 lim AS (SELECT *, 3600 * ({window}) AS lim, isodow(day) < 6 AS work, CASE WHEN k = 0 THEN s ELSE day::TIMESTAMP END AS begins_at, CASE WHEN isodow(day) >= 6 THEN 0 WHEN k = 0 THEN epoch(day::TIMESTAMP + INTERVAL 1 DAY) - epoch(s) ELSE 86400 END::BIGINT AS secs FROM days),
 run_ AS (SELECT *, coalesce(sum(secs) OVER (PARTITION BY target, row_number ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM lim),
 due AS (SELECT target, row_number, any_value(next_ms) AS next_ms, min(CASE WHEN k > 0 AND e > lim THEN (epoch_us(begins_at) // 1000) - 1 WHEN work AND e + secs > lim AND e <= lim THEN (epoch_us(begins_at) // 1000) + (lim - e) * 1000 END)::BIGINT AS stale_ms FROM run_ GROUP BY 1, 2),
 resl AS ({_RESOLUTIONS.format(events='events')}),
 ends AS (SELECT target, max(t) AS last_ms FROM (SELECT user_id AS target, (epoch_us(ts) // 1000) AS t FROM events UNION ALL SELECT target, (epoch_us(resolved_at) // 1000) FROM resl) GROUP BY 1),
 fits AS (SELECT resl.target, resl.run_id, (epoch_us(resolved_at) // 1000) AS at_ms, (epoch_us(d.ts) // 1000) AS begun FROM resl LEFT JOIN dated d ON d.run_id = resl.run_id AND d.target = resl.target AND d.result = 'change_detected'),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY target, run_id ORDER BY coalesce(at_ms < begun, true), at_ms) AS n FROM fits)
SELECT target, 'run' AS kind, run_id, (epoch_us(ts) // 1000) AS at_ms, result, version_after, error_count FROM dated
UNION ALL SELECT target, 'run', 'R-' || event_id, (epoch_us(ts) // 1000), 'not_activated', 0, 0 FROM events JOIN gate ON gate.target = user_id WHERE begins IS NULL OR event_id < begins
UNION ALL SELECT due.target, 'stale', NULL, stale_ms, 'error', NULL, NULL FROM due JOIN ends USING (target) WHERE stale_ms < coalesce(next_ms, greatest(last_ms, (SELECT max(last_ms) FROM ends)))
UNION ALL SELECT target, 'resolution', run_id, at_ms, CASE WHEN at_ms >= begun AND n = 1 THEN 'resolved' ELSE 'no_open_change' END, NULL, NULL FROM ranked"""


QUERIES |= {"watch_stream": watch_stream, "watch_batch": watch_batch}
ORACLES |= {"watch_stream": _sql(), "watch_batch": _sql()}
