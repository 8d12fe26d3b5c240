"""The stream with timers: planted gaps, activations and resolutions, restarts, and the batch twin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import calendar
from ledgerline.streaming import watch_stream as stream
from ledgerline.streaming.monitor_stream import run_to_table

MONDAY = dt.datetime(2026, 3, 2, 9)
HOUR = dt.timedelta(hours=1)


def at(hours):
    return MONDAY + hours * HOUR


#: (target, run, row, at, succeeded, fingerprint, error, etag)
RUNS = [
    (1, "a0", 0, at(0), True, "x", None, "e"), (1, "a1", 1, at(10), True, "y", None, "e"), (1, "a2", 2, at(20), False, None, "timeout", None), (1, "a3", 3, at(90), True, "y", None, "e"),  # stale between
    (2, "b0", 4, at(1), True, "x", None, None), (2, "b1", 5, at(2), True, "x", None, None),  # not its activation's run first
    (3, "c0", 6, at(3), True, "x", None, "e"), (3, "c1", 7, at(4), True, "x", None, "f"), (3, "c2", 8, at(200), False, None, "state_unavailable", None),
    (4, "d0", 9, at(5), True, "x", None, None), (5, "e0", 10, at(6), True, "x", None, None), (6, "f0", 11, at(300), True, "x", None, None),
]
RESOLUTIONS = [(1, "a1", at(12)), (1, "a1", at(13)), (1, "a0", at(14)), (3, "c9", at(5)), (9, "z", at(6))]
TARGETS = [
    (1, "activated", True, True, "human:a", 1, "a0", at(-5), None, False), (2, "activated", True, True, "human:a", 1, "b1", at(-5), None, False), (3, "activated", True, True, "human:a", 1, "c0", at(-5), None, True),
    (4, "draft", True, True, "human:a", 1, "d0", at(-5), None, False), (5, "activated", True, True, "human:a", 1, "e0", at(7), None, False), (6, "activated", True, True, "human:a", 1, "f0", at(-5), None, False),
]


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def prepared(spark):
    runs = spark.createDataFrame(RUNS, "target long, run_id string, row_number long, at timestamp, succeeded boolean, fingerprint string, error_code string, etag string")
    found = spark.createDataFrame(RESOLUTIONS, "target long, run_id string, resolved_at timestamp")
    targets = spark.createDataFrame(TARGETS, "target long, activation_state string, enabled boolean, access_permitted boolean, approved_by string, initialization_generation int, initialization_run_id string, activated_at timestamp, event_date date, event_required boolean")
    return stream.prepared(runs, found, targets)


def shown(df):
    return sorted(((r["target"], r["kind"], r["run_id"], r["at_ms"], r["result"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("cuts", [[], [at(9), at(11), at(50), at(250)]])
def test_stream_equals_its_twin_over_restarts(rocks, tmp_path, cuts):
    """Each piece is a run of the query of its own, from the state that the one before left."""
    rows = prepared(rocks)
    edges, source = [at(-100), *cuts, at(1000)], f"{tmp_path}/source"
    for low, high in zip(edges, edges[1:], strict=False):
        rows.filter((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high))).coalesce(1).write.mode("append").parquet(source)
        out = run_to_table(stream.watched(rocks.readStream.schema(rows.schema).parquet(source)), f"{tmp_path}/out", f"{tmp_path}/state")
    got, end = shown(out), int(at(300).timestamp() * 1000)
    assert got == shown(stream.expected(rows, F.lit(end)))
    by = {(t, run, kind): result for t, kind, run, _, result in got}
    assert [t for t, kind, *_ in got if kind == "stale"] == [1, 1, 2, 3]  # once a gap, by a row or by the timer
    assert by[2, "b0", "run"] == by[4, "d0", "run"] == by[5, "e0", "run"] == "not_activated" and by[2, "b1", "run"] == "initialized"
    results = [result for t, kind, run, _, result in got if (t, kind, run) == (1, "resolution", "a1")]
    assert sorted(results) == ["no_open_change", "resolved"] and by[9, "z", "resolution"] == "no_open_change"
    states = {(r["target"], r["run_id"]): r["state"] for r in out.filter("kind = 'run'").collect()}
    assert states[1, "a1"] == "pending_human_review" and states[1, "a2"] == "degraded" and states[3, "c2"] == "stopped"


def test_late_resolutions_are_refused(rocks, tmp_path):
    """A resolution that comes when the run after its time is done."""
    rows, source = prepared(rocks).filter("target = 1 and (kind = 'run' or run_id = 'a1')"), f"{tmp_path}/source"
    for part in (rows.filter("kind = 'run' and row_number < 3"), rows.filter("kind = 'resolution'")):
        part.coalesce(1).write.mode("append").parquet(source)
        out = run_to_table(stream.watched(rocks.readStream.schema(rows.schema).parquet(source), "60 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {r["result"] for r in out.filter("kind = 'resolution'").collect()} == {"outside_window"}


@pytest.mark.parametrize("day", [None, dt.date(2026, 3, 4), dt.date(2026, 3, 7), dt.date(2026, 3, 20)])
@pytest.mark.parametrize("required", [False, True])
def test_stale_from_is_where_staleness_begins(spark, day, required):
    starts = [MONDAY + dt.timedelta(hours=7 * k, minutes=13 * k) for k in range(24)]
    df = spark.createDataFrame([(s, day, required) for s in starts], "s timestamp, d date, r boolean").withColumn("ms", calendar.stale_from(F.col("s"), F.col("d"), F.col("r")))
    stale = lambda t: calendar.is_stale(F.col("s"), t, calendar.stale_window(t.cast("date"), F.col("d"), F.col("r")))
    after, before = F.timestamp_millis(F.col("ms") + 1000), F.timestamp_millis(F.col("ms") - 1000)
    assert [tuple(r) for r in df.select(stale(after).alias("a"), stale(before).alias("b")).distinct().collect()] == [(True, False)]
