"""The monitor as a stream with timers: runs, resolutions of changes, and a failure when no run comes in time.

State per target: the page last read, version, error and its count, the open changes, and when the target becomes stale, for which an event-time
timer stands. A target's first run must be the one that its activation names; until then its runs are rejected. A resolution must name an
open change, come after that run and before the next one. A stale failure is told once for each gap, by the timer or by the row
that comes after the gap, whichever is first; so a source in the order of its times may be cut into batches anywhere. A resolution that comes when a
later run is done is refused.

``expected`` is the batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import calendar
from ..operators import monitor
from ..operators.rowchecks import is_authorizer

ROWS = "target long, kind string, run_id string, row_number long, at_ms long, succeeded boolean, fingerprint string, error_code string, marks array<string>, stale_ms long, may_start boolean"
OUT = "target long, kind string, run_id string, at_ms long, result string, version_after long, error_count long, state string"
#: Version 1 of the state: what ``_Target`` keeps in one value.
STATE = "row_number long, at_ms long, fingerprint string, marks array<string>, read boolean, version long, error string, count long, stale_ms long, told boolean"


def activated(run_id: Column, started_at: Column) -> Column:
    """Whether a target's activation lets this run be its first. The target's columns: activation_state, enabled, access_permitted,
    approved_by, initialization_generation, initialization_run_id, activated_at."""
    return F.coalesce(
        (F.col("activation_state") == "activated") & F.col("enabled") & F.col("access_permitted") & is_authorizer(F.col("approved_by"))
        & (F.col("initialization_generation") == 1) & (F.col("initialization_run_id") == run_id) & (F.col("activated_at") <= started_at), F.lit(False),
    )


def prepared(observations: DataFrame, resolutions: DataFrame, targets: DataFrame) -> DataFrame:
    """One table of rows, or one stream: observations (target, run_id, row_number, at, succeeded, fingerprint, error_code, indicators) joined with the
    static table of targets (what ``activated`` reads, event_date, event_required), and resolutions (target, run_id, resolved_at)."""
    marks = [F.col(c).cast("string") for c in monitor.INDICATORS if c in observations.columns]
    joined = observations.join(targets, "target", "left")
    stale = F.when(F.col("succeeded"), calendar.stale_from(F.col("at"), F.col("event_date"), F.coalesce(F.col("event_required"), F.lit(False))))
    runs = joined.select(
        "target", F.lit("run").alias("kind"), "run_id", "row_number", F.col("at").cast("timestamp").alias("at"), "succeeded", "fingerprint", "error_code", F.array(*marks).cast("array<string>").alias("marks"), stale.alias("stale_ms"), activated(F.col("run_id"), F.col("at")).alias("may_start"),
    )
    none = {"row_number": "long", "succeeded": "boolean", "fingerprint": "string", "error_code": "string", "marks": "array<string>", "stale_ms": "long", "may_start": "boolean"}
    found = resolutions.select("target", F.lit("resolution").alias("kind"), "run_id", F.col("resolved_at").cast("timestamp").alias("at"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    return runs.unionByName(found)


class _Open:
    """A target's open changes while a batch of its rows is handled. Each access to the state is a message to the JVM and back, so new ones are kept here
    and written at the end, and earlier ones are asked for only if there are any."""

    def __init__(self, kept) -> None:
        self.kept, self.new, self.earlier = kept, {}, None

    def _earlier(self) -> bool:
        if self.earlier is None:
            self.earlier = next(iter(self.kept.keys()), None) is not None
        return self.earlier

    def some(self) -> bool:
        return bool(self.new) or self._earlier()

    def add(self, run_id: str, at_ms: int) -> None:
        self.new[run_id] = at_ms

    def begun(self, run_id: str) -> int | None:
        if run_id in self.new:
            return self.new[run_id]
        return self.kept.getValue((run_id,))[0] if self._earlier() and self.kept.containsKey((run_id,)) else None

    def close(self, run_id: str) -> None:
        self.new.pop(run_id, None)
        if self._earlier() and self.kept.containsKey((run_id,)):
            self.kept.removeKey((run_id,))
            self.earlier = None

    def write(self) -> None:
        for run_id, at_ms in self.new.items():
            self.kept.updateValue((run_id,), (at_ms,))


class _Target(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("target", STATE)
        self.changes = handle.getMapState("open", "run_id string", "at_ms long")
        self.open = _Open(self.changes)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.kept.get()) if self.kept.exists() else None
        timer = state[8] if state and state[8] is not None and not state[9] else None
        out, due = [], timer
        self.open = _Open(self.changes)
        for r in pd.concat(list(rows)).sort_values(["at_ms", "kind", "row_number"], ascending=[True, False, True]).itertuples(index=False):
            if state is not None and state[8] is not None and not state[9] and r.at_ms > state[8]:
                out.append(self._stale(key, state))
                due = None
            if r.kind == "resolution":
                out.append(self._resolved(key, state, r))
                continue
            if state is None and not r.may_start:
                out.append((key[0], "run", r.run_id, r.at_ms, "not_activated", 0, 0, "uninitialized"))
                continue
            state = state or [-1, -1, None, None, False, 0, None, 0, None, True]
            if r.row_number <= state[0]:
                out.append((key[0], "run", r.run_id, r.at_ms, "rejected", state[5], state[7], "unchanged"))
                continue
            result = self._run(state, r)
            if r.succeeded and result != "error":
                state[8], state[9] = int(r.stale_ms), False
                due = state[8]
            out.append((key[0], "run", r.run_id, r.at_ms, result, state[5], state[7], self._condition(state)))
        self.open.write()
        if state is not None:
            self.kept.update(tuple(state))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer + 1)
            if due is not None:
                self.handle.registerTimer(due + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.kept.get())
        self.open = _Open(self.changes)
        out = [self._stale(key, state)] if not state[9] else []
        self.kept.update(tuple(state))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _run(self, state: list, r) -> str:
        """One run, by the rules of ``monitor.transitions``."""
        state[0], state[1], state[5] = int(r.row_number), int(r.at_ms), state[5] + 1
        result, code = "error", r.error_code
        if r.succeeded:
            now = [None if v is None else str(v) for v in r.marks]
            replaced = state[4] and any(a is not None and a != b for a, b in zip(state[3], now, strict=False))
            result = "initialized" if not state[4] else "change_detected" if state[2] != r.fingerprint else "error" if replaced else "no_change"
            code, state[2], state[3], state[4] = monitor.AMBIGUOUS, r.fingerprint, now, True
            if result == "change_detected":
                self.open.add(r.run_id, int(r.at_ms))
        code = None if result != "error" or pd.isna(code) else code
        state[7], state[6] = (state[7] + 1 if code is not None and state[6] == code else 1, code) if code is not None else (0, None)
        return result

    def _resolved(self, key: tuple, state: list | None, r) -> tuple:
        begun = self.open.begun(r.run_id) if state is not None else None
        late = begun is not None and (r.at_ms < begun or r.at_ms < state[1])
        if begun is not None and not late:
            self.open.close(r.run_id)
        result = "no_open_change" if begun is None else "outside_window" if late else "resolved"
        return (key[0], "resolution", r.run_id, r.at_ms, result, state[5] if state else 0, state[7] if state else 0, self._condition(state) if state else "uninitialized")

    def _condition(self, state: list) -> str:
        return "stopped" if state[6] in monitor.FATAL else "pending_human_review" if self.open.some() else "degraded" if state[6] else "healthy"

    def _stale(self, key: tuple, state: list) -> tuple:
        state[9] = True
        return (key[0], "stale", None, state[8], "error", state[5], state[7], self._condition(state))


def watched(rows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The stream of ``prepared`` rows to one of results. Needs a state store that can hold timers (RocksDB)."""
    keyed = rows.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return keyed.groupBy("target").transformWithStateInPandas(statefulProcessor=_Target(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def expected(rows: DataFrame, watermark: Column) -> DataFrame:
    """The batch twin over the same rows, in the order of their times: runs, resolutions and stale failures up to ``watermark`` (milliseconds)."""
    rows = rows.withColumn("at_ms", F.unix_millis("at")).drop("at")
    runs, found = rows.filter("kind = 'run'"), rows.filter("kind = 'resolution'")
    by = Window.partitionBy("target").orderBy("row_number")
    runs = runs.withColumn("live", F.max(F.col("may_start").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    marks = [F.get("marks", F.lit(i)).alias(c) for i, c in enumerate(monitor.INDICATORS)]
    plain = runs.filter("live").select("target", "run_id", "row_number", "at_ms", "stale_ms", "succeeded", "fingerprint", "error_code", *marks)
    done = monitor.transitions(plain).select("target", "run_id", "row_number", "at_ms", "stale_ms", "succeeded", "result", "version_after", "error_count")
    told = done.select("target", F.lit("run").alias("kind"), "run_id", "at_ms", "result", "version_after", "error_count")
    refused = runs.filter("not live").select("target", F.lit("run").alias("kind"), "run_id", "at_ms", F.lit("not_activated").alias("result"), F.lit(0).cast("long").alias("version_after"), F.lit(0).cast("long").alias("error_count"))
    good = done.filter("succeeded and result <> 'error'").withColumn("next_ms", F.lead("at_ms").over(Window.partitionBy("target").orderBy("row_number")))
    last = rows.groupBy("target").agg(F.max("at_ms").alias("last_ms"))
    gaps = good.join(last, "target").filter(F.col("stale_ms") < F.coalesce("next_ms", F.greatest("last_ms", watermark)))
    stale = gaps.select("target", F.lit("stale").alias("kind"), F.lit(None).cast("string").alias("run_id"), F.col("stale_ms").alias("at_ms"), F.lit("error").alias("result"))
    change = done.filter("result = 'change_detected'").select(F.col("target").alias("t"), F.col("run_id").alias("r"), F.col("at_ms").alias("begun_ms"))
    # A resolution's time lies before the next run's, and it is the first to fit its change.
    fits = found.select("target", "run_id", "at_ms").join(change, (F.col("target") == F.col("t")) & (F.col("run_id") == F.col("r")), "left")
    order = F.row_number().over(Window.partitionBy("target", "run_id").orderBy(F.col("at_ms") < F.col("begun_ms"), "at_ms"))
    known = F.col("begun_ms").isNotNull() & (F.col("at_ms") >= F.col("begun_ms"))
    resolved = fits.withColumn("n", order).select("target", F.lit("resolution").alias("kind"), "run_id", "at_ms", F.when(known & (F.col("n") == 1), "resolved").otherwise("no_open_change").alias("result"))
    wide = lambda df: df.select("*", F.lit(None).cast("long").alias("version_after"), F.lit(None).cast("long").alias("error_count"))
    return told.unionByName(refused).unionByName(wide(stale)).unionByName(wide(resolved))
