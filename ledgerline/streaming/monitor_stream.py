"""The monitor's transition as a stream with keyed state.

State per target: last row, last fingerprint and indicators, version, error and its count, and whether a change is pending.
Rows that aren't later than the last one are rejected, as the batch rules would. A target's state is
a few values and stays, since its next run must continue its lineage however late it comes.

A function over Arrow batches moves the state row by row, since each row depends on the one before: it is
meant for the rate of observations, not for bulk, for which ``monitor.transitions`` is the batch twin. A trigger should
hold a bounded number of files (``maxFilesPerTrigger``), so that a hot target's rows come in several ordered batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import AMBIGUOUS, FATAL, INDICATORS

STATE = "row_number long, fingerprint string, marks array<string>, version long, error string, count long, pending boolean"
OUT = "target long, run_id string, row_number long, result string, version_after long, error_count long, state string"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, seen, marks, version, error, count, pending = state.get if state.exists else (-1, None, None, 0, None, 0, False)
    rows = pd.concat(list(parts)).sort_values("row_number")
    indicators = [c for c in INDICATORS if c in rows.columns]
    out = []
    for run_id, number, succeeded, fingerprint, code, *now in rows[["run_id", "row_number", "succeeded", "fingerprint", "error_code", *indicators]].itertuples(index=False):
        if number <= last:
            out.append((key[0], run_id, number, "rejected", version, count, "unchanged"))
            continue
        last, version = number, version + 1
        if succeeded:
            now = [None if pd.isna(v) else str(v) for v in now]
            replaced = marks is not None and any(a is not None and a != b for a, b in zip(marks, now, strict=False))
            result = "initialized" if seen is None else "change_detected" if seen != fingerprint else "error" if replaced else "no_change"
            code, seen, marks, pending = AMBIGUOUS, fingerprint, now, pending or result == "change_detected"
        else:
            result = "error"
        count, error = (count + 1 if error == code else 1, code) if result == "error" else (0, None)
        out.append((key[0], run_id, number, result, version, count, "stopped" if error in FATAL else "pending_human_review" if pending else "degraded" if error else "healthy"))
    state.update((int(last), seen, marks, int(version), error, int(count), bool(pending)))
    yield pd.DataFrame(out, columns=["target", "run_id", "row_number", "result", "version_after", "error_count", "state"])


def transition_stream(observations: DataFrame) -> DataFrame:
    """A stream of observations (target, run_id, row_number, succeeded, fingerprint, error_code, and indicators) to one of runs."""
    return observations.groupBy("target").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what the source holds now, exactly once into Parquet, and read it."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
