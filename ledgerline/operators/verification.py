"""Post-event verification: what was written before an event against what came of it, and which records were used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import json_hash
from .issues import check

# What an evaluated hypothesis' result is called after verification, and the marks of explicit statements in its text.
RESULTS = {"supported": "supported", "mixed": "partially_supported", "invalidated": "rejected", "pending": "pending"}
WITHDRAWN = ("撤回条件:", "撤回条件：", "invalidation condition:")
GUIDANCE = ("会社予想:", "会社予想：", "company guidance:")


def _says(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(m) for m in marks])


def review_gates(reviews: DataFrame) -> DataFrame:
    """Why a review can't be made: its evaluation, baseline, reaction and times must agree, and follow those of the version before.

    ``reviews``: row_number, reviewed_at, evaluation_status, evaluated_at, announced_at, is_locked, uses_post_event_data, locked_at,
    event_id, baseline_id, ticker, and the same three of the baseline (``b_``), the reaction (``r_``) and, where there is one, the
    previous version (``p_``, with ``p_reviewed_at``).
    """
    c = F.col
    differ = lambda p, names: [(n, f"{p}_differs", c(f"{p}_{n}") != c(n)) for n in names]
    return check(
        reviews, "review",
        [("evaluation_status", "not_evaluated", c("evaluation_status") != "evaluated"), ("is_locked", "not_immutable", ~c("is_locked") | c("uses_post_event_data")), ("locked_at", "missing_time", c("locked_at").isNull()),
         *differ("b", ("event_id", "baseline_id")), *differ("r", ("event_id", "ticker")), *differ("p", ("event_id", "baseline_id", "ticker")),
         ("reviewed_at", "before_sources", (c("reviewed_at") < c("evaluated_at")) | (c("reviewed_at") < c("announced_at"))), ("locked_at", "after_announcement", c("locked_at") >= c("announced_at")),
         ("locked_at", "after_evaluation", c("locked_at") > c("evaluated_at")), ("reviewed_at", "not_after_previous", c("reviewed_at") <= c("p_reviewed_at"))],
    )


def resolved_hypotheses(assessments: DataFrame, log: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, log rows that the assessments stand on): each must be logged once, before the lock, for the event, as it was assessed.

    ``assessments``: row_number, event_id, hypothesis_id, hypothesis_text, result; ``log``: hypothesis_id, event_id, hypothesis_type, created_at,
    hypothesis_text; ``locks``: event_id, locked_at.
    """
    counted = log.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("__n"), F.min("event_id").alias("__event"), F.min("hypothesis_type").alias("__type"), F.min("created_at").alias("__created"), F.min("hypothesis_text").alias("__text"))
    rows = assessments.join(counted, "hypothesis_id", "left").join(locks.select("event_id", F.col("locked_at").alias("__lock")), "event_id", "left")
    found = check(
        rows, "hypothesis_log",
        [("hypothesis_id", "not_logged", F.col("__n").isNull()), ("hypothesis_id", "not_unique", F.col("__n") > 1), ("event_id", "other_event", F.col("__event") != F.col("event_id")),
         ("hypothesis_type", "not_pre_event", F.col("__type") != "pre_event"), ("created_at", "after_lock", F.col("__created") > F.col("__lock")), ("hypothesis_text", "other_text", F.col("__text") != F.col("hypothesis_text"))],
    )
    return found, log.join(assessments.select("hypothesis_id").distinct(), "hypothesis_id", "left_semi")


def invalidations(log: DataFrame, assessments: DataFrame) -> DataFrame:
    """Logged invalidations of assessed hypotheses."""
    mine = assessments.select(F.col("hypothesis_id").alias("parent_id")).distinct()
    return log.filter("hypothesis_type = 'invalidation' and status = 'invalidated'").join(mine, "parent_id", "left_semi")


def verifications(assessments: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Per assessment: ``verified``, ``condition_status`` and the invalidating records' ids in order (a hypothesis has few)."""
    children = invalidated.groupBy(F.col("parent_id").alias("hypothesis_id")).agg(F.array_sort(F.collect_set("hypothesis_id")).alias("record_ids"))
    rows = assessments.join(children, "hypothesis_id", "left")
    word = F.coalesce(*[F.when(F.col("result") == r, F.lit(w)) for r, w in RESULTS.items()])
    status = (
        F.when(F.col("record_ids").isNotNull(), "triggered").when(F.col("result") == "invalidated", "insufficient_evidence")
        .when(_says(F.col("hypothesis_text"), WITHDRAWN), "not_triggered").otherwise("not_recorded")
    )
    return rows.select(*assessments.columns, word.alias("verified"), status.alias("condition_status"), F.coalesce("record_ids", F.array().cast("array<string>")).alias("record_ids"))


def guidance_read(verified: DataFrame, key: str) -> DataFrame:
    """What became of the hypotheses that speak of a company's own guidance."""
    explicit = F.when(_says(F.col("hypothesis_text"), GUIDANCE), F.col("verified"))
    sums = verified.groupBy(key).agg(F.count(explicit).alias("n"), F.min(explicit).alias("least"), F.max(explicit).alias("most"))
    alone = lambda word: (F.col("least") == word) & (F.col("most") == word)
    read = F.when(F.col("n") == 0, "not_recorded").when(alone("supported"), "supported").when(alone("rejected"), "contradicted").when(alone("pending"), "insufficient_evidence").otherwise("mixed")
    return sums.select(key, read.alias("guidance_read"))


def source_records(tables: dict[str, tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """One row per record that a review stands on: ``record_type``, id, time, and the hash of its content. ``tables``: by type, (rows, id column, time column)."""
    parts = [df.select(F.col(key), F.lit(kind).alias("record_type"), F.col(id_).cast("string").alias("record_id"), F.col(at).alias("recorded_at"), json_hash(df, df.columns).alias("content_sha256")) for kind, (df, id_, at) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def source_events(reviews: DataFrame, key: str, order: str) -> DataFrame:
    """The distinct events that a carry-over stands on, numbered by where each first occurs."""
    first = reviews.groupBy(key, "event_id").agg(F.min(order).alias("__at"))
    return first.select(key, "event_id", F.row_number().over(Window.partitionBy(key).orderBy("__at", "event_id")).alias("n"))


def evaluation_limits(expected: DataFrame, compared: DataFrame, keys: list[str]) -> DataFrame:
    """Per event the metrics that could not be compared, each once and in order: the limitations of an evaluation."""
    lost = expected.join(compared.select(*keys), keys, "left_anti")
    return lost.groupBy(keys[0]).agg(F.array_sort(F.collect_set(keys[1])).alias("limitations"))  # a few metric names
