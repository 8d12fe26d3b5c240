"""Rules of event statuses, baselines and their evidence that look at several fields or tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .issues import check
from .lineage import current, tails, version_number, with_parent

STATUSES, BASELINES, EVIDENCE = "event_status_history", "pre_earnings_baseline", "evidence"


def status_fields(statuses: DataFrame) -> DataFrame:
    """What a status must and mustn't hold: time of occurrence, reason, replacement; and what an initial one is."""
    s, first = F.col("status"), F.col("supersedes").isNull()
    rows = statuses.withColumn("__earlier", F.lag("status_id").over(Window.partitionBy("event_id").orderBy("row_number")))
    return check(
        rows, STATUSES,
        [("occurred_at", "occurred_without_time", (s == "occurred") & F.col("occurred_at").isNull()), ("occurred_at", "after_recording", (s == "occurred") & (F.col("occurred_at") > F.col("recorded_at"))),
         ("occurred_at", "time_without_occurrence", (s != "occurred") & F.col("occurred_at").isNotNull()), ("status_reason", "missing_reason", s.isin("postponed", "cancelled") & F.col("status_reason").isNull()),
         ("replacement_event_id", "not_cancelled", F.col("replacement_event_id").isNotNull() & (s != "cancelled")), ("replacement_event_id", "replaces_itself", F.col("replacement_event_id") == F.col("event_id")),
         ("supersedes", "second_initial", first & F.col("__earlier").isNotNull()), ("status", "initial_not_scheduled", first & (s != "scheduled")), ("previous_scheduled_at", "initial_with_previous", first & F.col("previous_scheduled_at").isNotNull())],
    )


def status_moves(statuses: DataFrame) -> DataFrame:
    """A status against the one it supersedes: recorded later, a postponement keeps the old schedule and moves it on, an end keeps it."""
    rows = with_parent(statuses, "status_id", "supersedes", ["recorded_at", "scheduled_at"]).filter(F.col("parent_recorded_at").isNotNull())
    s, old = F.col("status"), F.col("parent_scheduled_at")
    return check(
        rows, STATUSES,
        [("recorded_at", "not_later", F.col("recorded_at") <= F.col("parent_recorded_at")), ("previous_scheduled_at", "previous_not_kept", (s == "postponed") & ~F.col("previous_scheduled_at").eqNullSafe(old)),
         ("scheduled_at", "postponed_earlier", (s == "postponed") & (F.col("scheduled_at") <= old)), ("previous_scheduled_at", "previous_without_postponement", (s != "postponed") & F.col("previous_scheduled_at").isNotNull()),
         ("scheduled_at", "terminal_moves_schedule", s.isin("cancelled", "occurred") & ~F.col("scheduled_at").eqNullSafe(old))],
    )


def initial_schedules(statuses: DataFrame, events: DataFrame) -> DataFrame:
    """Initial statuses whose schedule isn't the event's own."""
    rows = statuses.filter("supersedes is null").join(events.select("event_id", F.col("scheduled_at").alias("__own")), "event_id")
    return check(rows, STATUSES, [("scheduled_at", "other_schedule", F.col("scheduled_at") != F.col("__own"))])


def replacements(statuses: DataFrame, events: DataFrame) -> DataFrame:
    """Replacement events of another company."""
    company = events.select("event_id", F.col("company_id").alias("__company"))
    rows = statuses.filter("replacement_event_id is not null").join(company, "event_id").join(company.toDF("replacement_event_id", "__other"), "replacement_event_id")
    return check(rows, STATUSES, [("replacement_event_id", "other_company", F.col("__company") != F.col("__other"))])


def hypothesis_ends(hypotheses: DataFrame) -> DataFrame:
    """Invalidated hypotheses without a time or a reason."""
    return check(hypotheses, "hypothesis_log", [("invalidation_reason", "missing_reason", (F.col("status") == "invalidated") & (F.col("invalidated_at").isNull() | F.col("invalidation_reason").isNull()))])


def review_returns(reviews: DataFrame, statuses: DataFrame, returns: list[str]) -> DataFrame:
    """Reviews with returns of events that, as far as is known now, didn't occur."""
    now = current(statuses, "event_id", "status_id", "supersedes").select("event_id", F.col("status").alias("__status"))
    rows = reviews.filter(F.coalesce(*[F.col(c).cast("string") for c in returns]).isNotNull()).join(now, "event_id", "left")
    return check(rows, "post_earnings_review", [("event_id", "return_without_occurrence", ~F.col("__status").eqNullSafe("occurred"))])


def after_postponement(statuses: DataFrame, baselines: DataFrame) -> DataFrame:
    """Events that occurred after a postponement: exactly one current baseline, locked (the first failure counts), then approved,
    reviewed at or after the postponement and locked before the schedule."""
    ends = tails(baselines.filter("baseline_status is not null"), "baseline_id", "supersedes").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min("baseline_status").alias("__bs"), F.min("review_status").alias("__rs"), F.min("reviewed_at").alias("__reviewed"), F.min("locked_at").alias("__locked")
    )
    now = with_parent(current(statuses, "event_id", "status_id", "supersedes").filter("status = 'occurred'"), "status_id", "supersedes", [])
    old = statuses.select(F.col("status_id").alias("supersedes"), F.col("status").alias("__old"), F.col("recorded_at").alias("__postponed")).filter("__old = 'postponed'")
    rows = now.join(old, "supersedes").join(ends, "event_id", "left")
    one = F.col("__n").eqNullSafe(1)
    locked = one & (F.col("__bs") == "locked")
    return check(
        rows, STATUSES,
        [("event_id", "no_baseline", F.col("__n").isNull()), ("event_id", "several_baselines", F.col("__n") > 1), ("event_id", "baseline_unlocked", one & (F.col("__bs") != "locked")),
         ("event_id", "baseline_unapproved", locked & (F.col("__rs") != "approved")), ("event_id", "reviewed_too_early", locked & ~F.coalesce(F.col("__reviewed") >= F.col("__postponed"), F.lit(False))),
         ("event_id", "locked_too_late", locked & ~F.coalesce(F.col("__locked") < F.col("scheduled_at"), F.lit(False)))],
    )


def baseline_state(baselines: DataFrame) -> DataFrame:
    """Draft, locked and review states of prospective baselines, field by field."""
    draft, locked, c = F.col("baseline_status") == "draft", F.col("baseline_status") == "locked", F.col
    done = c("reviewed_by").isNotNull() & c("reviewed_at").isNotNull()
    late = [(name, "after_lock", locked & (c(name) > c("locked_at"))) for name in ("recorded_at", "as_of", "reviewed_at", "published_at", "observed_at")]
    return check(
        baselines, BASELINES,
        [("baseline_status", "missing_status", c("baseline_status").isNull()), ("review_status", "missing_review_status", c("review_status").isNull()), ("version", "version_form", version_number(c("version")).isNull()),
         ("review_status", "pending_with_reviewer", (c("review_status") == "pending") & (c("reviewed_by").isNotNull() | c("reviewed_at").isNotNull())), ("reviewed_by", "review_without_reviewer", c("review_status").isin("approved", "rejected") & ~done),
         ("baseline_status", "draft_with_lock", draft & (c("is_locked") | c("locked_at").isNotNull() | c("record_hash").isNotNull() | c("hash_algorithm").isNotNull())), ("supersedes", "draft_supersedes", draft & (c("supersedes").isNotNull() | c("supersession_reason").isNotNull())),
         ("is_locked", "locked_without_flag", locked & ~c("is_locked")), ("locked_at", "locked_without_time", locked & c("locked_at").isNull()), ("record_hash", "locked_without_hash", locked & c("record_hash").isNull()),
         ("hash_algorithm", "not_sha256", locked & ~c("hash_algorithm").eqNullSafe("sha256")), ("review_status", "locked_unapproved", locked & ~c("review_status").eqNullSafe("approved")),
         ("record_hash", "hash_form", locked & (c("hash_algorithm") == "sha256") & ~c("record_hash").rlike("^[0-9a-fA-F]{64}$")), *late],
    )


def baseline_supersession(baselines: DataFrame) -> DataFrame:
    """Reasons and versions of baselines that supersede others; a later locked version must."""
    rows = with_parent(baselines, "baseline_id", "supersedes", ["version"])
    v, old, follows, why = version_number(F.col("version")), version_number(F.col("parent_version")), F.col("supersedes").isNotNull(), F.col("supersession_reason").isNotNull()
    locked = F.col("baseline_status") == "locked"
    return check(
        rows, BASELINES,
        [("supersedes", "reason_without_target", why & ~follows), ("baseline_status", "unlocked_supersedes", follows & ~F.coalesce(locked, F.lit(False))), ("supersession_reason", "missing_reason", follows & ~why),
         ("version", "not_greater", follows & (F.col("supersedes") != F.col("baseline_id")) & (v <= old)), ("supersedes", "must_supersede", ~follows & locked & (v > 1))],
    )


def baseline_evidence_rules(baselines: DataFrame, evidence: DataFrame, statuses: tuple[str, ...], times: tuple[str, ...]) -> DataFrame:
    """Evidence of drafts mustn't be used for scores; that of locked baselines has its statuses and isn't from after the lock. A row per baseline and rule."""
    mine = evidence.filter(F.col("entity_type") == BASELINES)
    used = mine.filter("used_for_score").select(F.col("entity_id").alias("baseline_id"))
    drafts = check(baselines.filter("baseline_status = 'draft'").join(used, "baseline_id", "left_semi"), BASELINES, [("baseline_status", "draft_evidence_used", F.lit(True))])
    some = mine.groupBy(F.col("entity_id").alias("baseline_id")).agg(*[F.max(F.col(c).isNull().cast("int")).alias(f"__no_{c}") for c in statuses], *[F.max(c).alias(f"__last_{c}") for c in times])
    rules: list[tuple[str, str, Column]] = [("baseline_id", f"evidence_without_{c}", F.col(f"__no_{c}") == 1) for c in statuses]
    rules += [("baseline_id", f"evidence_{c}_after_lock", F.col(f"__last_{c}") > F.col("locked_at")) for c in times]
    return drafts.union(check(baselines.filter("baseline_status = 'locked'").join(some, "baseline_id"), BASELINES, rules))
