"""Point-in-time rules: what a record may have known when, and gates between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .issues import check
from .lineage import current


def effective_times(events: DataFrame, statuses: DataFrame, key: str = "event_id") -> DataFrame:
    """``events`` with ``event_time``: the schedule, overridden by the unique current status (what occurred, else its schedule)."""
    now = current(statuses, key, "status_id", "supersedes").select(key, "status", F.when(F.col("status") == "occurred", F.col("occurred_at")).otherwise(F.col("scheduled_at")).alias("__time"))
    return events.join(now, key, "left").withColumn("event_time", F.coalesce("__time", "scheduled_at")).drop("__time")


def look_ahead(baselines: DataFrame, timed_events: DataFrame, columns: list[str]) -> DataFrame:
    """Baseline times at or after the event, and baselines that say they use later data."""
    rows = baselines.join(timed_events.select("event_id", "event_time"), "event_id")
    rules = [(c, "not_before_event", F.col(c) >= F.col("event_time")) for c in columns]
    return check(rows, "pre_earnings_baseline", [*rules, ("uses_post_event_data", "post_event_data", F.col("uses_post_event_data"))])


def review_times(reviews: DataFrame, timed_events: DataFrame) -> DataFrame:
    rows = reviews.join(timed_events.select("event_id", "event_time"), "event_id")
    return check(rows, "post_earnings_review", [("recorded_at", "not_after_event", F.col("recorded_at") <= F.col("event_time"))])


def review_links(reviews: DataFrame, baselines: DataFrame) -> DataFrame:
    """Reviews whose baseline is of another event or a draft."""
    parents = baselines.select("baseline_id", F.col("event_id").alias("b_event"), "baseline_status")
    rows = reviews.join(parents, "baseline_id")
    return check(rows, "post_earnings_review", [("baseline_id", "other_event", F.col("b_event") != F.col("event_id")), ("baseline_id", "draft_baseline", F.col("baseline_status") == "draft")])


def score_versions(rows: DataFrame, versions: DataFrame, table: str, at: str) -> DataFrame:
    """Undefined scoring versions, and versions used before their last effective date."""
    last = versions.groupBy("scoring_version").agg(F.max("effective_from").alias("__from"))
    joined = rows.join(last, "scoring_version", "left")
    return check(joined, table, [("scoring_version", "undefined", F.col("__from").isNull()), ("scoring_version", "not_effective", F.to_date(at) < F.col("__from"))])


def kpi_rules(kpis: DataFrame, timed_events: DataFrame) -> DataFrame:
    """Scores use expected values from before the event; actual values aren't from before it; companies agree."""
    rows = kpis.join(timed_events.select("event_id", "event_time", F.col("company_id").alias("__company")), "event_id")
    scored = F.col("used_for_score")
    return check(
        rows, "kpi_observation",
        [
            ("company_id", "other_company", F.col("company_id") != F.col("__company")),
            ("value_type", "score_uses_actual", scored & (F.col("value_type") != "expected")),
            ("recorded_at", "score_after_event", scored & (F.col("recorded_at") >= F.col("event_time"))),
            ("recorded_at", "actual_before_event", (F.col("value_type") == "actual") & (F.col("recorded_at") < F.col("event_time"))),
        ],
    )


def evidence_context(evidence: DataFrame, contexts: dict[str, DataFrame], timed_events: DataFrame) -> DataFrame:
    """``evidence`` with the ``event_time`` and ``cutoff`` (the entity's as-of, else the event) of what it supports.

    ``contexts``: by entity type, (entity_id, event_id, as_of).
    """
    parts = [df.select(F.lit(kind).alias("entity_type"), F.col("entity_id"), F.col("event_id"), F.col("as_of").cast("timestamp").alias("as_of")) for kind, df in contexts.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    times = union.join(timed_events.select("event_id", "event_time"), "event_id").select("entity_type", "entity_id", "event_time", F.coalesce("as_of", "event_time").alias("cutoff"))
    return evidence.join(times, ["entity_type", "entity_id"], "left")


def is_pre_event(entity_type: Column, used: Column) -> Column:
    return used & ((entity_type == "pre_earnings_baseline") | entity_type.startswith("pre_"))


def evidence_cutoffs(evidence: DataFrame, late_components: tuple[str, ...], times: tuple[str, ...] = ("published_at", "observed_at", "recorded_at")) -> DataFrame:
    """Evidence for a pre-event score must be known by the cutoff and recorded before the event.

    Evidence of no event fails only if it is for such a score.
    """
    pre = is_pre_event(F.col("entity_type"), F.col("used_for_score"))
    known = F.col("event_time").isNotNull()
    rules = [("entity_id", "no_event", pre & ~known)]
    rules += [(c, "after_cutoff", pre & known & (F.col(c) > F.col("cutoff"))) for c in times]
    rules += [("recorded_at", "not_before_event", pre & known & (F.col("recorded_at") >= F.col("event_time"))), ("component", "post_event_component", pre & known & F.col("component").isin(*late_components))]
    return check(evidence, "evidence", rules)


def evidence_order(evidence: DataFrame) -> DataFrame:
    return check(evidence, "evidence", [("published_at", "after_observed", F.col("published_at") > F.col("observed_at")), ("observed_at", "after_recorded", F.col("observed_at") > F.col("recorded_at"))])


def evidence_metadata(evidence: DataFrame, bundle: tuple[str, ...] = ("storage_status", "licence_status", "hash_status"), any_of: tuple[str, ...] = ("location", "content_hash")) -> DataFrame:
    """Any metadata asks for all statuses; storage, licence, location and hash must agree."""
    some = F.coalesce(*[F.col(c) for c in (*bundle, *any_of)]).isNotNull()
    stored, status, has = F.col("storage_status") == "stored", F.col("hash_status"), F.col("content_hash").isNotNull()
    needs = status.isin("verified", "recorded_unverified", "mismatch")
    return check(
        evidence, "evidence",
        [*[(c, "incomplete_metadata", some & F.col(c).isNull()) for c in bundle],
         ("location", "stored_without_location", stored & F.col("location").isNull()),
         ("licence_status", "stored_without_licence", stored & ~F.coalesce(F.col("licence_status") == "permitted", F.lit(False))),
         ("location", "location_without_storage", F.col("location").isNotNull() & ~F.coalesce(stored, F.lit(False))),
         ("content_hash", "hash_missing", needs & ~has),
         ("content_hash", "hash_form", needs & has & ~F.col("content_hash").rlike("^[0-9a-fA-F]{64}$")),
         ("content_hash", "hash_unexpected", status.isin("not_recorded", "not_applicable") & has),
         ("hash_status", "hash_mismatch", status == "mismatch")],
    )


def trade_prices(reviews: DataFrame) -> DataFrame:
    """No prices without a trade; stop, entry and target in the direction's order with one."""
    e, s, t, d = F.col("entry_price"), F.col("stop_price"), F.col("target_price"), F.col("decision")
    some, all_ = F.coalesce(e, s, t).isNotNull(), e.isNotNull() & s.isNotNull() & t.isNotNull()
    return check(
        reviews, "post_earnings_review",
        [("decision", "prices_without_trade", (d == "NO_TRADE") & some), ("entry_price", "missing_price", d.isin("LONG", "SHORT") & ~all_),
         ("entry_price", "long_order", (d == "LONG") & all_ & ~((s < e) & (e < t))), ("entry_price", "short_order", (d == "SHORT") & all_ & ~((t < e) & (e < s)))],
    )


def return_references(reviews: DataFrame, returns: list[str], references: list[str]) -> DataFrame:
    """Reviews with returns but not all reference columns, with the names of those missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in references]))
    rows = reviews.filter(F.coalesce(*[F.col(c) for c in returns]).isNotNull()).withColumn("missing", F.concat_ws(",", missing)).filter("missing <> ''")
    return rows.select(F.lit("post_earnings_review").alias("table"), F.col("row_number").cast("long").alias("row_number"), "missing")


def lifecycle_required(triggers: list[DataFrame]) -> DataFrame:
    """The distinct event ids that any of several triggers names."""
    out = triggers[0].select("event_id")
    for t in triggers[1:]:
        out = out.union(t.select("event_id"))
    return out.distinct()


def without_status(required: DataFrame, statuses: DataFrame) -> DataFrame:
    """Required events without a unique current status."""
    return required.join(current(statuses, "event_id", "status_id", "supersedes").select("event_id"), "event_id", "left_anti")


def review_gate(reviews: DataFrame, statuses: DataFrame, baselines: DataFrame, required: DataFrame, returns: tuple[str, ...] = ()) -> DataFrame:
    """Reviews of events that need a lifecycle (``required``: event_id): the event must have occurred, and without that no return be given;
    where it has, the baseline, if there is one, must be locked, and the review come after the confirmation."""
    now = current(statuses, "event_id", "status_id", "supersedes").select("event_id", F.col("status").alias("__status"), F.col("recorded_at").alias("__confirmed_at"))
    rows = reviews.join(required.select("event_id").distinct(), "event_id", "left_semi").join(now, "event_id", "left").join(baselines.select("baseline_id", "baseline_status"), "baseline_id", "left")
    status, returned = F.coalesce("__status", F.lit("")), F.lit(False)
    for c in returns:
        returned = returned | F.col(c).isNotNull()
    occurred = status == "occurred"
    return check(
        rows, "post_earnings_review",
        [("event_id", "event_cancelled", status == "cancelled"), ("event_id", "not_occurred", ~status.isin("occurred", "cancelled")), ("event_id", "return_without_occurrence", ~occurred & returned),
         ("baseline_id", "baseline_not_locked", occurred & (F.col("baseline_status") != "locked")), ("recorded_at", "before_confirmation", occurred & (F.col("recorded_at") < F.col("__confirmed_at")))],
    )


def lock_state(baselines: DataFrame) -> DataFrame:
    """Status, review and version rules of baselines."""
    draft, locked = F.col("baseline_status") == "draft", F.col("baseline_status") == "locked"
    return check(
        baselines, "pre_earnings_baseline",
        [("review_status", "locked_unapproved", locked & (F.col("review_status") != "approved")), ("supersedes", "draft_supersedes", draft & F.col("supersedes").isNotNull()),
         ("supersedes", "must_supersede", locked & (F.col("v") > 1) & F.col("supersedes").isNull()), ("as_of", "after_lock", locked & (F.col("as_of") > F.col("locked_at"))),
         ("recorded_at", "after_lock", locked & (F.col("recorded_at") > F.col("locked_at")))],
    )


def baseline_evidence(baselines: DataFrame, evidence: DataFrame) -> DataFrame:
    """Locked baselines without evidence, or without any that is used for the score."""
    counts = evidence.filter("entity_type = 'pre_earnings_baseline'").groupBy(F.col("entity_id").alias("baseline_id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("used_for_score").cast("int")).alias("used"))
    rows = baselines.filter("baseline_status = 'locked'").join(counts, "baseline_id", "left")
    return check(rows, "pre_earnings_baseline", [("baseline_id", "no_evidence", F.col("n").isNull()), ("baseline_id", "no_score_evidence", F.col("used") == 0)])
