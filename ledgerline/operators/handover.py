"""What stands between a monitor's run and the research after it: access, handoffs, dispatches, carried contexts, legacy baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .issues import check
from .rowchecks import is_authorizer

# The words of access, handoffs and dispatches.
LEVEL, REVIEWED, ACTIVATED = "level_2", "candidate_specific_review_completed", "activated"
AUTONOMOUS, VERSION, READY = "autonomous_research_handoff", "earnings_document_research_v1", "ready_for_document_discovery"
STAGES = ("document_discovery", "document_content_acquisition", "financial_metric_extraction", "pre_event_comparison", "earnings_evaluation", "price_reaction_tracking")
DISPATCH, DONE, NONE = "earnings_document_dispatch_v1", "analysis_completed", "no_target_documents"
LAST_SEEN = ("last_seen_title", "last_seen_document_id", "last_seen_published_at", "last_seen_document_url", "last_seen_schedule")
MOST_DOCUMENTS = 4


def access_gate(targets: DataFrame) -> DataFrame:
    """Every reason why a target's source mustn't be read: switches, level, terms, and both authorizers. Null is no permission."""
    other = lambda c, word: ~F.coalesce(F.col(c) == word, F.lit(False))
    off = lambda c: ~F.coalesce(F.lower(F.col(c).cast("string")) == "true", F.lit(False))
    unsigned = lambda c: ~F.coalesce(is_authorizer(F.col(c)), F.lit(False))
    return check(
        targets, "monitor_target",
        [("enabled", "disabled", off("enabled")), ("automated_access_permitted", "not_permitted", off("automated_access_permitted")), ("monitoring_level", "not_level_2", other("monitoring_level", LEVEL)),
         ("terms_review_state", "terms_not_reviewed", other("terms_review_state", REVIEWED)), ("automation_approved_by", "automation_unauthorised", unsigned("automation_approved_by")),
         ("activation_state", "not_activated", other("activation_state", ACTIVATED)), ("activation_approved_by", "activation_unauthorised", unsigned("activation_approved_by"))],
    )


def research_handoffs(runs: DataFrame, targets: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The handoff of each target whose latest run is a change and that answers changes by research, with what its checkpoint saw last.

    ``runs``: target, row_number, run_id, result, finished_at, summary. ``targets``: target, change_response, company_id, earnings_event_id, source_url, source_category.
    ``checkpoints``: target and ``LAST_SEEN``; blanks count as null. A target without a checkpoint is handed over without them.
    """
    latest = runs.groupBy("target").agg(F.max_by(F.struct("run_id", "result", "finished_at", "summary"), "row_number").alias("r")).select("target", "r.*")
    rows = latest.filter("result = 'change_detected'").join(targets.filter(F.col("change_response") == AUTONOMOUS), "target").join(checkpoints.select("target", *LAST_SEEN), "target", "left")
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(
        F.lit(VERSION).alias("handoff_version"), F.lit(READY).alias("status"), F.col("target").alias("monitor_target_id"), F.col("run_id").alias("monitor_run_id"), "company_id", blank("earnings_event_id"), "source_url", "source_category",
        F.col("finished_at").alias("detected_at"), F.col("summary").alias("change_summary"), *[blank(c) for c in LAST_SEEN], F.array(*[F.lit(s) for s in STAGES]).alias("next_stages"), F.lit(False).alias("raw_content_included"),
    )


def dispatches(handoffs: DataFrame, documents: DataFrame, key: str = "handoff_id") -> DataFrame:
    """Per handoff what became of its documents: refused as a whole beyond ``MOST_DOCUMENTS``, else analysed, or excluded where they are of no known kind.

    ``documents``: key, pos, url, kind (null for none). A handoff without documents has none to analyse.
    """
    counted = documents.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("known"))
    rows = handoffs.select(key).distinct().join(counted, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "known")})
    refused = F.col("n") > MOST_DOCUMENTS
    none = F.lit(0).cast("long")
    return rows.select(
        key, F.lit(DISPATCH).alias("dispatch_version"), F.when(refused, "beyond_limit").when(F.col("known") > 0, DONE).otherwise(NONE).alias("status"), F.when(refused, none).otherwise(F.col("known")).alias("analyzed_document_count"),
        F.when(refused, none).otherwise(F.col("n") - F.col("known")).alias("excluded_document_count"), F.lit(False).alias("raw_document_retained"),
    )


def carryover_contract(contexts: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """Codes (context_id, code) of carried contexts that don't hold together.

    ``contexts``: context_id, prepared_at, source_event_ids. ``sources``: context_id, pos, review_id, event_id, reviewed_at. ``items``: context_id, field, text, occurrence_count,
    source_review_ids. Events must be those of the sources in order of first occurrence; unknown ids are found by an anti join of (context, review).
    """
    per = sources.groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("review_id").alias("ids"), F.max("reviewed_at").alias("latest"))
    first = sources.groupBy("context_id", "event_id").agg(F.min("pos").alias("at")).groupBy("context_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_id"))), lambda e: e["event_id"]).alias("events"))  # a context names its events
    rows = contexts.join(per, "context_id", "left").join(first, "context_id", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("n") != F.col("ids"), "repeated_source_review"), F.when(F.col("latest") > F.col("prepared_at"), "source_from_later"),
        F.when(~F.col("source_event_ids").eqNullSafe(F.coalesce("events", F.array().cast(contexts.schema["source_event_ids"].dataType))), "other_source_events"),
    ))
    distinct = F.size(F.array_distinct("source_review_ids"))
    own = F.array_compact(F.array(F.when(F.col("occurrence_count") != F.size("source_review_ids"), "other_count"), F.when(distinct != F.size("source_review_ids"), "repeated_review")))
    named = items.select("context_id", F.explode("source_review_ids").alias("review_id")).distinct()
    unknown = named.join(sources.select("context_id", "review_id").distinct(), ["context_id", "review_id"], "left_anti").select("context_id", F.lit("unknown_review").alias("code"))
    found = rows.select("context_id", F.explode(codes).alias("code")).unionByName(items.select("context_id", F.explode(own).alias("code"))).unionByName(unknown)
    return found.distinct()


def legacy_baselines(baselines: DataFrame, prospective: tuple[str, ...], capable: Column | bool) -> DataFrame:
    """Rows of the older contract: without any prospective column. In a file that has those columns a locked one may not be such a row; elsewhere it needs its time and hash."""
    some = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in prospective]).isNotNull()
    legacy, capable = ~some & F.coalesce(F.col("is_locked"), F.lit(False)), F.lit(capable) if isinstance(capable, bool) else capable
    return check(
        baselines, "pre_earnings_baseline",
        [("baseline_status", "legacy_in_prospective_file", capable & legacy), ("locked_at,baseline_record_hash", "legacy_lock_incomplete", ~capable & legacy & (F.col("locked_at").isNull() | F.col("record_hash").isNull()))],
    )
