"""Gates between stages: what may be evaluated, run, tracked or carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .issues import check
from .lineage import with_parent

# Which part of a year a quarter's report covers.
QUARTER_SCOPES = {1: "q1", 2: "half_year", 3: "q3", 4: "full_year"}


def evaluation_context(releases: DataFrame, events: DataFrame, companies: DataFrame) -> DataFrame:
    """Releases whose ticker, period or lock don't agree with the event they are evaluated for."""
    scope = F.coalesce(*[F.when(F.col("q") == q, F.lit(s)) for q, s in QUARTER_SCOPES.items()])
    context = events.join(companies.select("company_id", F.col("ticker").alias("__ticker")), "company_id", "left").select("event_id", "__ticker", scope.alias("__scope"), "announced_on")
    rows = releases.join(context, "event_id", "left")
    return check(
        rows, "release",
        [("event_id", "missing_event", F.col("announced_on").isNull()), ("ticker", "other_ticker", F.col("ticker") != F.col("__ticker")), ("scope", "other_period", F.col("scope") != F.col("__scope")),
         ("locked_at", "locked_after_announcement", F.to_date("locked_at") > F.to_date("announced_on"))],
    )


def operational(targets: DataFrame, now: F.Column) -> DataFrame:
    """Why a target mustn't run now; targets that may run have no row."""
    return check(
        targets, "monitor_target",
        [("enabled", "disabled", ~F.col("enabled")), ("automation_level", "not_level_2", F.col("automation_level") != "level_2"), ("terms_status", "terms_not_reviewed", F.col("terms_status") != "candidate_specific_review_completed"),
         ("active_from", "outside_window", (now < F.col("active_from")) | (now > F.col("active_until")))],
    )


def evidence_status(evidence: DataFrame) -> DataFrame:
    """Corrections and retractions supersede something, originals nothing; a successor keeps its entity."""
    rows = with_parent(evidence, "evidence_id", "supersedes", ["evidence_id", "entity_type", "entity_id"])
    follows = F.col("status").isin("correction", "retraction_notice")
    return check(
        rows, "evidence",
        [("supersedes", "successor_without_parent", follows & F.col("supersedes").isNull()), ("supersedes", "original_with_parent", (F.col("status") == "original") & F.col("supersedes").isNotNull()),
         ("supersedes", "missing_parent", F.col("supersedes").isNotNull() & F.col("parent_evidence_id").isNull()), ("entity_id", "other_entity", (F.col("parent_entity_type") != F.col("entity_type")) | (F.col("parent_entity_id") != F.col("entity_id")))],
    )


def bundle_identity(bundles: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Observation bundles must be of the evaluation's event and company and not predate it."""
    rows = bundles.join(evaluations.select("evaluation_id", F.col("event_id").alias("__event"), F.col("company_id").alias("__company"), F.col("evaluated_at").alias("__at")), "evaluation_id", "left")
    return check(
        rows, "bundle",
        [("evaluation_id", "missing_evaluation", F.col("__event").isNull()), ("event_id", "other_event", F.col("event_id") != F.col("__event")), ("company_id", "other_company", F.col("company_id") != F.col("__company")),
         ("observed_at", "before_evaluation", F.col("observed_at") < F.col("__at"))],
    )
