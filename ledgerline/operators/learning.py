"""Reasons and learning of reviews as whole records, what reviews teach together, and whether a review's references resolve.

Inputs are tables of items: ``verifications`` (review_id, pos, hypothesis_id, hypothesis_text, result, source_ids, invalidation_ids), ``numeric`` (review_id,
pos, metric_name, result, source_id), ``guidance`` (review_id, pos, metric_name, revision, source_id), ``stages`` (review_id, stage, status, direction,
return_pct, source_id) and ``sources`` (review_id, record_type, record_id, recorded_at). What a review holds is one record, so its lists are
gathered by review; lists over many reviews stay rows, with a view of at most ``SHOWN`` ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .issues import SCHEMA, check, report
from .review import CHANGED, HIGHER, LOWER, REVERSED, interpretation, transition

# The stages of a review and the words of its records.
STAGES = ("immediate_post_announcement", "next_business_day", "fifth_business_day")
PRIMARY = {"pre_event_baseline": "baseline_id", "earnings_evaluation": "evaluation_id", "market_reaction_tracking": "tracking_id"}
NEXT_STAGE = {"complete": "learning_record_ready", "provisional": "awaiting_market_milestones", "blocked": "comparison_blocked"}
GUIDANCE_MARKS = ("会社予想:", "会社予想：")
FIELDS = ("maintain_criteria", "weaken_candidates", "additional_indicators", "recurring_errors_to_prevent", "supported_but_not_generalized", "rejected_assumptions", "next_event_checks")
CARRIED = ("maintain_criteria", "weaken_candidates", "next_event_checks", "rejected_assumptions", "recurring_errors_to_prevent")
SHOWN, SPREAD = 100, 64


def _ordered(value: Column, when: Column | None = None, order: str = "pos") -> Column:
    """The values of a group in order, as an aggregate."""
    one = F.struct(F.col(order).alias("o"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(one if when is None else F.when(when, one))), lambda x: x["v"])


def reasons(reviews: DataFrame, verifications: DataFrame, numeric: DataFrame, guidance: DataFrame, stages: DataFrame) -> DataFrame:
    """Per review (review_id, earnings, reaction_path): ordered lists of ids and metrics, interpretation, transition and what is missing.

    Without hypotheses, comparisons or stages the lists are empty; a missing stage counts as pending. Missing reasons are codes.
    """
    r = F.col("result")
    explicit = F.lower("hypothesis_text").contains("company guidance:")
    for mark in GUIDANCE_MARKS:
        explicit = explicit | F.col("hypothesis_text").contains(mark)
    v = verifications.groupBy("review_id").agg(
        _ordered(F.col("hypothesis_id"), r == "supported").alias("supported_hypothesis_ids"), _ordered(F.col("hypothesis_id"), r == "rejected").alias("rejected_hypothesis_ids"), _ordered(F.col("hypothesis_id"), r == "pending").alias("pending_hypothesis_ids"),
        F.flatten(_ordered(F.coalesce("invalidation_ids", F.array().cast("array<string>")))).alias("triggered_invalidation_record_ids"), F.collect_set(F.when(explicit, r)).alias("read"),
    )
    n = numeric.groupBy("review_id").agg(_ordered(F.col("metric_name"), r == "above").alias("above_expectation_metrics"), _ordered(F.col("metric_name"), r == "below").alias("below_expectation_metrics"), F.count(F.lit(1)).alias("n_numeric"))
    g = guidance.groupBy("review_id").agg(_ordered(F.concat_ws(":", "metric_name", "revision")).alias("guidance_revisions"))
    s = stages.groupBy("review_id").agg(*[F.max(F.when(F.col("stage") == name, F.struct("status", "direction"))).alias(f"stage{i}") for i, name in enumerate(STAGES)])
    rows = reviews
    for part in (v, n, g, s):
        rows = rows.join(part, "review_id", "left")
    none = F.array().cast("array<string>")
    lists = ("supported_hypothesis_ids", "rejected_hypothesis_ids", "pending_hypothesis_ids", "above_expectation_metrics", "below_expectation_metrics", "guidance_revisions", "triggered_invalidation_record_ids")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in (*lists, "read")}).withColumn("n_numeric", F.coalesce("n_numeric", F.lit(0)))
    status = [F.coalesce(F.col(f"stage{i}.status"), F.lit("pending")) for i in range(3)]
    directions = [F.when(x == "complete", F.col(f"stage{i}.direction")).otherwise(x) for i, x in enumerate(status)]
    earnings = F.when(F.col("earnings").isin("positive", "negative"), F.col("earnings")).otherwise("inconclusive")
    only = lambda word: (F.size("read") == 1) & F.array_contains("read", word)
    read = F.when(F.size("read") == 0, "not_recorded").when(only("supported"), "supported").when(only("rejected"), "contradicted").when(only("pending"), "insufficient_evidence").otherwise("mixed")
    gaps = [F.when(x == "pending", f"{name}:awaiting_price").when(x == "not_comparable", f"{name}:not_comparable") for name, x in zip(STAGES, status, strict=True)]
    gaps += [F.when(F.col("n_numeric") == 0, "no_numeric_comparison"), F.when(F.size("pending_hypothesis_ids") > 0, "pending_hypotheses")]
    return rows.select(
        "review_id", *lists, read.alias("company_guidance_read_result"), interpretation(earnings, directions[0]).alias("market_expectation_interpretation"),
        transition(F.col("reaction_path"), directions).alias("reaction_transition"), F.array_compact(F.array(*gaps)).alias("missing_or_blocked_reasons"), "n_numeric",
    )


def learning_lists(reviews: DataFrame, verifications: DataFrame, guidance: DataFrame, told: DataFrame) -> DataFrame:
    """Per review the seven lists (``FIELDS``), each text once in order of first occurrence, but for rejected assumptions, which stay as they are.

    ``told``: the result of ``reasons``. ``reviews``: review_id, corporate_action_status. What isn't a hypothesis's own text is a code.
    """
    r, none = F.col("result"), F.array().cast("array<string>")
    texts = verifications.groupBy("review_id").agg(
        *[_ordered(F.col("hypothesis_text"), r.isin(*words)).alias(name) for name, words in (("kept", ("supported",)), ("weak", ("partially_supported", "rejected")), ("open", ("pending",)), ("out", ("rejected",)))],
    )
    again = guidance.groupBy("review_id").agg(_ordered(F.concat(F.lit("recheck_guidance:"), "metric_name")).alias("again"))
    rows = told.join(reviews.select("review_id", "corporate_action_status"), "review_id").join(texts, "review_id", "left").join(again, "review_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("kept", "weak", "open", "out", "again")})
    some = lambda condition, code: F.when(condition, F.array(F.lit(code))).otherwise(none)
    additional = F.concat("open", some(F.col("n_numeric") == 0, "numeric_expectations"))
    errors = F.concat(
        some(F.col("market_expectation_interpretation").isin(HIGHER, LOWER), "results_are_not_expectations"), some(F.col("reaction_transition").isin(CHANGED, REVERSED), "check_each_stage"),
        some(~F.col("corporate_action_status").eqNullSafe("none_detected"), "no_return_with_corporate_action"),
    )
    metrics = F.array_sort(F.array_distinct(F.concat("below_expectation_metrics", "above_expectation_metrics")))
    checks = F.concat(additional, F.transform(metrics, lambda m: F.concat(F.lit("compare:"), m)), "missing_or_blocked_reasons", "again")
    out = {FIELDS[0]: F.array_distinct("kept"), FIELDS[1]: F.array_distinct("weak"), FIELDS[2]: F.array_distinct(additional), FIELDS[3]: F.array_distinct(errors), FIELDS[4]: F.array_distinct("kept"), FIELDS[5]: F.col("out"), FIELDS[6]: F.array_distinct(checks)}
    return rows.select("review_id", *[c.alias(n) for n, c in out.items()])


def _gathered(rows: DataFrame, by: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """The first ``SHOWN`` distinct values of each group in order of first occurrence, as an array. Groups are ranked in ``SPREAD`` parts first, so that a hot one isn't sorted in one task."""
    once = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__at")).withColumn("__part", F.pmod(F.xxhash64(value), F.lit(SPREAD)))
    rank = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__at", value))
    few = once.withColumn("__rank", rank).filter(F.col("__rank") <= SHOWN)
    return few.groupBy(*by).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(value).alias("v")))), lambda x: x["v"]), 1, SHOWN).alias(name))


def carried_learning(reviews: DataFrame, lists: DataFrame, fields: tuple[str, ...] = CARRIED) -> DataFrame:
    """Per group, field and text: ``occurrence_count`` (reviews that have it), ``place`` in the field's order of first occurrence, and the first ``SHOWN`` review ids in the order of reviews.

    ``reviews``: review_id, group_id, review_no (their order). A review that has a text several times counts once. All ids of a text are rows of ``carried_rows``.
    """
    flat = carried_rows(reviews, lists, fields)
    by = ["group_id", "field", "text"]
    counts = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("occurrence_count"), F.min(F.struct("review_no", "pos")).alias("first"))
    shown = _gathered(flat, by, "review_id", ["review_no"], "source_review_ids")
    place = F.row_number().over(Window.partitionBy("group_id", "field").orderBy("first", "text"))  # a row for each text
    return counts.withColumn("place", place).join(shown, by).select(*by, "place", "occurrence_count", "source_review_ids")


def carried_rows(reviews: DataFrame, lists: DataFrame, fields: tuple[str, ...] = CARRIED) -> DataFrame:
    """A row for each group, field, text and review that has it, with the review's number and the text's first position in it."""
    cells = [F.struct(F.lit(f).alias("field"), F.lit(i).alias("n"), F.col(f).alias("texts")) for i, f in enumerate(fields)]
    flat = lists.select("review_id", F.inline(F.array(*cells))).select("review_id", "field", F.posexplode("texts").alias("pos", "text"))
    return flat.join(reviews.select("review_id", "group_id", "review_no"), "review_id").groupBy("group_id", "field", "text", "review_id").agg(F.min("review_no").alias("review_no"), F.min("pos").alias("pos"))


def divergences(reviews: DataFrame, told: DataFrame) -> DataFrame:
    """Where market and earnings part: per group, assessment, interpretation (the two of a higher or lower hurdle only) and transition the
    number of reviews and events, and the first ``SHOWN`` of both in order. ``reviews``: review_id, event_id, group_id, review_no, earnings."""
    kept = told.filter(F.col("market_expectation_interpretation").isin(HIGHER, LOWER)).select("review_id", "market_expectation_interpretation", "reaction_transition")
    rows = kept.join(reviews.select("review_id", "event_id", "group_id", "review_no", F.col("earnings").alias("earnings_assessment")), "review_id")
    by = ["group_id", "earnings_assessment", "market_expectation_interpretation", "reaction_transition"]
    counts = rows.groupBy(*by).agg(F.countDistinct("review_id").alias("occurrence_count"), F.countDistinct("event_id").alias("n_events"), F.min("review_no").alias("first_no"))
    for value, name in (("review_id", "source_review_ids"), ("event_id", "source_event_ids")):
        counts = counts.join(_gathered(rows, by, value, ["review_no"], name), by)
    return counts


def review_contract(reviews: DataFrame, verifications: DataFrame, numeric: DataFrame, guidance: DataFrame, stages: DataFrame, sources: DataFrame) -> DataFrame:
    """All violations of a review's contract, a row (table, row_number, column, code) for each review and code.

    ``reviews``: row_number, review_id, version, supersedes_review_id, status, next_stage, reviewed_at and the ids of ``PRIMARY``. Ids that items name are
    edges (review, kind, id), resolved against the review's sources by one anti join; ids whose source must be of a type by another.
    """
    kinds = {t: F.col("record_type") == t for t in PRIMARY}
    per = sources.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("record_type", "record_id").alias("n_keys"), F.countDistinct("record_id").alias("n_ids"), F.max("recorded_at").alias("latest"),
        *[F.sum(is_.cast("int")).alias(f"n_{t}") for t, is_ in kinds.items()], *[F.max(F.when(is_, F.col("record_id"))).alias(f"id_{t}") for t, is_ in kinds.items()],
    )
    status, direction, returned = F.col("status"), F.col("direction"), F.col("return_pct").isNotNull()
    staged = stages.groupBy("review_id").agg(
        F.collect_set("stage").alias("stages"), F.count(F.lit(1)).alias("n_stages"), F.max((status == "pending").cast("int")).alias("some_pending"), F.max((status == "not_comparable").cast("int")).alias("some_blocked"), F.min((status == "complete").cast("int")).alias("all_complete"),
        F.max(((status == "complete") & (direction.isin("pending", "not_comparable") | ~returned)).cast("int")).alias("complete_without"), F.max(((status != "complete") & returned).cast("int")).alias("returned"),
        F.max((((status == "pending") & (direction != "pending")) | ((status == "not_comparable") & (direction != "not_comparable"))).cast("int")).alias("other_direction"),
    )
    rows = reviews.join(per, "review_id", "left").join(staged, "review_id", "left")
    yes, zero = lambda c: F.col(c) == 1, lambda c: F.coalesce(c, F.lit(0))
    wrong_next = F.lit(False)
    for word, following in NEXT_STAGE.items():
        wrong_next = wrong_next | ((F.col("status") == word) & (F.col("next_stage") != following))
    wanted = F.array(*[F.lit(s) for s in STAGES])
    counted, differs = F.lit(False), F.lit(False)
    for t, own in PRIMARY.items():
        counted, differs = counted | (zero(f"n_{t}") != 1), differs | ((F.col(f"n_{t}") == 1) & ~F.col(f"id_{t}").eqNullSafe(F.col(own)))
    own = check(
        rows, "review",
        [("supersedes_review_id", "version_chain", (F.col("version") == 1) != F.col("supersedes_review_id").isNull()),
         ("stages", "stage_set", (zero("n_stages") != len(STAGES)) | (F.size(F.array_except(wanted, F.coalesce("stages", wanted.cast("array<string>")))) > 0)), ("sources", "repeated_source", F.col("n") != F.col("n_keys")),
         ("sources", "ambiguous_source_id", F.col("n_ids") != F.col("n")), ("sources", "primary_source_count", counted), ("sources", "primary_source_differs", differs), ("sources", "future_source", F.col("latest") > F.col("reviewed_at")),
         ("stages", "return_missing", yes("complete_without")), ("stages", "return_without_completion", yes("returned")), ("stages", "direction_differs", yes("other_direction")),
         ("status", "complete_without_stages", (F.col("status") == "complete") & (zero("all_complete") != 1)), ("status", "provisional_without_pending", (F.col("status") == "provisional") & (zero("some_pending") != 1)),
         ("status", "blocked_without_reason", (F.col("status") == "blocked") & (zero("some_blocked") != 1)), ("next_stage", "next_stage", wrong_next)],
    )
    at = reviews.select("review_id", "row_number", "evaluation_id", "tracking_id")
    named = lambda df, column, kind, id: df.select("review_id", F.lit(column).alias("column"), F.lit(kind).alias("kind"), id.alias("id"))
    cited = named(verifications.select("review_id", F.explode("source_ids").alias("id")), "verifications", "cited", F.col("id"))
    edges = [named(df, n, "cited", F.col("source_id")) for n, df in (("numeric", numeric), ("guidance", guidance), ("stages", stages))]
    typed = named(verifications, "verifications", "pre_event_hypothesis", F.col("hypothesis_id")).unionByName(
        named(verifications.select("review_id", F.explode("invalidation_ids").alias("id")), "invalidations", "hypothesis_invalidation", F.col("id")))
    for e in edges:
        cited = cited.unionByName(e)
    cited, typed = cited.distinct(), typed.distinct()
    open_ = cited.join(sources.select("review_id", F.col("record_id").alias("id")).distinct(), ["review_id", "id"], "left_anti").withColumn("code", F.lit("unresolved_reference"))
    other = typed.join(sources.select("review_id", F.col("record_id").alias("id"), F.col("record_type").alias("kind")).distinct(), ["review_id", "id", "kind"], "left_anti").withColumn("code", F.concat(F.lit("not_a_"), "kind"))
    # Which of the primary sources items must name.
    must = [(numeric, "numeric", "evaluation_id"), (guidance, "guidance", "evaluation_id"), (stages, "stages", "tracking_id")]
    strays = [df.join(at, "review_id").filter(~F.col("source_id").eqNullSafe(F.col(own_id))).select("review_id", F.lit(n).alias("column"), F.lit("other_primary_source").alias("code")) for df, n, own_id in must]
    uncited = verifications.join(at, "review_id").filter(~(F.array_contains("source_ids", F.col("hypothesis_id")) & F.array_contains("source_ids", F.col("evaluation_id")))).select("review_id", F.lit("verifications").alias("column"), F.lit("uncited_source").alias("code"))
    found = report([d.select("review_id", "column", "code") for d in (open_, other, *strays, uncited)]).distinct()
    linked = found.join(at, "review_id").select(F.lit("review").alias("table"), F.col("row_number").cast("long").alias("row_number"), "column", "code")
    return report([own, linked]).select(*[c.split()[0] for c in SCHEMA.split(", ")])
