"""Post-event review: verified hypotheses, market stages, reasons, learning lists and version chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import short_id
from .issues import check


def market_stages(tracking: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """A row per stage of each tracking: direction and return."""
    cells = [F.struct(F.lit(s).alias("stage"), F.lit(i).alias("stage_no"), F.col(f"{s}_dir").alias("direction"), F.col(f"{s}_pct").alias("pct")) for i, s in enumerate(stages)]
    return tracking.select("announcement_id", F.inline(F.array(*cells)))


def review_state(directions: list[Column]) -> Column:
    some = lambda word: F.coalesce(*[F.when(d == word, F.lit(True)) for d in directions], F.lit(False))
    return F.when(some("not_comparable"), "blocked").when(some("pending"), "provisional").otherwise("complete")


def forecast_result(verified: DataFrame, key: str, reviews: DataFrame | None = None) -> DataFrame:
    """``success``, ``failure``, ``partial_success`` or ``pending`` by what the hypotheses (key, result) came to; of ``reviews`` (key) those without any are pending too."""
    sets = verified.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("result") == r).cast("int")).alias(r) for r in ("supported", "invalidated", "pending")])
    word = F.when(F.col("n") == F.col("pending"), "pending").when(F.col("n") == F.col("supported"), "success").when(F.col("n") == F.col("invalidated"), "failure").otherwise("partial_success")
    out = sets.select(key, word.alias("forecast_result"))
    return out if reviews is None else reviews.select(key).distinct().join(out, key, "left").select(key, F.coalesce("forecast_result", F.lit("pending")).alias("forecast_result"))


# The words of reviews.
HIGHER, LOWER, ALIGNED = "possible_higher_hurdle_than_recorded", "possible_lower_hurdle_than_recorded", "earnings_and_market_aligned"
REVERSED, CHANGED = "reversed_by_fifth_business_day", "changed_by_next_business_day"


def interpretation(earnings: Column, immediate: Column) -> Column:
    """What the market's first move says about its expectation; later stages may still be pending."""
    return (
        F.when(immediate == "not_comparable", "not_comparable")
        .when((immediate == "pending") | (earnings == "inconclusive") | (immediate == "muted"), "insufficient_evidence")
        .when((earnings == "positive") & (immediate == "negative"), HIGHER)
        .when((earnings == "negative") & (immediate == "positive"), LOWER)
        .otherwise(ALIGNED)
    )


def transition(path: Column, directions: list[Column]) -> Column:
    first, second, third = directions
    some_pending = (first == "pending") | (second == "pending") | (third == "pending")
    return (
        F.when(path == "reversed", REVERSED).when(first == "not_comparable", "not_comparable").when(some_pending, "pending")
        .when((second != first) & ~second.isin("muted", "pending"), CHANGED).when((first == second) & (second == third), "same_direction").otherwise("mixed")
    )


def ids_by_result(verified: DataFrame, key: str) -> DataFrame:
    """Hypothesis ids of each result as ordered lists: what the reasons point to."""
    pick = lambda r: F.array_sort(F.collect_set(F.when(F.col("result") == r, F.col("hypothesis_id"))))
    return verified.groupBy(key).agg(pick("supported").alias("supported_ids"), pick("invalidated").alias("rejected_ids"), pick("pending").alias("pending_ids"))


def learning(rows: DataFrame, columns: list[str]) -> Column:
    """Several lists as one, each text once, in order of first occurrence."""
    return F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]))


def version_chain(reviews: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Version and superseded id of each review among those of its key."""
    by = Window.partitionBy(*key).orderBy(*order)
    rows = reviews.withColumn("version", F.row_number().over(by).cast("long"))
    rows = rows.withColumn("review_id", short_id("PEL-", [*[F.col(k).cast("string") for k in key], F.col("version").cast("string")]))
    return rows.withColumn("supersedes_review_id", F.lag("review_id").over(by))


def contract(reviews: DataFrame) -> DataFrame:
    """What a review must hold: distinct sources, none from later, and a state that fits its stages."""
    return check(
        reviews, "review",
        [("sources", "repeated_source", F.size("sources") != F.size(F.array_distinct("sources"))), ("source_time", "future_source", F.col("source_time") > F.col("reviewed_at")),
         ("state", "state_differs", F.col("state") != review_state([F.col(f"dir{i}") for i in range(3)]))],
    )


def aggregate_learning(reviews: DataFrame, fields: list[str]) -> DataFrame:
    """Per field and text: how many reviews have it, and the first of them. A text that most reviews share gathers no list; see ``learning_reviews``."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).alias("texts")) for f in fields]
    flat = reviews.select("review_id", F.inline(F.array(*cells))).select("review_id", "field", F.explode("texts").alias("text"))
    once = flat.groupBy("field", "text", "review_id").agg(F.lit(1).alias("one"))
    return once.groupBy("field", "text").agg(F.count("one").alias("n_reviews"), F.min("review_id").alias("first_review_id"))


def learning_reviews(reviews: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each (field, text, review) with the review's place among those that have the text: the ordered list as rows."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).alias("texts")) for f in fields]
    return reviews.select("review_id", F.inline(F.array(*cells))).select("review_id", "field", F.explode("texts").alias("text")).distinct()


def aggregate_divergences(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Reviews and events of each combination; ``learning.divergences`` has the lists of those whose market parted from the earnings."""
    return reviews.groupBy(*by).agg(F.countDistinct("review_id").alias("n_reviews"), F.countDistinct("event_id").alias("n_events"))


def carryover_gates(reviews: DataFrame, prepared_at: Column) -> DataFrame:
    """Reviews that can't be carried over: repeated, of another company than the rest of their group, or from later."""
    ids = reviews.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    companies = reviews.groupBy("group_id").agg(F.countDistinct("company_id").alias("companies"))
    rows = reviews.join(ids, "review_id").join(companies, "group_id")
    return check(rows, "review", [("review_id", "repeated_review", F.col("n") > 1), ("company_id", "several_companies", F.col("companies") > 1), ("reviewed_at", "from_later", F.col("reviewed_at") > prepared_at)])
