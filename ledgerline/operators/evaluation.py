"""Evaluation of results against what was expected, by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import short_id


def eligible_baselines(baselines: DataFrame) -> DataFrame:
    """Locked baselines with a lock time that don't use later data."""
    return baselines.filter((F.col("baseline_status") == "locked") & ~F.col("uses_post_event_data") & F.col("locked_at").isNotNull())


def eligible_hypotheses(hypotheses: DataFrame, baselines: DataFrame) -> DataFrame:
    """Open pre-event hypotheses written no later than the event's baseline was locked."""
    locks = eligible_baselines(baselines).groupBy("event_id").agg(F.max("locked_at").alias("__lock"))
    return hypotheses.filter(F.col("stage").eqNullSafe("pre_event") & F.col("status").isin("active", "pending")).join(locks, "event_id").filter(F.col("created_at") <= F.col("__lock")).drop("__lock")


def pct_change(actual: Column, expected: Column) -> Column:
    """Percent of the expected value's size; null where nothing was expected."""
    return F.when(expected != 0, (actual - expected) / F.abs(expected) * 100)


def band(pct: Column, tolerance: float = 1.0) -> Column:
    """``above``, ``below`` or ``in_line``, which an unknown change is too."""
    return F.when(pct.isNull() | (F.abs(pct) <= tolerance), "in_line").when(pct > 0, "above").otherwise("below")


def revision(actual: Column, expected: Column, tolerance: float = 1.0) -> Column:
    pct = pct_change(actual, expected)
    return F.when(pct.isNull() | (F.abs(pct) <= tolerance), "unchanged").when(pct > 0, "up").otherwise("down")


def progress(actual: Column, forecast: Column) -> Column:
    """Share of the full-year forecast reached, in percent."""
    return F.when(forecast != 0, actual / F.abs(forecast) * 100)


def last_metrics(metrics: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """The last metric of each kind and name."""
    rest = [c for c in metrics.columns if c not in by]
    return metrics.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("m")).select(*by, "m.*")


def consensus_comparison(expected: DataFrame, actual: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(comparisons where scope and unit agree, expected rows without one: the limitations)."""
    both = expected.alias("e").join(actual.alias("a"), [F.col(f"e.{k}") == F.col(f"a.{k}") for k in keys] + [F.col("e.scope") == F.col("a.scope"), F.col("e.unit") == F.col("a.unit")])
    pct = pct_change(F.col("a.value"), F.col("e.value"))
    compared = both.select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.value").alias("expected"), F.col("a.value").alias("actual"), pct.alias("pct"), band(pct).alias("band"))
    return compared, expected.join(compared.select(*keys), keys, "left_anti")


def segment_rollup(segments: DataFrame, by: list[str], order: str) -> DataFrame:
    """First revenue and first profit of each category, with the profit's sign; a category without a profit is only reported."""
    rows = segments.groupBy(*by).agg(F.min_by("revenue", F.when(F.col("revenue").isNotNull(), F.col(order))).alias("revenue"), F.min_by("profit", F.when(F.col("profit").isNotNull(), F.col(order))).alias("profit"))
    return rows.withColumn("result", F.when(F.col("profit").isNull(), "reported_only").when(F.col("profit") > 0, "profit").when(F.col("profit") < 0, "loss").otherwise("even"))


def hypothesis_links(hypotheses: DataFrame, findings: DataFrame, on: str) -> DataFrame:
    """(hypothesis_id, finding_id) of those of one ``on`` (the event) that share a token; tokens are arrays without stop words.

    Equi-join on the exploded tokens, each pair once. Without the event a frequent token would pair all with all.
    """
    left = hypotheses.select("hypothesis_id", on, F.explode(F.array_distinct("tokens")).alias("token"))
    right = findings.select("finding_id", on, F.explode(F.array_distinct("tokens")).alias("token"))
    return left.join(right, [on, "token"]).select("hypothesis_id", "finding_id").distinct()


def hypothesis_results(hypotheses: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """``supported``, ``invalidated``, ``mixed`` or ``pending`` for each hypothesis (hypothesis_id, direction)."""
    votes = links.join(findings.select("finding_id", F.col("direction").alias("f")), "finding_id").join(hypotheses.select("hypothesis_id", "direction"), "hypothesis_id")
    sums = votes.groupBy("hypothesis_id").agg(F.sum("f").alias("net"), F.sum((F.col("f") == F.col("direction")).cast("int")).alias("same"), F.sum((F.col("f") == -F.col("direction")).cast("int")).alias("against"))
    d, net = F.col("direction"), F.signum("net")
    result = (
        F.when(F.col("net").isNull() | (d == 0), "pending")
        .when((F.col("same") > 0) & (F.col("against") == 0) & (net == d), "supported")
        .when((F.col("against") > 0) & (F.col("same") == 0) & (net == -d), "invalidated")
        .otherwise("mixed")
    )
    return hypotheses.select("hypothesis_id", "direction").join(sums, "hypothesis_id", "left").select("hypothesis_id", result.alias("result"))


def dimension_votes(votes: DataFrame) -> DataFrame:
    """Sign of the vote sum of each (event_id, dimension)."""
    return votes.groupBy("event_id", "dimension").agg(F.signum(F.sum("vote")).cast("int").alias("sign"))


def overall(events: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``positive``, ``negative``, ``mixed`` or ``in_line`` by the sum of dimensions, ``inconclusive`` without any."""
    sums = dimensions.groupBy("event_id").agg(F.sum("sign").alias("s"), F.max(F.abs("sign")).alias("any"))
    word = F.when(F.col("s").isNull(), "inconclusive").when(F.col("s") > 0, "positive").when(F.col("s") < 0, "negative").when(F.col("any") > 0, "mixed").otherwise("in_line")
    return events.select("event_id").distinct().join(sums, "event_id", "left").select("event_id", word.alias("overall"))


# The scope of a company's forecast, and what follows an evaluation.
FULL_YEAR = "full_year"
NEXT = {True: "ready_for_market_reaction_tracking", False: "evaluation_not_available"}


def metric_rows(events: DataFrame, expected: DataFrame, reported: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """A row for each event and expected metric: its comparison with the consensus, the guidance's revision, the progress, and the limitations (codes) that kept one of them out.

    ``events``: event_id, expected_scope. ``expected``: event_id, pos, metric, unit, consensus, guidance. ``reported``: event_id, metric, kind ('actual' or 'forecast'), pos,
    value, unit, scope, of which the last of a kind counts. An actual in another unit is no actual; one of another period is only compared with the forecast. A forecast
    that isn't the full year's, or in another unit, is none.
    """
    last = last_metrics(reported, ["event_id", "metric", "kind"])
    of = lambda kind, p: last.filter(F.col("kind") == kind).select("event_id", "metric", *[F.col(c).alias(f"{p}_{c}") for c in ("value", "unit", "scope")])
    rows = expected.join(events.select("event_id", "expected_scope"), "event_id").join(of("actual", "a"), ["event_id", "metric"], "left").join(of("forecast", "f"), ["event_id", "metric"], "left")
    right = lambda p: F.col(f"{p}_unit").eqNullSafe(F.col("unit"))
    actual, fits = F.when(right("a"), F.col("a_value")), F.col("a_scope").eqNullSafe(F.col("expected_scope"))
    forecast = F.when(right("f") & (F.col("f_scope") == FULL_YEAR), F.col("f_value"))
    rows = rows.withColumns({"actual": actual, "forecast": forecast})
    compared = F.col("actual").isNotNull() & F.col("consensus").isNotNull()
    pct, change = pct_change(F.col("actual"), F.col("consensus")), pct_change(F.col("forecast"), F.col("guidance"))
    limits = F.array_compact(F.array(
        F.when(F.col("a_value").isNotNull() & ~right("a"), F.concat("metric", F.lit(":actual_unit"))), F.when(compared & ~fits, F.concat("metric", F.lit(":period"))),
        F.when(F.col("f_value").isNotNull() & F.col("forecast").isNull(), F.concat("metric", F.lit(":forecast"))),
    ))
    return rows.select(
        "event_id", "pos", "metric", F.when(compared & fits, pct).alias("difference_pct"), F.when(compared & fits, band(pct, tolerance)).alias("result"), F.when(F.col("forecast").isNotNull() & F.col("guidance").isNotNull(), change).alias("revision_pct"),
        F.when(F.col("forecast").isNotNull() & F.col("guidance").isNotNull(), revision(F.col("forecast"), F.col("guidance"), tolerance)).alias("revision"), F.when(F.col("actual").isNotNull(), progress(F.col("actual"), F.col("forecast"))).alias("progress_pct"), limits.alias("limitations"),
    )


def evaluations(events: DataFrame, metrics: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """One row for each event: evaluation_id, counts, dimensions, overall, status, limitations (each once, in the metrics' order) and what comes next.

    ``metrics``: the result of ``metric_rows``; they vote as 'market_expectation' and 'company_guidance'. ``votes`` (event_id, dimension, vote) adds other dimensions, such as
    explanations and hypotheses. An event without any vote is evaluated as insufficient data.
    """
    sign = lambda c, up, down: F.when(F.col(c) == up, 1).when(F.col(c) == down, -1).when(F.col(c).isNotNull(), 0)
    own = metrics.select("event_id", F.inline(F.array(F.struct(F.lit("market_expectation").alias("dimension"), sign("result", "above", "below").alias("vote")), F.struct(F.lit("company_guidance").alias("dimension"), sign("revision", "up", "down").alias("vote"))))).filter("vote is not null")
    signs = dimension_votes(own if votes is None else own.unionByName(votes.select("event_id", "dimension", "vote")))
    named = signs.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("dimension", "sign"))).alias("dimensions"))  # a few of each event
    ordered = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "metric", "limitations"))), lambda m: m["limitations"])))
    counts = metrics.groupBy("event_id").agg(F.count("result").alias("n_comparisons"), F.count("revision").alias("n_guidance"), F.count("progress_pct").alias("n_progress"), ordered.alias("limitations"))
    rows = events.join(overall(events, signs), "event_id").join(named, "event_id", "left").join(counts, "event_id", "left")
    evaluated = F.col("overall") != "inconclusive"
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_comparisons", "n_guidance", "n_progress")}
    return rows.withColumns(zero).select(
        "event_id", short_id("EE-", [F.col("baseline_id"), F.col("analysis_id")]).alias("evaluation_id"), *zero, F.coalesce("dimensions", F.array().cast("array<struct<dimension:string,sign:int>>")).alias("dimensions"), "overall",
        F.when(evaluated, "evaluated").otherwise("insufficient_data").alias("status"), F.coalesce("limitations", F.array().cast("array<string>")).alias("limitations"), F.when(evaluated, NEXT[True]).otherwise(NEXT[False]).alias("next_stage"),
    )
