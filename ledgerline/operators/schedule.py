"""Which monitor targets run when: observed announcement dates, the active plan, stale targets, acknowledged gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar
from .issues import check


def observed_dates(targets: DataFrame, checkpoints: DataFrame, on_or_after: Column) -> DataFrame:
    """(target, observed): the next date that a target's schedule source has published; targets whose source published none have no row."""
    published = checkpoints.select(F.col("target").alias("schedule_source"), "schedule")
    rows = targets.filter("schedule_source is not null").join(published, "schedule_source")
    return rows.select("target", calendar.next_date(F.col("schedule"), on_or_after).alias("observed")).filter("observed is not null")


def unresolved_sources(targets: DataFrame, observed: DataFrame) -> DataFrame:
    """Targets with a schedule source that has no date for them."""
    return targets.filter("schedule_source is not null").select("target", "schedule_source").join(observed.select("target"), "target", "left_anti")


def active_plan(targets: DataFrame, planned_at: Column, observed: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Enabled, activated and approved level 2 targets that are due; what a schedule source published goes before the target's own date."""
    active = targets.filter(F.col("enabled") & (F.col("activation_state") == "activated") & (F.col("monitoring_level") == "level_2") & F.col("access_permitted"))
    if observed is not None:
        active = active.join(observed, "target", "left").withColumn("event_date", F.coalesce("observed", "event_date")).drop("observed")
    return active if force else active.filter(calendar.is_due(planned_at, F.col("event_date")))


def stale_failures(rows: DataFrame, now: Column) -> DataFrame:
    """Stale targets as failed observations (target, reference, event_date, event_required): a fatal error with the limit it passed."""
    today = calendar.local_time(now).cast("date")
    window = calendar.stale_window(today, F.col("event_date"), F.col("event_required"))
    stale = rows.withColumn("window", window).filter(calendar.is_stale(F.col("reference"), now, F.col("window")))
    hours = F.coalesce(*[F.when(F.col("window") == w, F.lit(h)) for w, h in calendar.STALE_HOURS.items()])
    # The code and wording of such a failure.
    detail = F.format_string("stale gap exceeded %d-hour %s threshold", hours, F.col("window"))
    return stale.select("target", F.lit("state_unavailable").alias("error_code"), detail.alias("error_detail"), F.lit(False).alias("succeeded"))


def new_acknowledgements(acknowledgements: DataFrame, checkpoints: DataFrame, started_at: Column) -> DataFrame:
    """New acknowledgements of gaps need a target that stopped because it was stale, a past time, and a gap that no success has closed."""
    rows = acknowledgements.join(checkpoints.select("target", "state", "error_code", "last_success_at"), "target", "left")
    stopped = (F.col("state") == "stopped") & (F.col("error_code") == "state_unavailable")
    return check(
        rows, "monitor_gap_acknowledgement",
        [("target", "not_stale", ~F.coalesce(stopped, F.lit(False))), ("acknowledged_at", "from_later", F.col("acknowledged_at").isNull() | (F.col("acknowledged_at") > started_at)),
         ("gap_end", "gap_closed", F.col("gap_end").isNull() | F.coalesce(F.col("gap_end") < F.col("last_success_at"), F.lit(False)))],
    )
