"""Monitor records: run lineage, replayed state, changes to resolve, episodes of errors, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .issues import check
from .lineage import with_parent
from .rowchecks import is_authorizer, is_human

# Errors after which a target stops at once, and that of a page whose indicators changed but not its metadata.
FATAL = ("state_unavailable", "persistence_error")
AMBIGUOUS = "content_ambiguous"
#: What a server says of a page beside its content, and the fields that a change is told by.
INDICATORS = ("etag", "last_modified", "content_length")
CHANGE_FIELDS = ("document_id", "title", "published_at")


#: A target's rows are read in blocks of so many row numbers, each by itself; what came before a block is carried into it.
BLOCK = 1_000_000


def in_blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """``df`` with ``block``. Row numbers are those of a table, so that no target has more than ``size`` rows in a block."""
    return df.withColumn("block", F.floor(F.col("row_number") / size).cast("long"))


def carried(rows: DataFrame, summary: list[Column], carry: dict[str, Column], first: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (target, block, …) with the columns of ``carry`` in ``__before``: what the target's earlier blocks sum up to.

    ``summary``: aggregates of a block, map-side first. ``carry``: columns over the summaries of the blocks before; ``first``
    adds columns to the summaries beforehand, such as ones that look at the block before. A hot target has one summary for each block, not row.
    """
    blocks = rows.groupBy("target", "block").agg(*summary)
    for name, column in (first or {}).items():
        blocks = blocks.withColumn(name, column)
    before = blocks.select(F.col("target").alias("__target"), F.col("block").alias("__block"), F.struct(*[c.alias(n) for n, c in carry.items()]).alias("__before"))
    return rows.join(before, F.col("target").eqNullSafe(F.col("__target")) & (F.col("block") == F.col("__block"))).drop("__target", "__block")


def _windows() -> tuple:
    """Over the blocks of a target, those before one; over the rows of a block, those before one, and up to one."""
    blocks, inside = Window.partitionBy("target").orderBy("block"), Window.partitionBy("target", "block").orderBy("row_number")
    return blocks, blocks.rowsBetween(Window.unboundedPreceding, -1), inside, inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)


def run_lineage(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Previous ids, times, fingerprints and versions must continue those of the runs before, per target.

    Windows are by target and block; a block begins with what the blocks before it end with.
    """
    _, earlier, inside, until, _ = _windows()
    good, done = F.when(F.col("succeeded"), F.col("fingerprint_after")), F.when(F.col("committed"), F.col("version_after"))
    latest = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("row_number")))
    rows = carried(
        in_blocks(runs, block), [F.max_by(F.struct("run_id", "finished_at"), "row_number").alias("last"), latest(good).alias("fp"), latest(done).alias("version")],
        {n: F.last(n, ignorenulls=True).over(earlier) for n in ("last", "fp", "version")},
    )
    begins = F.row_number().over(inside) == 1
    rows = rows.withColumns({
        "__id": F.when(begins, F.col("__before.last.run_id")).otherwise(F.lag("run_id").over(inside)), "__end": F.when(begins, F.col("__before.last.finished_at")).otherwise(F.lag("finished_at").over(inside)),
        "__fp": F.coalesce(F.last(good, ignorenulls=True).over(until), "__before.fp"), "__version": F.coalesce(F.last(done, ignorenulls=True).over(until), "__before.version", F.lit(0)),
    })
    return check(
        rows, "monitor_run",
        [("previous_run_id", "not_previous", ~F.col("previous_run_id").eqNullSafe(F.col("__id"))), ("started_at", "overlap", F.col("started_at") < F.col("__end")),
         ("result", "first_not_initialized", F.col("__id").isNull() & (F.col("result") != "initialized")), ("result", "initialized_again", F.col("__id").isNotNull() & (F.col("result") == "initialized")),
         ("fingerprint_before", "fingerprint_gap", ~F.col("fingerprint_before").eqNullSafe(F.col("__fp"))), ("version_after", "version_gap", F.col("committed") & (F.col("version_after") != F.col("__version") + 1))],
    )


def replay(runs: DataFrame) -> DataFrame:
    """State of each target after its runs: one aggregate, no window."""
    done, good = F.when(F.col("committed"), F.col("row_number")), F.when(F.col("committed") & F.col("succeeded"), F.col("row_number"))
    return runs.groupBy("target").agg(
        F.max_by("version_after", done).alias("version"), F.max_by("run_id", done).alias("last_run_id"), F.max_by("finished_at", done).alias("last_checked_at"),
        F.max_by("finished_at", good).alias("last_success_at"), F.max_by("fingerprint_after", good).alias("fingerprint"), F.max_by("error_code", done).alias("error_code"),
    )


def checkpoint_differences(checkpoints: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """Checkpoints that don't equal the replayed state, by column; targets that only one side has."""
    c, s = checkpoints.alias("c"), state.alias("s")
    joined = c.join(s, F.col("c.target") == F.col("s.target"), "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")), F.lit(x)) for x in columns]))
    only = F.when(F.col("s.target").isNull(), F.array(F.lit("no_runs"))).when(F.col("c.target").isNull(), F.array(F.lit("no_checkpoint"))).otherwise(differ)
    return joined.select(F.coalesce("c.target", "s.target").alias("target"), F.explode(only).alias("difference"))


def unresolved_changes(runs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Per target, changes without a resolution: how many, the first and the newest, which is pending."""
    open_ = runs.filter("result = 'change_detected'").join(resolutions.select("run_id").distinct(), "run_id", "left_anti")
    return open_.groupBy("target").agg(F.count(F.lit(1)).alias("n_open"), F.min_by("run_id", "row_number").alias("first_run_id"), F.max_by("run_id", "row_number").alias("pending_run_id"))


def resolution_rules(resolutions: DataFrame, runs: DataFrame) -> DataFrame:
    """A resolution names a change of its own target and comes after it finished."""
    r = runs.select(F.col("run_id"), F.col("target").alias("__target"), F.col("result").alias("__result"), F.col("finished_at").alias("__end"))
    rows = resolutions.join(r, "run_id", "left")
    return check(
        rows, "monitor_resolution",
        [("run_id", "missing_run", F.col("__target").isNull()), ("run_id", "not_a_change", F.col("__result") != "change_detected"), ("run_id", "other_target", F.col("__target") != F.col("target")),
         ("resolved_at", "before_run", F.col("resolved_at") < F.col("__end"))],
    )


def error_episodes(runs: DataFrame) -> DataFrame:
    """Trailing runs of each target with the same error: code, length and first run. Two aggregates, no window.

    The island begins after the last row whose code differs from the latest.
    """
    last = runs.groupBy("target").agg(F.max_by(F.struct(F.coalesce("error_code", F.lit("")).alias("code")), "row_number").alias("l")).select("target", "l.code")
    rows = runs.join(last, "target").withColumn("same", F.coalesce("error_code", F.lit("")) == F.col("code"))
    edge = rows.groupBy("target").agg(F.max(F.when(~F.col("same"), F.col("row_number"))).alias("edge"))
    tail = rows.filter("code <> ''").join(edge, "target").filter(F.col("edge").isNull() | (F.col("row_number") > F.col("edge")))
    return tail.groupBy("target", "code").agg(F.count(F.lit(1)).alias("length"), F.min_by("run_id", "row_number").alias("episode_id"))


def transitions(observations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The batch twin of the stream: each observation's result, version, error and its count, state, indicators' level and change summary.

    ``succeeded`` says that the page was read. The page before is the last that was, whether it was ambiguous or not: a
    success and a reported ambiguity both leave their indicators for the next comparison, so each ambiguity is reported once.
    Columns of ``INDICATORS`` and ``CHANGE_FIELDS`` that aren't given don't count; with ``autonomous`` true a change waits for no one.

    A target's rows are read in blocks. Two rounds of summaries carry the page before and the count of rows into a block, then the
    error that it begins with, where that error's island began, and whether a change is pending.
    """
    blocks, earlier, inside, until, upto = _windows()
    marks, fields = ([c for c in names if c in observations.columns] for names in (INDICATORS, CHANGE_FIELDS))
    page = F.when(F.col("succeeded"), F.struct("fingerprint", *marks, *fields))
    rows = carried(
        in_blocks(observations, block), [F.max_by(page, F.when(F.col("succeeded"), F.col("row_number"))).alias("old"), F.count(F.lit(1)).alias("n")],
        {"old": F.last("old", ignorenulls=True).over(earlier), "n": F.coalesce(F.sum("n").over(earlier), F.lit(0))},
    )
    rows = rows.withColumn("__old", F.coalesce(F.last(page, ignorenulls=True).over(until), "__before.old"))
    rows = rows.withColumn("fingerprint_before", F.col("__old.fingerprint")).withColumn("version_after", (F.col("__before.n") + F.row_number().over(inside)).cast("long")).drop("__before")
    same = F.col("fingerprint_before") == F.col("fingerprint")
    moved = replacement_suspected([(F.col(f"__old.{m}"), F.col(m)) for m in marks])
    result = (
        F.when(~F.col("succeeded") | (same & moved), "error").when(F.col("fingerprint_before").isNull(), "initialized")
        .when(same, "no_change").otherwise("change_detected")
    )
    rows = rows.withColumn("result", result).withColumn("error", F.when(~F.col("succeeded"), F.col("error_code")).when(F.col("result") == "error", AMBIGUOUS))
    summary = change_summary([(f, F.col(f"__old.{f}"), F.col(f)) for f in fields])
    rows = rows.withColumn("summary", F.when(F.col("result") == "change_detected", summary)).withColumn("replacement_detection", replacement_detection([F.col(m) for m in marks]))
    waits = (F.col("result") == "change_detected") & ~(F.col("autonomous") if "autonomous" in observations.columns else F.lit(False))
    # Islands of one error: the count begins anew where the row before had another one.
    begins = F.row_number().over(inside) == 1
    rows = rows.withColumn("__waits", waits.cast("int")).withColumn("__inside", F.when(~begins & ~F.col("error").eqNullSafe(F.lag("error").over(inside)), F.col("version_after")))
    own = F.struct(F.coalesce("error", F.lit("")).alias("error"), "version_after")
    first, last = F.col("first_row"), F.lag("last_row").over(blocks)
    rows = carried(
        rows, [F.min_by(own, "row_number").alias("first_row"), F.max_by(own, "row_number").alias("last_row"), F.max("__inside").alias("inside"), F.max("__waits").alias("waits")],
        {"start": F.last("start", ignorenulls=True).over(earlier), "opening": F.col("opening"), "waits": F.max("waits").over(earlier)},
        {"opening": F.when(last.isNull() | (last["error"] != first["error"]), first["version_after"]), "start": F.coalesce("inside", "opening")},
    )
    start = F.coalesce(F.max("__inside").over(upto), "__before.opening", "__before.start", F.lit(1))
    rows = rows.withColumn("error_count", F.when(F.col("error").isNull(), 0).otherwise(F.col("version_after") - start + 1).cast("long"))
    rows = rows.withColumn("__pending", F.greatest(F.max("__waits").over(upto), "__before.waits"))
    return rows.withColumn("state", error_state(F.col("error"), F.col("__pending") == 1)).drop("__old", "__inside", "__waits", "__before", "__pending", "block")


def error_state(error: Column, pending: Column, fatal: tuple[str, ...] = FATAL) -> Column:
    """A fatal error stops a target; else a pending change is kept; else an error degrades it."""
    return F.when(error.isin(*fatal), "stopped").when(pending, "pending_human_review").when(error.isNotNull(), "degraded").otherwise("healthy")


def replacement_detection(indicators: list[Column]) -> Column:
    """How well a replaced page could be told: by all indicators, some, or none."""
    present = sum((c.isNotNull().cast("int") for c in indicators), F.lit(0))
    return F.when(F.lit(bool(indicators)) & (present == len(indicators)), "available").when(present > 0, "partial").otherwise("unavailable")


def schedule_summary(dated: Column, vague: Column) -> Column:
    """The dated and the month-only rows of a schedule as one field; blanks and ``none`` are left out."""
    return F.array_join(F.filter(F.array(dated, vague), lambda p: p.isNotNull() & ~p.isin("", "none")), " | ")


def replacement_suspected(indicators: list[tuple[Column, Column]]) -> Column:
    """A known indicator (ETag, length, time) differs from the one before."""
    out = F.lit(False)
    for old, new in indicators:
        out = out | (old.isNotNull() & ~old.eqNullSafe(new))
    return out


def change_summary(fields: list[tuple[str, Column, Column]]) -> Column:
    """Which of the fields changed; of none of them, the stable metadata did."""
    names = F.concat_ws(", ", F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, a, b in fields], F.lit(None).cast("string"))))
    return F.concat(F.lit("Changed metadata fields: "), F.when(names == "", "stable_metadata").otherwise(names))


def current_state(states: DataFrame, key: str = "target", version: str = "version", attempt: str = "attempt") -> DataFrame:
    """The state of the greatest (version, attempt) per key, with how many rows tie for it."""
    top = states.groupBy(key).agg(F.max(F.struct(version, attempt)).alias("top")).select(key, F.col(f"top.{version}").alias(version), F.col(f"top.{attempt}").alias(attempt))
    return states.join(top, [key, version, attempt]).groupBy(key, version, attempt).agg(F.count(F.lit(1)).alias("ties"))


def initial_activation(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """First runs that their target's activation doesn't authorise. ``targets``: target, activation_state, enabled, access_permitted,
    approved_by, initialization_generation, initialization_run_id, activated_at."""
    first = runs.groupBy("target").agg(F.min_by(F.struct("row_number", "run_id", "started_at"), "row_number").alias("r")).select("target", "r.*")
    rows = first.join(targets, "target", "left")
    authorised = (
        (F.col("activation_state") == "activated") & F.col("enabled") & F.col("access_permitted") & is_authorizer(F.col("approved_by"))
        & (F.col("initialization_generation") == 1) & (F.col("initialization_run_id") == F.col("run_id")) & (F.col("activated_at") <= F.col("started_at"))
    )
    return check(rows, "monitor_run", [("run_id", "not_authorised", ~F.coalesce(authorised, F.lit(False)))])


def initialized_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every initialising run must agree with the activation that its target records; runs of unknown targets aren't judged."""
    rows = runs.filter("result = 'initialized'").join(targets, "target")
    agrees = (
        (F.col("activation_state") == "activated") & F.col("enabled") & F.col("access_permitted") & F.col("initialization_generation").eqNullSafe(F.col("generation"))
        & (F.col("initialization_run_id") == F.col("run_id")) & (F.col("activated_at") <= F.col("started_at"))
    )
    return check(rows, "monitor_run", [("result", "no_matching_activation", ~F.coalesce(agrees, F.lit(False)))])


def target_companies(targets: DataFrame, events: DataFrame) -> DataFrame:
    """Targets whose event is of another company."""
    rows = targets.join(events.select("event_id", F.col("company_id").alias("__company")), "event_id")
    return check(rows, "monitor_target", [("event_id", "other_company", F.col("company_id") != F.col("__company"))])


def state_expectations(checkpoints: DataFrame, runs: DataFrame, resolutions: DataFrame, targets: DataFrame) -> DataFrame:
    """Pending pointers and states of checkpoints against the runs: what waits must be kept, what is resolved must not, and a
    disabled target can't be active. ``checkpoints``: row_number, target, pending_run_id, state, resolution_id; ``targets``: target, enabled, autonomous."""
    open_ = unresolved_changes(runs, resolutions).select("target", F.col("pending_run_id").alias("__open"))
    last = runs.filter("committed").groupBy("target").agg(F.max_by(F.struct("error_code"), "row_number").alias("e"), F.max((F.col("result") == "change_detected").cast("int")).alias("__changed"))
    rows = checkpoints.join(targets.select("target", "enabled", "autonomous"), "target").join(open_, "target", "left").join(last, "target", "left")
    waiting, state = F.col("__open").isNotNull() & ~F.col("autonomous"), F.col("state")
    fatal = F.coalesce(F.col("e.error_code").isin(*FATAL), F.lit(False))
    return check(
        rows, "monitor_checkpoint",
        [("pending_run_id", "pending_lost", waiting & ~F.col("pending_run_id").eqNullSafe(F.col("__open"))), ("state", "not_pending", waiting & (state != F.when(fatal, "stopped").otherwise("pending_human_review"))),
         ("pending_run_id", "pending_kept", ~waiting & F.col("pending_run_id").isNotNull()), ("state", "pending_without_change", ~waiting & (state == "pending_human_review")),
         ("resolution_id", "resolution_missing", F.col("resolution_id").isNull() & (F.col("__changed") == 1) & ~waiting & (state == "healthy") & ~F.col("autonomous")),
         ("state", "disabled_but_active", ~F.col("enabled") & ~state.isin("disabled", "uninitialized", "stopped"))],
    )


def resolution_records(resolutions: DataFrame) -> DataFrame:
    """A resolution is a person's and doesn't supersede itself."""
    return check(
        resolutions, "monitor_resolution",
        [("resolved_by", "not_human", ~F.coalesce(is_human(F.col("resolved_by")), F.lit(False))), ("supersedes", "supersedes_itself", F.col("supersedes") == F.col("resolution_id")), ("resolved_at", "missing_time", F.col("resolved_at").isNull())],
    )


def resolution_lineage(resolutions: DataFrame) -> DataFrame:
    """Corrections of resolutions: later in place and time, of the same target and run, from the current one only."""
    rows = with_parent(resolutions, "resolution_id", "supersedes", ["row_number", "target", "run_id", "resolved_at"])
    rows = rows.withColumn("__last", F.lag("resolution_id").over(Window.partitionBy("run_id").orderBy("row_number")))
    corrects, found = F.col("supersedes").isNotNull(), F.col("parent_row_number").isNotNull()
    return check(
        rows, "monitor_resolution",
        [("supersedes", "later_parent", found & (F.col("parent_row_number") >= F.col("row_number"))), ("supersedes", "other_source", found & ((F.col("parent_target") != F.col("target")) | (F.col("parent_run_id") != F.col("run_id")))),
         ("resolved_at", "not_later", found & (F.col("resolved_at") <= F.col("parent_resolved_at"))), ("supersedes", "not_current", corrects & ~F.col("supersedes").eqNullSafe(F.col("__last"))),
         ("supersedes", "must_supersede", ~corrects & F.col("__last").isNotNull())],
    )


def effective_resolutions(resolutions: DataFrame) -> DataFrame:
    """The last resolution of each run, if no other supersedes it: what clears a pending change."""
    last = resolutions.groupBy("run_id").agg(F.max_by(F.struct("resolution_id", "target", "resolved_at"), "row_number").alias("r")).select("run_id", "r.*")
    used = resolutions.select(F.col("supersedes").alias("resolution_id")).filter("resolution_id is not null")
    return last.join(used, "resolution_id", "left_anti").select("run_id", "resolution_id", "target", "resolved_at")


def resolution_windows(resolutions: DataFrame, runs: DataFrame, started_at: Column) -> DataFrame:
    """Resolutions from before their run ended or after the next run began, and those of no run."""
    rows = resolutions.join(runs.select("run_id", F.col("finished_at").alias("__end")), "run_id", "left")
    inside = (F.col("resolved_at") >= F.col("__end")) & (F.col("resolved_at") <= started_at)
    return check(rows, "monitor_resolution", [("resolved_at", "outside_window", ~F.coalesce(inside, F.lit(False)))])


def handoffs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Latest run of each autonomous target, if it is a change, with all columns of the target."""
    latest = runs.groupBy("target").agg(F.max_by(F.struct("run_id", "result", "fingerprint_after"), "row_number").alias("r")).select("target", "r.*")
    return latest.filter("result = 'change_detected'").join(targets.filter("autonomous"), "target")


def notification_plan(runs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """What to tell about each target's latest run, with a key that stays the same while the matter does.

    Changes are keyed by the first unresolved one, errors by their episode; runs without change are silent.
    """
    from ..functions.hashing import short_id

    latest = runs.groupBy("target").agg(F.max_by(F.struct("run_id", "result"), "row_number").alias("r")).select("target", "r.*")
    matter = latest.join(unresolved_changes(runs, resolutions).select("target", "first_run_id"), "target", "left").join(error_episodes(runs).select("target", "episode_id"), "target", "left")
    about = F.when(F.col("result") == "change_detected", F.col("first_run_id")).when(F.col("result") == "error", F.col("episode_id"))
    return matter.filter(F.col("result").isin("change_detected", "error")).select("target", "run_id", "result", short_id("N-", [F.col("target").cast("string"), F.col("result"), about.cast("string")], 24).alias("dedup_key"))


def outbox(plan: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Whether a notification opens an issue, is appended to one, or finds several."""
    n = open_issues.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(n, "dedup_key", "left").withColumn("action", F.when(F.col("n").isNull(), "create").when(F.col("n") == 1, "append").otherwise("ambiguous")).drop("n")


def failure_plan(failures: DataFrame, zone: str = "Asia/Tokyo") -> DataFrame:
    """One key per target, local day and reason."""
    from ..functions.hashing import short_id

    day = F.to_date(F.from_utc_timestamp(F.col("occurred_at").cast("timestamp"), zone))
    keyed = failures.withColumn("day", day.cast("string")).withColumn("dedup_key", short_id("F-", [F.col("target").cast("string"), day.cast("string"), F.col("reason")], 24))
    return keyed.groupBy("target", "day", "reason", "dedup_key").agg(F.count(F.lit(1)).alias("failures"))
