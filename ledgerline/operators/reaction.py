"""Market reaction: as-of milestones around announcements, returns, directions and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .issues import check

# Milestones after an announcement and the tolerance of a direction, in percent.
STAGES = ("immediate", "next_close", "fifth_close")
TOLERANCE = 0.5


def sessions(prices: DataFrame) -> DataFrame:
    """Weekdays with a price, per ticker: open, close, and the session's number."""
    day = F.to_date("ts")
    rows = prices.withColumn("day", day).filter(F.weekday(day) < 5).groupBy("ticker", "day").agg(F.min_by("price", F.struct("ts", "price_id")).alias("open"), F.max_by("price", F.struct("ts", "price_id")).alias("close"))
    return rows.withColumn("session_no", F.row_number().over(Window.partitionBy("ticker").orderBy("day")))


def around(announcements: DataFrame, prices: DataFrame, span: str = "month") -> DataFrame:
    """Each announcement with the last price before and the first after it, all its columns kept: an as-of join in linear time.

    Both series are one, sorted by time within a ticker's ``span`` of time, so that a ticker of very many prices is dealt over several
    tasks; the last and first prices of the spans, a row each, are carried over their edges. A price at the very
    instant is neither before nor after.
    """
    mine = F.struct(*announcements.columns)
    a = announcements.select("ticker", F.col("announced_at").alias("ts"), mine.alias("row"), F.lit(None).cast("double").alias("price"))
    p = prices.select("ticker", "ts", F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col("price").cast("double"))
    both = a.union(p).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("part", F.date_trunc(span, "ts"))
    up, down = (Window.partitionBy("ticker", "part").orderBy(o) for o in (F.col("us"), F.desc("us")))
    rows = both.withColumns({
        "before": F.last("price", ignorenulls=True).over(up.rangeBetween(Window.unboundedPreceding, -1)),
        "after": F.last("price", ignorenulls=True).over(down.rangeBetween(Window.unboundedPreceding, -1)),
    })
    parts = both.groupBy("ticker", "part").agg(F.max_by("price", F.when(F.col("price").isNotNull(), F.col("us"))).alias("last"), F.min_by("price", F.when(F.col("price").isNotNull(), F.col("us"))).alias("first"))
    on, back = (Window.partitionBy("ticker").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("part"), F.desc("part")))
    edges = parts.select("ticker", "part", F.last("last", ignorenulls=True).over(on).alias("edge_before"), F.last("first", ignorenulls=True).over(back).alias("edge_after"))
    found = rows.filter("row is not null").join(edges, ["ticker", "part"])
    return found.select("row.*", F.coalesce("before", "edge_before").alias("before"), F.coalesce("after", "edge_after").alias("after"))


def milestones(announcements: DataFrame, prices: DataFrame) -> DataFrame:
    """Per announcement (ticker, announcement_id, announced_at, session, corporate_action): ``pre_close``, ``reference``, ``immediate``, and the
    closes of the next session and of the fifth after it.

    Inside a session the reference is the last price before the announcement, else the close before it. After the close the
    immediate price is the next session's opening one. The n-th later session is found by number: the count of sessions up to the announcement's day, plus n.
    """
    s = sessions(prices)
    days = announcements.select("ticker", F.to_date("announced_at").alias("day"), F.lit(0).alias("is_session")).distinct()
    marks = days.unionByName(s.select("ticker", "day", F.lit(1).alias("is_session"))).groupBy("ticker", "day").agg(F.max("is_session").alias("is_session"))
    upto = marks.withColumn("passed", F.sum("is_session").over(Window.partitionBy("ticker").orderBy("day"))).select("ticker", "day", "passed", "is_session")
    rows = around(announcements, prices).withColumn("day", F.to_date("announced_at")).join(upto, ["ticker", "day"])
    late = F.col("session") == "after_close"
    rows = rows.withColumn("pre_no", F.when(late, F.col("passed")).otherwise(F.col("passed") - F.col("is_session")))
    rows = rows.join(s.select("ticker", F.col("session_no").alias("pre_no"), F.col("close").alias("pre_close")), ["ticker", "pre_no"], "left")
    for name, n, also in (("next_close", 1, ["open"]), ("fifth_close", 5, [])):
        later = s.select("ticker", (F.col("session_no") - n).alias("passed"), F.col("close").alias(name), *[F.col(c).alias(f"next_{c}") for c in also])
        rows = rows.join(later, ["ticker", "passed"], "left")
    rows = rows.withColumn("reference", F.when(F.col("session") == "intraday", F.col("before")).otherwise(F.col("pre_close")))
    rows = rows.withColumn("immediate", F.when(late, F.col("next_open")).otherwise(F.col("after")))
    return rows.select(*announcements.columns, "pre_close", "reference", *STAGES)


def return_pct(value: Column, base: Column) -> Column:
    return F.when(base != 0, F.round((value / base - 1) * 100, 4))


def direction(pct: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(pct.isNull(), "pending").when(pct > tolerance, "positive").when(pct < -tolerance, "negative").otherwise("muted")


def reactions(rows: DataFrame) -> DataFrame:
    """Milestones with returns, directions, the reaction's path, and the tracking's ``status`` and ``next_stage``.

    The first move is measured from the reference, the later closes from the close before. With a corporate action that isn't
    settled nothing is comparable; what has no price yet is pending.
    """
    comparable = ~F.coalesce(F.col("corporate_action"), F.lit(False))
    for s in STAGES:
        rows = rows.withColumn(f"{s}_pct", F.when(comparable, return_pct(F.col(s), F.col("reference" if s == "immediate" else "pre_close"))))
        rows = rows.withColumn(f"{s}_dir", F.when(~comparable, "not_comparable").otherwise(direction(F.col(f"{s}_pct"))))
    rows = rows.withColumn("path", path(*[F.col(f"{s}_dir") for s in STAGES], F.col("immediate_pct"), F.col("fifth_close_pct")))
    whole = F.col("pre_close").isNotNull()
    for s in STAGES:
        whole = whole & F.col(f"{s}_pct").isNotNull()
    # The states of a tracking and what comes next.
    status = F.when(~comparable, "not_comparable").when(whole, "complete").otherwise("tracking")
    stage = F.when(~comparable, "manual_review_required").when(whole, "ready_for_post_event_validation").otherwise("awaiting_price_milestones")
    return rows.withColumn("status", status).withColumn("next_stage", stage)


# The roles of milestones.
ROLES = {"pre_event_close": "pre_close", "immediate_post_announcement": "immediate", "next_business_day_close": "next_close", "fifth_business_day_close": "fifth_close"}


def milestone_rows(rows: DataFrame) -> DataFrame:
    """A row per announcement and role: price, ``status`` and the return from the close before."""
    comparable = ~F.coalesce(F.col("corporate_action"), F.lit(False))
    cells = []
    for role, price in ROLES.items():
        known = F.col(price).isNotNull() & (F.lit(True) if role == "pre_event_close" else F.col("pre_close").isNotNull() | ~comparable)
        status = F.when(F.col(price).isNull(), "pending").when(~comparable, "not_comparable").when(known, "observed").otherwise("pending")
        pct = F.lit(None).cast("double") if role == "pre_event_close" else F.when(comparable, return_pct(F.col(price), F.col("pre_close")))
        cells.append(F.struct(F.lit(role).alias("role"), F.col(price).alias("price"), status.alias("status"), pct.alias("return_pct")))
    return rows.select("announcement_id", F.inline(F.array(*cells)))


def dataset_context(bundles: DataFrame, events: DataFrame, statuses: DataFrame, companies: DataFrame, prices: DataFrame) -> DataFrame:
    """Bundles that don't agree with the dataset: exactly one event and company, one occurred status which is current, and its session, ticker, time and currency.

    ``bundles``: row_number, bundle_id, event_id, ticker, session, announced_at; ``prices``: bundle_id, currency.
    """
    event = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("__events"), F.min("company_id").alias("__company"), F.min("session").alias("__session"))
    company = companies.groupBy(F.col("company_id").alias("__company")).agg(F.count(F.lit(1)).alias("__companies"), F.min("ticker").alias("__ticker"), F.min("currency").alias("__currency"))
    occurred = statuses.filter("status = 'occurred'").groupBy("event_id").agg(F.count(F.lit(1)).alias("__occurred"), F.min("occurred_at").alias("__at"), F.min("status_id").alias("__status"))
    used = statuses.select(F.col("supersedes").alias("__status"), F.lit(True).alias("__superseded")).filter("__status is not null").distinct()
    paid = prices.groupBy("bundle_id").agg(F.min("currency").alias("__least"), F.max("currency").alias("__most"))
    rows = bundles.join(event, "event_id", "left").join(company, "__company", "left").join(occurred, "event_id", "left").join(used, "__status", "left").join(paid, "bundle_id", "left")
    known = F.col("__currency")
    return check(
        rows, "bundle",
        [("event_id", "not_one_event", ~F.col("__events").eqNullSafe(1)), ("company_id", "not_one_company", ~F.col("__companies").eqNullSafe(1)),
         ("event_id", "not_one_occurrence", ~F.col("__occurred").eqNullSafe(1) | F.col("__at").isNull()), ("event_id", "occurrence_superseded", F.col("__superseded")),
         ("session", "other_session", F.col("session") != F.col("__session")), ("ticker", "other_ticker", F.col("ticker") != F.col("__ticker")), ("announced_at", "other_time", F.col("announced_at") != F.col("__at")),
         ("currency", "other_currency", known.isNull() | ~F.col("__least").eqNullSafe(known) | ~F.col("__most").eqNullSafe(known))],
    )


def path(immediate: Column, middle: Column, fifth: Column, first_pct: Column, last_pct: Column) -> Column:
    stages = (immediate, middle, fifth)
    some = lambda word: (stages[0] == word) | (stages[1] == word) | (stages[2] == word)
    moved = immediate.isin("positive", "negative")
    return (
        F.when(some("not_comparable"), "not_comparable").when(some("pending"), "pending")
        .when((immediate == "muted") & (middle == "muted") & (fifth == "muted"), "muted")
        .when(moved & (fifth != immediate) & (fifth != "muted"), "reversed")
        .when(moved & (fifth == immediate) & (F.abs(last_pct) > F.abs(first_pct)), "extended")
        .when(moved & (fifth == immediate), "sustained").otherwise("mixed")
    )


def session_checks(rows: DataFrame) -> DataFrame:
    """Sessions must lie on weekdays, open before they close and ascend without repeats, per ticker."""
    by = Window.partitionBy("ticker").orderBy("row_number")
    seen = rows.withColumn("__last", F.lag("day").over(by))
    return check(seen, "session", [("day", "weekend", F.weekday("day") > 4), ("open_at", "not_before_close", F.col("open_at") >= F.col("close_at")), ("day", "not_ascending", F.col("day") <= F.col("__last"))])


def timing_checks(rows: DataFrame) -> DataFrame:
    """Observations strictly before or after the announcement as their role asks, none at the instant itself."""
    return check(rows, "observation", [("ts", "not_before", (F.col("role") == "before") & (F.col("ts") >= F.col("announced_at"))), ("ts", "not_after", (F.col("role") != "before") & (F.col("ts") <= F.col("announced_at")))])


def expected_date() -> Column:
    """The trading date that a role asks for; after the close, the immediate price is one of the next session."""
    day, role = F.to_date("announced_at"), F.col("role")
    immediate = F.when(F.col("announcement_session") == "after_close", F.col("next_date")).otherwise(day)
    return (
        F.when(role == "pre_event_close", F.col("pre_close_date")).when(role == "pre_announcement_reference", day)
        .when(role == "immediate_post_announcement", immediate).when(role == "next_business_day_close", F.col("next_date"))
        .when(role == "fifth_business_day_close", F.col("fifth_date"))
    )


def bundle_timing_checks(observations: DataFrame, bundles: DataFrame, verified: DataFrame) -> DataFrame:
    """Each observation's time, date, kind of price and session, and the reference that an intraday bundle needs.

    ``observations``: row_number, bundle_id, role, price_kind, trading_date, price_at. ``bundles``: bundle_id, ticker, announced_at,
    announcement_session, pre_close_date, next_date and fifth_date (the first and fifth next session). ``verified`` sessions:
    ticker, day, open_at, close_at, one row a key.
    """
    held = verified.select("ticker", F.col("day").alias("trading_date"), "open_at", "close_at", F.lit(True).alias("verified"))
    rows = observations.join(bundles, "bundle_id").join(held, ["ticker", "trading_date"], "left")
    role, kind, at, session = F.col("role"), F.col("price_kind"), F.col("price_at"), F.col("announcement_session")
    immediate, reference = role == "immediate_post_announcement", role == "pre_announcement_reference"
    inside = ("minute_bar_close", "vwap_after_announcement", "manual_trade_price")
    allowed = F.when(session == "intraday", kind.isin(*inside)).otherwise(kind.isin("official_open", "manual_trade_price"))
    found = check(rows, "observation", [
        ("price_at", "not_before", (reference | (role == "pre_event_close")) & (at >= F.col("announced_at"))),
        ("price_at", "not_after", immediate & (at <= F.col("announced_at"))),
        ("trading_date", "unexpected_date", F.col("trading_date") != expected_date()),
        ("role", "reference_not_intraday", reference & (session != "intraday")),
        ("price_kind", "kind_not_of_session", immediate & ~allowed),
        ("trading_date", "no_verified_session", F.col("verified").isNull()),
        ("price_at", "not_at_open", (kind == "official_open") & (at != F.col("open_at"))),
        ("price_at", "not_at_close", (kind == "official_close") & (at != F.col("close_at"))),
        ("price_at", "outside_session", kind.isin(*inside) & ((at < F.col("open_at")) | (at > F.col("close_at")))),
    ])
    without = bundles.filter(session == "intraday").join(observations.filter(reference), "bundle_id", "left_anti")
    return found.union(check(without, "bundle", [("announcement_session", "no_reference", F.lit(True))], row="bundle_id"))


def price_checks(rows: DataFrame) -> DataFrame:
    """One currency and distinct roles of each bundle, positive unadjusted prices."""
    bundles = rows.groupBy("bundle_id").agg(F.countDistinct("currency").alias("currencies"), F.count("role").alias("n"), F.countDistinct("role").alias("roles"))
    joined = rows.join(bundles, "bundle_id")
    return check(joined, "observation", [("currency", "several_currencies", F.col("currencies") > 1), ("role", "repeated_role", F.col("n") > F.col("roles")), ("price", "not_positive", F.col("price") <= 0), ("adjusted", "adjusted_price", F.col("adjusted"))])


#: Trading times are given with this offset.
OFFSET = "+09:00"


def session_cover(bundles: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows (bundle_id, day, code): what is wrong with a bundle's dates and its verified sessions, and how they cover the days that its milestones need.

    ``bundles``: bundle_id, announced_at (text with offset), pre_event_close_date, next_dates (array of dates). ``sessions``: bundle_id, pos, trading_date, open_at,
    close_at (texts with offset). The days needed are the close before, the announcement's and the five next ones; the difference both ways is one
    anti join each. ``day`` is null where a code is about the whole bundle. A bundle without sessions misses them all; sessions of no bundle are surplus.
    """
    announced = F.to_date(F.substring("announced_at", 1, 10))
    ascending = lambda days: days == F.array_sort(F.array_distinct(days))
    codes = F.array_compact(F.array(
        F.when(~F.col("announced_at").endswith(OFFSET), "announcement_zone"), F.when((F.size("next_dates") != 5) | ~ascending(F.col("next_dates")), "next_dates_order"),
        F.when(F.array_min("next_dates") <= announced, "next_date_not_after"),
    ))
    whole = bundles.select("bundle_id", F.lit(None).cast("date").alias("day"), F.explode(codes).alias("code"))
    day = F.col("trading_date")
    own = F.array_compact(F.array(
        F.when(F.weekday(day) > 4, "weekend"), F.when(~F.col("open_at").endswith(OFFSET) | ~F.col("close_at").endswith(OFFSET), "session_zone"),
        F.when((F.substring("open_at", 1, 10) != day.cast("string")) | (F.substring("close_at", 1, 10) != day.cast("string")), "other_date"),
        F.when(F.col("open_at").try_cast("timestamp") >= F.col("close_at").try_cast("timestamp"), "not_before_close"),
    ))
    each = sessions.select("bundle_id", day.alias("day"), F.explode(own).alias("code"))
    last = F.lag("trading_date").over(Window.partitionBy("bundle_id").orderBy("pos"))  # a bundle has a few sessions
    order = sessions.withColumn("last", last).filter("trading_date <= last").select("bundle_id", day.alias("day"), F.lit("not_ascending").alias("code"))
    needed = bundles.select("bundle_id", F.explode(F.array_distinct(F.concat(F.array("pre_event_close_date", announced), "next_dates"))).alias("day")).filter("day is not null")
    there = sessions.select("bundle_id", day.alias("day")).distinct()
    missing = needed.join(there, ["bundle_id", "day"], "left_anti").withColumn("code", F.lit("missing_session"))
    surplus = there.join(needed, ["bundle_id", "day"], "left_anti").withColumn("code", F.lit("surplus_session"))
    return whole.unionByName(each).unionByName(order).unionByName(missing).unionByName(surplus)
