"""Business time: weekdays between dates, elapsed time without weekends, staleness windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hours of business time after which a source is stale, by window.
STALE_HOURS = {"event_day": 12, "event_window": 24, "normal": 60}
EVENT_WINDOW_DAYS = 5
#: Where announcements are scheduled.
ZONE = "Asia/Tokyo"


def business_days_until(start: Column, end: Column) -> Column:
    """Mondays to Fridays after ``start`` up to ``end``; 0 if ``end`` isn't later. Closed form, no day by day list."""
    upto = lambda d: F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.pmod(F.datediff(d, F.lit("1970-01-05").cast("date")), F.lit(7)) + 1, F.lit(5))
    return F.when(end > start, upto(end) - upto(start)).otherwise(0).cast("long")


def business_seconds(start: Column, end: Column) -> Column:
    """Seconds between two instants that don't fall on a Saturday or Sunday; 0 if ``end`` isn't later.

    Closed form: full weekdays up to each instant's midnight plus the weekday seconds of its own day.
    """

    def upto(t: Column) -> Column:
        days = F.datediff(t.cast("date"), F.lit("1970-01-05").cast("date"))
        within = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
        weekday = F.pmod(days, F.lit(7))
        return (F.floor(days / 7) * 5 + F.least(weekday, F.lit(5))) * 86400 + F.when(weekday < 5, within).otherwise(0)

    return F.when(end > start, upto(end) - upto(start)).otherwise(0).cast("long")


def stale_window(today: Column, event_date: Column, required: Column) -> Column:
    """Which threshold holds: on the event's day, in the business days before it, else the normal one. Unknown but required: the strictest."""
    return (
        F.when(event_date.isNull() & required, "event_day")
        .when(event_date == today, "event_day")
        .when((today < event_date) & (business_days_until(today, event_date) <= EVENT_WINDOW_DAYS), "event_window")
        .otherwise("normal")
    )


def is_stale(last_success: Column, now: Column, window: Column) -> Column:
    hours = F.when(window == "event_day", STALE_HOURS["event_day"]).when(window == "event_window", STALE_HOURS["event_window"]).otherwise(STALE_HOURS["normal"])
    return last_success.isNull() | (business_seconds(last_success, now) > hours * 3600)


def local_time(at: Column, zone: str = ZONE) -> Column:
    """An instant as the clock of ``zone`` shows it, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp").cast("timestamp_ntz"))


def is_due(now: Column, event_date: Column, zone: str = ZONE) -> Column:
    """On local weekdays: the event's day, up to five business days before, or the evening hours from 17 to 21."""
    local = local_time(now, zone)
    today = local.cast("date")
    near = (event_date == today) | ((today < event_date) & (business_days_until(today, event_date) <= EVENT_WINDOW_DAYS))
    return (F.weekday(today) < 5) & (F.coalesce(near, F.lit(False)) | F.hour(local).between(17, 20))


def next_date(schedule: Column, on_or_after: Column) -> Column:
    """The first full date of a schedule that isn't earlier. Its entries, parted by ``;`` or ``|``, are ``date=label``; months alone are passed over."""
    dates = F.transform(F.split(schedule, "[;|]"), lambda e: F.trim(F.split_part(e, F.lit("="), F.lit(1))))
    found = F.transform(F.filter(dates, lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$")), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.array_min(F.filter(found, lambda d: d.isNotNull() & (d >= on_or_after)))


def stale_from(last_success: Column, event_date: Column, required: Column) -> Column:
    """Milliseconds of the epoch after which a source is stale if no success follows: the first instant at which ``is_stale`` holds, less one.

    A week of days is looked at, each with the threshold of its own window: a threshold may be passed within a weekday, or at a midnight that brings a stricter one.
    """
    at = F.date_trunc("second", last_success.cast("timestamp"))

    def passed(k: Column) -> Column:
        day = F.date_add(at.cast("date"), k)
        begin = F.when(k == 0, at).otherwise(day.cast("timestamp"))
        window = stale_window(day, event_date, required)
        limit = F.when(window == "event_day", STALE_HOURS["event_day"]).when(window == "event_window", STALE_HOURS["event_window"]).otherwise(STALE_HOURS["normal"]) * 3600
        elapsed, left = business_seconds(at, begin), F.unix_timestamp(F.date_add(day, 1).cast("timestamp")) - F.unix_timestamp(begin)
        within = (F.weekday(day) < 5) & (elapsed + left > limit) & (elapsed <= limit)
        return F.when((k > 0) & (elapsed > limit), F.unix_millis(begin) - 1).when(within, F.unix_millis(begin) + (limit - elapsed) * 1000)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(7)), passed))
