"""Validity, local time, schedules and calendar arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROME = "Europe/Rome"


def status(precision: Column, start: Column, end: Column, at: Column) -> Column:
    """current, future or expired for intervals; an instant is future or undetermined; all else is undetermined."""
    interval = F.when(at < start, "future").when(end.isNotNull() & (at >= end), "expired").otherwise("current")
    instant = F.when(at < start, "future").otherwise("undetermined")
    return F.when((precision == "interval") & start.isNotNull(), interval).when((precision == "instant") & start.isNotNull(), instant).otherwise("undetermined")


def date_status(day: Column, at: Column, zone: str = ROME) -> Column:
    """Status of a whole local day."""
    today = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at))
    return F.when(today < day, "future").when(today > day, "expired").otherwise("current")


def intersects(precision: Column, start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether a validity may touch [low, high); unknown and conditional ones always may.

    A date counts as the whole day, an instant as a point, and an open end excludes nothing.
    Null bounds of the range are open.
    """
    stop = F.when(precision == "date", start + F.expr("INTERVAL 1 DAY")).when(precision == "interval", end)
    before = high.isNull() | (start < high)
    point = low.isNull() | (start >= low)
    behind = low.isNull() | stop.isNull() | (stop > low)
    known = F.when(precision == "instant", before & point).otherwise(before & behind)
    return F.when(precision.isin("unknown", "conditional") | start.isNull(), F.lit(True)).otherwise(known)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that it names more than once, and that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def local_to_utc(local: Column, zone: str = ROME) -> Column:
    """UTC of a local wall time (timestamp without zone), or null where it does not exist or is ambiguous."""
    to_utc = lambda t: F.convert_timezone(F.lit(zone), F.lit("UTC"), t)
    to_local = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    hour = F.expr("INTERVAL 1 HOUR")

    def checked(both: Column) -> Column:
        utc, wall = both["utc"], both["wall"]
        twice = (to_local(utc - hour) == wall) | (to_local(utc + hour) == wall)
        return F.when((to_local(utc) == wall) & ~twice, utc)

    return let(local, lambda t: let(F.struct(to_utc(t).alias("utc"), t.alias("wall")), checked))


def local_day(at: Column, zone: str = ROME) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at))


def add_months(at: Column, months: int) -> Column:
    """Same time of day some calendar months later; the day is clamped to the month's last."""
    return at + F.make_ym_interval(F.lit(0), F.lit(months))


def backoff_seconds(base: int, cap: int, failures: Column) -> Column:
    """Doubles with every failure after the first, up to a cap; none without failures."""
    steps = F.least(failures - 1, F.lit(40))
    return F.when(failures < 1, F.lit(0)).otherwise(F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), steps))).cast("long")


def due_state(anchor: Column, interval: int, tolerance: int, last: Column, at: Column) -> Column:
    """Whether the publication of the current cycle is not_due, published, awaiting or missing.

    Cycles begin at anchor + k * interval. A publication counts for its cycle from half the
    interval, or the tolerance if that is less, before the cycle's beginning; it is awaited until
    tolerance behind it, that moment included.
    """
    cycle = F.floor(F.timestamp_diff("SECOND", anchor, at) / interval)
    due = anchor + F.make_dt_interval(secs=cycle * interval)
    early = due - F.make_dt_interval(secs=F.lit(min(tolerance, interval // 2)))
    late = due + F.make_dt_interval(secs=F.lit(tolerance))
    return F.when(at < anchor, "not_due").when(last.isNotNull() & (last >= early), "published").when(at <= late, "awaiting").otherwise("missing")


def updating_state(last_complete: Column, failed: Column, suspended: Column, delay_seconds: int, at: Column) -> Column:
    """not_verified, suspended, failed, delayed or ok, the first that holds; delayed exactly from last + delay on."""
    late = F.timestamp_diff("SECOND", last_complete, at) >= delay_seconds
    return F.when(last_complete.isNull(), "not_verified").when(suspended, "suspended").when(failed, "failed").when(late, "delayed").otherwise("ok")


def age_days(since: Column, at: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.timestamp_diff("SECOND", since, at) / 86400)).cast("long")


def milliseconds(a: Column, b: Column) -> Column:
    return F.round(F.timestamp_diff("MICROSECOND", a, b) / 1000).cast("long")
