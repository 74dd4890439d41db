"""Time expressions.  "Now" is always an argument, never the wall clock.

Instants are zone-less (``timestamp_ntz``).  Functions that would pass through
the session time zone (``date_format``, ``unix_seconds``, ``timestamp_diff``)
are avoided, because a clock change there would move or stretch times.  Calendar predicates are written as half-open ranges, which
Parquet can use to skip data; ``year(c) = y AND month(c) = m`` cannot.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

VISIT_MINUTES = 30  # fixed value: length of one visit
MICROS = 1_000_000


def instant(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: date | datetime) -> Column:
    return F.lit(_as_date(value).isoformat()).cast("date")


def _as_date(value: date | datetime) -> date:
    return value.date() if isinstance(value, datetime) else value


def _midnight(value: date) -> datetime:
    return datetime(value.year, value.month, value.day)


def between_days(stamp: Column, first: date | datetime, last: date | datetime) -> Column:
    """Both days inclusive."""
    after = _as_date(last) + timedelta(days=1)
    return (stamp >= instant(_midnight(_as_date(first)))) & (stamp < instant(_midnight(after)))


def on_day(stamp: Column, value: date | datetime) -> Column:
    return between_days(stamp, value, value)


def month_first(year: int, month: int) -> date:
    return date(year, month, 1)


def month_last(year: int, month: int) -> date:
    following = date(year + month // 12, month % 12 + 1, 1)
    return following - timedelta(days=1)


def months_before(value: datetime, months: int) -> Column:
    """Same clock time ``months`` earlier; clamps to the month's last day."""
    return instant(value) - F.expr(f"INTERVAL '{int(months)}' MONTH")


def minutes_from(stamp: Column, minutes: int) -> Column:
    return stamp + F.expr(f"INTERVAL '{int(minutes)}' MINUTE")


def hours(stamp: Column) -> Column:
    """Whole hours since 1970."""
    return F.unix_date(F.to_date(stamp)).cast("bigint") * 24 + F.hour(stamp)


def microseconds(stamp: Column) -> Column:
    """Microseconds since 1970."""
    fraction = (F.date_part(F.lit("SECOND"), stamp) * MICROS).cast("bigint")
    return (hours(stamp) * 3600 + F.minute(stamp) * 60) * MICROS + fraction


def time_text(stamp: Column) -> Column:
    return F.substring(stamp.cast("string"), 12, 8)


def clock_text(stamp: Column) -> Column:
    return F.substring(stamp.cast("string"), 12, 5)


def day_clock_text(stamp: Column) -> Column:
    text = stamp.cast("string")
    return F.concat(
        F.substring(text, 9, 2), F.lit("/"), F.substring(text, 6, 2), F.lit("/"),
        F.substring(text, 1, 4), F.substring(text, 11, 6),
    )


def visit_end_text(stamp: Column) -> Column:
    """Time of day when the visit ends; 23:45 ends at 24:15:00, it does not wrap."""
    minutes = F.hour(stamp) * 60 + F.minute(stamp) + VISIT_MINUTES
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(minutes / 60).cast("int"),
        (minutes % 60).cast("int"),
        F.second(stamp),
    )


def month_label(year: Column, month: Column) -> Column:
    return F.concat(month.cast("string"), F.lit("/"), year.cast("string"))
