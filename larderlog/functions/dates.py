"""Calendar helpers; all take an explicit start date instead of the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _int(n: Column | int) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def calendar_dates(start: Column | str, n: Column | int) -> Column:
    """``n`` consecutive dates from ``start``; an empty array when n < 1."""
    n = _int(n)
    none = F.array().cast("array<date>")
    run = F.sequence(col(start), F.date_add(col(start), F.greatest(n, F.lit(1)) - 1))
    return F.when(n >= 1, run).otherwise(none)


def delivery_dates(
    start: Column | str,
    n: Column | int,
    saturday: Column | bool = False,
    sunday: Column | bool = False,
) -> Column:
    """First ``n`` dates from ``start`` on which deliveries happen.

    Weekend days count only when the flag is true. Nine spare days per started
    working week always contain enough weekdays.
    """
    n = _int(n)
    sat = F.coalesce(F.lit(saturday) if isinstance(saturday, bool) else saturday, F.lit(False))
    sun = F.coalesce(F.lit(sunday) if isinstance(sunday, bool) else sunday, F.lit(False))
    span = (F.floor(n / 5) + 1) * 7 + 2
    days = F.sequence(col(start), F.date_add(col(start), span.cast("int")))
    kept = F.filter(
        days,
        lambda d: F.when(F.weekday(d) == 5, sat).when(F.weekday(d) == 6, sun).otherwise(True),
    )
    return F.slice(kept, F.lit(1), n)


def day_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def bucket(c: Column | str, unit: str = "day") -> Column:
    """Start of the capture bucket in the session time zone."""
    return F.date_trunc(unit, col(c))


def as_date(d) -> Column:
    """Clock argument: a Column, a date/str, or None for today."""
    if d is None:
        return F.current_date()
    return d if isinstance(d, Column) else F.lit(d).cast("date")


def as_time(t) -> Column:
    if t is None:
        return F.current_timestamp()
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")
