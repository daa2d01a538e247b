"""Calendar columns, and ranges of whole weeks and months around a given day (never the clock)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(day: Column) -> Column:
    return F.trunc(day, "month")


def week_start(day: Column, first: int = 0) -> Column:
    """Start of the week of a day; first: 0 for Monday to 6 for Sunday."""
    return F.date_sub(day, F.pmod(F.weekday(day) - first, F.lit(7)))


def last_whole_week(as_of: date) -> tuple[date, date]:
    """Monday and Sunday of the last week that was over before as_of."""
    monday = as_of - timedelta(days=as_of.weekday() + 7)
    return monday, monday + timedelta(days=6)


def add_months(day: date, n: int) -> date:
    """First day of the month n months after a day's month."""
    at = day.year * 12 + day.month - 1 + n
    return date(at // 12, at % 12 + 1, 1)


def year_to_last_month(as_of: date) -> tuple[tuple[date, date], tuple[date, date]]:
    """January 1 to the end of the last complete month, and the same span a year earlier (bounds included)."""
    end = as_of.replace(day=1) - timedelta(days=1)
    first = date(end.year, 1, 1)
    prior_end = add_months(date(end.year - 1, end.month, 1), 1) - timedelta(days=1)
    return (first, end), (date(end.year - 1, 1, 1), prior_end)
