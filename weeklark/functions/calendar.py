"""Week arithmetic: ISO weeks, week-ending Sundays and forecast calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_ending(ts: Column) -> Column:
    """The Sunday that ends the ISO week of a date or timestamp."""
    return F.date_add(F.date_trunc("week", ts).cast("date"), 6)


def to_sunday(date: Column) -> Column:
    """The date itself if it is a Sunday, else the next one."""
    return F.next_day(F.date_sub(date, 1), "SUN")


def horizon_dates(last: Column, horizon: int) -> Column:
    """Sundays of the forecast: the first is a week after ``last``, moved forward to a Sunday."""
    first = to_sunday(F.date_add(last, 7))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda s: F.date_add(first, s * 7))


def iso_week(date: Column) -> Column:
    return F.weekofyear(date)
