"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col


def same_day_in_year(day, year) -> Column:
    """The same month and day in another year; NULL for 29 February where it is missing."""
    d, y = as_col(day), as_col(year)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    exists = ~((F.month(d) == 2) & (F.dayofmonth(d) == 29)) | leap
    return F.when(exists, F.make_date(y.cast("int"), F.month(d), F.dayofmonth(d)))


def day_range(start, end) -> Column:
    """Array of the calendar days start..end inclusive, empty when end < start."""
    s, e = as_col(start), as_col(end)
    return F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<date>"))


def ceil_day(ts) -> Column:
    """First midnight at or after ts, as a date."""
    t = as_col(ts)
    d = F.to_date(t)
    return F.when(d.cast("timestamp_ntz") == t.cast("timestamp_ntz"), d).otherwise(F.date_add(d, 1))


def scored_season(start, end) -> Column:
    """Events that a calendar-year normal can score: not starting in January and
    not ending after 10 December."""
    s, e = as_col(start), as_col(end)
    return (F.month(s) != 1) & ~((F.month(e) == 12) & (F.dayofmonth(e) > 10))
