"""Calendar buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: dt.date | str | Column | None) -> Column:
    """``value`` as a date column; None is today in the session's time zone."""
    if value is None:
        return F.current_date()
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(value).cast("date")


def as_timestamp(value: dt.datetime | Column | None, ntz: bool = False) -> Column:
    """``value`` as a timestamp column; None is now."""
    if value is None:
        col = F.current_timestamp()
    else:
        col = value if isinstance(value, Column) else F.lit(value)
    return col.cast("timestamp_ntz" if ntz else "timestamp")


def start_of(grain: str, col: Column | str) -> Column:
    """First day of the day, ISO week (Monday) or month that holds ``col``."""
    return F.date_trunc(grain, col).cast("date")


def in_same(grain: str, col: Column | str, day: Column) -> Column:
    """Whether ``col`` lies in the day, ISO week or month of ``day``.

    Two dates share an ISO year-week exactly when they share the Monday, and a (month, year) pair
    exactly when they share the first of the month, so a range on the bare column is enough.
    """
    col = F.col(col) if isinstance(col, str) else col
    first = start_of(grain, day)
    after = {
        "day": F.date_add(first, 1),
        "week": F.date_add(first, 7),
        "month": F.add_months(first, 1),
    }[grain]
    return (col >= first) & (col < after)
