"""Date column expressions: tolerant parsing, truncation, labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Fixed value: accepted written date formats, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy")


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def to_timestamp_or_null(col: Column, dtype: T.DataType) -> Column:
    """Timestamp of a temporal or string column; NULL where it cannot be read."""
    if is_temporal(dtype):
        return col.cast("timestamp")
    if isinstance(dtype, T.StringType):
        text = F.trim(col)
        tries = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATE_FORMATS]
        return F.coalesce(text.try_cast("timestamp"), *tries)
    return F.lit(None).cast("timestamp")


def period_start(col: Column, granularity: str) -> Column:
    """First day of the day / week / month a date falls in."""
    unit = granularity if granularity in ("day", "week") else "month"
    return F.trunc(col, unit).cast("date") if unit != "day" else col.cast("date")


def week_number(col: Column) -> Column:
    """Week of the year counted from the first Monday (``%W``)."""
    return F.floor((F.dayofyear(col) - 1 + 7 - F.weekday(col)) / 7).cast("int")


def period_label(col: Column, granularity: str) -> Column:
    """Axis label of a period: ``2000-01-31``, ``W05 2000`` or ``Jan 2000``."""
    if granularity == "day":
        return F.date_format(col, "yyyy-MM-dd")
    if granularity == "week":
        return F.concat(
            F.lit("W"), F.lpad(week_number(col).cast("string"), 2, "0"), F.lit(" "), F.date_format(col, "yyyy")
        )
    return F.date_format(col, "MMM yyyy")


def as_date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def previous_window(start: dt.date | str, end: dt.date | str) -> tuple[dt.date, dt.date]:
    """Window of the same length that ends the day before ``start``."""
    start, end = as_date(start), as_date(end)
    prev_end = start - dt.timedelta(days=1)
    return prev_end - (end - start), prev_end
