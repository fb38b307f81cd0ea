"""Date parsing and calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: ISO date, or date and time, with an optional zone.
ISO_PATTERN = (
    r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s*(Z|[+-]\d{2}:?\d{2})?\s*$"
)

# The calendar features that can be asked for.
DATE_FEATURES = [
    "year",
    "month",
    "day",
    "day_of_week",
    "day_of_year",
    "week_of_year",
    "quarter",
    "hour",
    "is_month_start",
    "is_month_end",
    "is_weekend",
]


def to_timestamp(c: Column, kind: T.DataType, formats: Sequence[str] | None = None) -> Column:
    """Parse to timestamp, failures to NULL. ``formats`` are tried in the given order."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(kind, T.DateType):
        return c.cast("timestamp")
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("timestamp")
    if isinstance(kind, T.NumericType):  # nanoseconds since the epoch
        return F.timestamp_micros(F.floor(c / 1000).cast("long"))
    text = c.cast("string")
    if formats:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.when(text.rlike(ISO_PATTERN), F.trim(text).try_cast("timestamp"))


def date_feature(c: Column, feature: str) -> Column:
    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("int"), F.lit(0))

    parts = {
        "year": F.year,
        "month": F.month,
        "day": F.day,
        "day_of_week": F.weekday,
        "day_of_year": F.dayofyear,
        "week_of_year": F.weekofyear,
        "quarter": F.quarter,
        "hour": F.hour,
        "is_month_start": lambda x: flag(F.day(x) == 1),
        "is_month_end": lambda x: flag(F.last_day(x) == F.to_date(x)),
        "is_weekend": lambda x: flag(F.weekday(x) >= 5),
    }
    if feature not in parts:
        raise ValueError(f"Unsupported date feature: {feature!r}. Available: {DATE_FEATURES}")
    return parts[feature](c)
