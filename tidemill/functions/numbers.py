"""Parsing text to numbers, and the exact rounding used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts accepted as a number (outer blanks allowed). The engine's own
# cast also takes suffixed forms such as "1d", which do not count as numbers here.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
OUTER_BLANKS = r"^\s+|\s+$"
# Fixed value: the currency signs removed by default.
CURRENCY_SYMBOLS = "$€£¥"


def strip(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(c, OUTER_BLANKS, "")


def parse_number(c: Column) -> Column:
    """Text as double; anything that is not a number becomes NULL."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return nan_to_null(c)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")) * F.lit(1000)
    return parse_number(c.cast("string"))


def clean_currency(c: Column, symbols: str = CURRENCY_SYMBOLS) -> Column:
    return parse_number(F.translate(strip(c.cast("string")), symbols + ",", ""))


def clean_percent(c: Column) -> Column:
    return parse_number(F.translate(strip(c.cast("string")), "%", "")) / F.lit(100.0)


def percent(part: Column, whole: Column) -> Column:
    """Share of ``whole`` in per cent with 2 digits, halves to even; 0 for an empty table."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.bround(share * 100, 2), F.lit(0.0))
