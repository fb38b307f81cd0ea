"""Column conversions: casts, dates, currency and percent text, simple maths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import dates
from tidemill.functions import numbers as N
from tidemill.functions.columns import (
    as_list,
    col,
    is_numeric,
    is_timestamp,
    require_columns,
    type_of,
)
from tidemill.operators.profile import distinct_values

# The target types and the transforms that can be asked for.
TARGET_TYPES = ["numeric", "string", "category", "datetime", "datetime64[ns]", "int", "float", "bool"]
TRANSFORMS = ["log1p", "sqrt", "square", "absolute"]


def replace(df: DataFrame, changed: dict) -> DataFrame:
    """One projection with some columns replaced, order kept."""
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


def check_convert(df: DataFrame, column: str, dtype: str) -> None:
    """Raise when a value cannot be converted; only int and float look at the data."""
    require_columns(df, [column])
    if dtype not in TARGET_TYPES:
        raise ValueError(f"Unsupported dtype. Use one of {TARGET_TYPES}.")
    kind, c = type_of(df, column), col(column)
    bad = None
    if dtype == "int":
        bad = c.isNull()
        if isinstance(kind, T.StringType):
            bad = bad | ~c.rlike(N.WHOLE_PATTERN) | N.strip(c).try_cast("bigint").isNull()
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    elif dtype == "float" and isinstance(kind, T.StringType):
        bad = c.isNotNull() & N.parse_number(c).isNull()
    if bad is not None and df.agg(F.max(bad).alias("bad")).first()["bad"]:
        raise ValueError(f"Column {column!r} holds values that cannot be converted to {dtype}.")


def apply_convert(
    df: DataFrame,
    column: str,
    dtype: str,
    formats: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    kind, c = type_of(df, column), col(column)
    if dtype == "numeric":
        out = N.to_number(c, kind)
    elif dtype == "string":
        out = c.cast("string")
    elif dtype == "category":
        values = list(categories or [])
        meta = {"ml_attr": {"type": "nominal", "name": column, "vals": values}}
        return df.select(
            *[
                c.cast("string").alias(column, metadata=meta) if n == column else col(n)
                for n in df.columns
            ]
        )
    elif dtype in ("datetime", "datetime64[ns]"):
        out = dates.to_timestamp(c, kind, formats)
    elif dtype == "int":
        out = N.strip(c).cast("bigint") if isinstance(kind, T.StringType) else c.cast("bigint")
    elif dtype == "float":
        out = N.parse_number(c) if isinstance(kind, T.StringType) else c.cast("double")
    elif isinstance(kind, T.StringType):
        out = F.coalesce(c != "", F.lit(True))
    elif isinstance(kind, T.NumericType):
        out = F.coalesce(c != 0, F.lit(True))
    elif isinstance(kind, T.BooleanType):
        out = F.coalesce(c, F.lit(True))
    else:
        out = F.lit(True)
    return replace(df, {column: out})


def convert_dtype(
    df: DataFrame, column: str, dtype: str, formats: Sequence[str] | None = None
) -> DataFrame:
    check_convert(df, column, dtype)
    categories = None
    if dtype == "category":
        texts = df.select(col(column).cast("string").alias(column))
        categories = distinct_values(texts, [column])[column]
    return apply_convert(df, column, dtype, formats, categories)


def parse_dates(
    df: DataFrame, columns: str | Sequence[str], formats: Sequence[str] | None = None
) -> DataFrame:
    columns = as_list(columns)
    require_columns(df, columns)
    return replace(df, {c: dates.to_timestamp(col(c), type_of(df, c), formats) for c in columns})


def clean_numeric(
    df: DataFrame,
    column: str,
    percent: bool = False,
    currency_symbols: str = N.CURRENCY_SYMBOLS,
) -> DataFrame:
    require_columns(df, [column])
    c = col(column)
    out = N.clean_percent(c) if percent else N.clean_currency(c, currency_symbols)
    return replace(df, {column: out})


def create_date_features(
    df: DataFrame, column: str, features: Sequence[str], formats: Sequence[str] | None = None
) -> DataFrame:
    """Adds ``{column}_{feature}``; text is parsed first."""
    require_columns(df, [column])
    kind = type_of(df, column)
    if not is_timestamp(kind):
        df = replace(df, {column: dates.to_timestamp(col(column), kind, formats)})
    return df.withColumns({f"{column}_{f}": dates.date_feature(col(column), f) for f in features})


def check_transform(df: DataFrame, columns: str | Sequence[str], transformation: str) -> None:
    columns = as_list(columns)
    require_columns(df, columns)
    if transformation not in TRANSFORMS:
        raise ValueError(f"Unsupported transformation. Use one of {TRANSFORMS}.")
    wrong = [c for c in columns if not is_numeric(type_of(df, c))]
    if wrong:
        raise TypeError(f"Numeric transformation requires numeric columns: {wrong}")
    limits = {"log1p": -1.0, "sqrt": 0.0}
    if transformation in limits and columns:
        lows = df.agg(*[F.min(col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        low = limits[transformation]
        for i, c in enumerate(columns):
            if lows[f"c{i}"] is not None and lows[f"c{i}"] < low:
                raise ValueError(f"{transformation} cannot be applied to values below {low:g} in {c}.")


def apply_transform(df: DataFrame, columns: str | Sequence[str], transformation: str) -> DataFrame:
    def changed(name: str):
        kind, c = type_of(df, name), col(name)
        if transformation == "log1p":
            x = c.cast("double")
            return F.when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(x))
        if transformation == "sqrt":
            return F.sqrt(c.cast("double"))
        if transformation == "square":
            if isinstance(kind, T.IntegralType):
                # whole numbers stay whole; one that no longer fits is a clear error
                return c.cast("bigint") * c.cast("bigint")
            return c * c
        return c if isinstance(kind, T.BooleanType) else F.abs(c)

    return replace(df, {c: changed(c) for c in as_list(columns)})


def transform_numeric(df: DataFrame, columns: str | Sequence[str], transformation: str) -> DataFrame:
    check_transform(df, columns, transformation)
    return apply_transform(df, columns, transformation)
