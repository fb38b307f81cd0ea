"""Outlier bounds, flags, removal and clipping."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import as_list, col, is_number, require_columns, type_of
from tidemill.functions.order_stats import exact_quantiles

Bounds = Mapping[str, Sequence[float]]


def outlier_bounds(
    df: DataFrame,
    columns: str | Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    approx: bool = False,
) -> dict[str, tuple[float, float]]:
    columns = as_list(columns)
    require_columns(df, columns)
    wrong = [c for c in columns if not is_number(type_of(df, c))]
    if wrong:
        raise TypeError(f"Outlier detection requires numeric columns: {wrong}")
    if method == "iqr":
        numbers = df.select(*[col(c).cast("double").alias(c) for c in columns])
        quartiles = exact_quantiles(numbers, {c: [0.25, 0.75] for c in columns}, approx)
        return {c: _fences(*quartiles[c], threshold) for c in columns}
    if method == "zscore":
        row = df.agg(
            *[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        return {c: _around(row[f"m{i}"], row[f"s{i}"], threshold) for i, c in enumerate(columns)}
    raise ValueError(f"bounds come from iqr or zscore, not {method!r}")


def _fences(low: float | None, high: float | None, threshold: float) -> tuple[float, float]:
    if low is None:
        return -math.inf, math.inf
    reach = threshold * (high - low)
    return low - reach, high + reach


def _around(mean: float | None, std: float | None, threshold: float) -> tuple[float, float]:
    if std is None or std == 0 or math.isnan(std):
        return -math.inf, math.inf
    return mean - threshold * std, mean + threshold * std


def outside(name: str, bounds: Sequence[float]) -> Column:
    """True outside the bounds; a missing value is not an outlier."""
    low, high = bounds
    return F.coalesce((col(name) < F.lit(low)) | (col(name) > F.lit(high)), F.lit(False))


def detect_outliers(
    df: DataFrame,
    columns: str | Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    key: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """One boolean column per input column, next to the ``key`` columns."""
    columns = as_list(columns)
    bounds = outlier_bounds(df, columns, method, threshold, approx)
    return df.select(*[col(k) for k in key], *[outside(c, bounds[c]).alias(c) for c in columns])


def apply_remove(df: DataFrame, bounds: Bounds) -> DataFrame:
    for name in bounds:
        df = df.where(~outside(name, bounds[name]))
    return df


def apply_clip(df: DataFrame, bounds: Bounds) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if field.name in bounds:
            low, high = bounds[field.name]
            if not (math.isinf(low) and math.isinf(high)):
                clipped = F.least(F.greatest(c.cast("double"), F.lit(low)), F.lit(high))
                if isinstance(field.dataType, T.IntegralType) and low == int(low) and high == int(high):
                    clipped = clipped.cast(field.dataType)
                # least and greatest skip NULL
                c = F.when(col(field.name).isNotNull(), clipped).alias(field.name)
        out.append(c)
    return df.select(*out)


def remove_outliers(
    df: DataFrame,
    columns: str | Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    approx: bool = False,
) -> DataFrame:
    return apply_remove(df, outlier_bounds(df, columns, method, threshold, approx))


def clip_outliers(
    df: DataFrame,
    columns: str | Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    approx: bool = False,
) -> DataFrame:
    return apply_clip(df, outlier_bounds(df, columns, method, threshold, approx))
