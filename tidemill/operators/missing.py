"""Filling missing values. Fitting runs aggregates; applying is one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import as_list, col, is_number, require_columns, type_of
from tidemill.functions.order_stats import exact_quantiles
from tidemill.operators.profile import most_frequent

STRATEGIES = ("mean", "median", "most_frequent", "constant")
DEFAULT_TEXT = "missing"


def fit_fill(
    df: DataFrame,
    columns: str | Sequence[str],
    strategy: str = "median",
    fill_value: Any = DEFAULT_TEXT,
    approx: bool = False,
    keep_all: bool = False,
) -> dict[str, Any]:
    """The value each column is filled with; columns without one are left out.

    ``keep_all`` keeps a fractional value for a whole-number column that has nothing missing
    now: other tables may need it, and the column then turns into doubles.
    """
    columns = as_list(columns)
    require_columns(df, columns)
    if strategy not in STRATEGIES:
        raise ValueError(f"no fill strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if strategy in ("mean", "median"):
        wrong = [c for c in columns if not is_number(type_of(df, c))]
        if wrong:
            raise TypeError(f"{strategy!r} can only be used with numeric columns: {wrong}")
    if strategy == "constant":
        for c in columns:
            _check_constant(c, type_of(df, c), fill_value)
        return {c: fill_value for c in columns}
    if strategy == "mean":
        row = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        values = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    elif strategy == "median":
        numbers = df.select(*[col(c).cast("double").alias(c) for c in columns])
        values = {c: v[0] for c, v in exact_quantiles(numbers, {c: [0.5] for c in columns}, approx).items()}
    else:
        values = most_frequent(df, columns)
    found = {c: _literal(v) for c, v in values.items() if v is not None}
    return found if keep_all else _where_needed(df, found)


def _where_needed(df: DataFrame, values: dict[str, Any]) -> dict[str, Any]:
    """A whole-number column without a missing value keeps its type: a fractional fill
    value is dropped for it."""
    doubtful = [
        c
        for c, v in values.items()
        if isinstance(type_of(df, c), T.IntegralType) and isinstance(v, float) and not v.is_integer()
    ]
    if not doubtful:
        return values
    row = df.agg(*[F.max(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(doubtful)]).first()
    full = {c for i, c in enumerate(doubtful) if not row[f"c{i}"]}
    return {c: v for c, v in values.items() if c not in full}


def _literal(value: Any) -> Any:
    """A fill value that survives JSON; dates and timestamps travel as text."""
    return value if isinstance(value, (bool, int, float, str)) else str(value)


def fit_auto_fill(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    keep_all: bool = False,
) -> dict[str, Any]:
    """Median for numbers; most frequent value, or a fixed text, for everything else.
    ``keep_all`` also learns values for columns that have nothing missing yet."""
    columns = df.columns if columns is None else list(columns)
    numbers = [c for c in columns if is_number(type_of(df, c))]
    others = [c for c in columns if c not in set(numbers)]
    numeric = df.select(*[col(c).cast("double").alias(c) if keep_all else col(c) for c in numbers])
    values = fit_fill(numeric, numbers, "median", approx=approx) if numbers else {}
    for c, v in (most_frequent(df, others) if others else {}).items():
        if v is not None:
            values[c] = _literal(v)
        elif isinstance(type_of(df, c), T.StringType):
            values[c] = DEFAULT_TEXT
    return values


def apply_fill(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if field.name in values:
            c = _filled(c, field.dataType, values[field.name]).alias(field.name)
        out.append(c)
    return df.select(*out)


def fill_missing(
    df: DataFrame,
    columns: str | Sequence[str],
    strategy: str = "median",
    fill_value: Any = DEFAULT_TEXT,
    approx: bool = False,
) -> DataFrame:
    return apply_fill(df, fit_fill(df, columns, strategy, fill_value, approx))


def auto_fill(df: DataFrame, approx: bool = False) -> DataFrame:
    return apply_fill(df, fit_auto_fill(df, approx=approx))


def _filled(c, kind: T.DataType, value: Any):
    if isinstance(kind, T.IntegralType) and isinstance(value, float):
        if not value.is_integer():
            return F.coalesce(c.cast("double"), F.lit(value))
        value = int(value)
    if isinstance(kind, T.DecimalType) and isinstance(value, float):
        return F.coalesce(c.cast("double"), F.lit(value))
    return F.coalesce(c, F.lit(value).cast(kind))


def _check_constant(name: str, kind: T.DataType, value: Any) -> None:
    if isinstance(kind, T.StringType):
        fits = isinstance(value, str)
    elif isinstance(kind, T.BooleanType):
        fits = isinstance(value, bool)
    elif isinstance(kind, T.NumericType):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool)
    else:
        fits = True
    if not fits:
        raise TypeError(f"{value!r} cannot fill column {name!r} of type {kind.simpleString()}")
