"""Column name and type checks shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def col(name: str) -> Column:
    """A column by its literal name; dots and blanks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    known = set(df.columns)
    unknown = [name for name in names if name not in known]
    if unknown:
        raise KeyError(f"Columns not found: {unknown}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(kind: T.DataType) -> bool:
    """Numbers and booleans both count as numeric, as they do for medians and means."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_timestamp(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def free_name(df: DataFrame, stem: str) -> str:
    """A helper column name that does not collide with the table's own."""
    name = stem
    while name in df.columns:
        name = "_" + name
    return name
