"""Writing tables and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet keeps the types; CSV (header, no index) is written only when asked for."""
    if format == "parquet":
        df.write.mode(mode).parquet(path)
    elif format == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"Unsupported output format: {format!r}. Supported: parquet, csv")


def json_records(df: DataFrame, n: int = 20, key: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows as JSON text, missing values written as null."""
    order = [col(c) for c in (key if key is not None else df.columns)]
    row = F.struct(*[col(c) for c in df.columns])
    return df.orderBy(*order).limit(n).select(F.to_json(row, {"ignoreNullFields": "false"}).alias("record"))
