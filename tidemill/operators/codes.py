"""Dictionaries as tables: ``value, code`` for columns with any number of values.

A dictionary is one row per different value, written to the shared folder. It is joined,
not carried in the plan; Spark gets it as a broadcast only below a counted size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.columns import col, free_name, require_columns
from tidemill.session import shared_path, written

BROADCAST_ROWS = 200_000


def number_in_order(df: DataFrame, order: Sequence[str], name: str = "code", step: Column | None = None) -> DataFrame:
    """``df`` with 0, 1, 2 ... in ascending order of columns that tell its rows apart; with
    ``step`` (a whole number per row) the sum of the steps of the rows before.

    Rows are dealt into ranges and numbered inside them; the ranges' sums, one number each,
    say where a range starts. So no task sees more than a range.
    """
    step = F.lit(1) if step is None else step
    part, start = free_name(df, "_part"), free_name(df, "_start")
    keys = [col(c) for c in order]
    ranged = written(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(part).agg(F.sum(step).alias(start)).orderBy(part).collect()
    starts, upto = [], 0
    for r in sizes:  # one per partition
        starts.append((r[part], upto))
        upto += r[start]
    known = df.sparkSession.createDataFrame(starts, f"`{part}` int, `{start}` bigint")
    before = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(step).over(before), F.lit(0))
    numbered = ranged.join(F.broadcast(known), part).withColumn(name, F.col(start) + place)
    return numbered.select(*[col(c) for c in df.columns], F.col(name).cast("bigint").alias(name))


@dataclass(frozen=True)
class CodeTable:
    """A written dictionary and its number of values."""

    path: str
    rows: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("value string, code bigint").parquet(self.path)

    def encode(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """``df`` with the code of ``value`` (as text); NULL for a value that is not there."""
        key, code, text = free_name(df, "_value"), free_name(df, "_code"), free_name(df, "_text")
        known = self.read(df.sparkSession).select(F.col("value").alias(key), F.col("code").alias(code))
        known = F.broadcast(known) if self.rows <= BROADCAST_ROWS else known
        joined = df.withColumn(text, value.cast("string")).join(known, F.col(text) == F.col(key), "left")
        return joined.select(*[col(c) for c in df.columns], F.col(code).alias(name))


def fit_codes(df: DataFrame, column: str, order: str = "alphabet", key: Sequence[str] = ()) -> CodeTable:
    """Codes 0, 1, 2 ... of the values of a column (as text), alphabetically or by first
    appearance in ``key`` order; equal first places go by value. NULL has no code."""
    if order not in ("first", "alphabet"):
        raise ValueError("order must be 'first' or 'alphabet'.")
    require_columns(df, [column, *key])
    rows = df.where(col(column).isNotNull()).select(
        col(column).cast("string").alias("value"), *[col(k).alias(f"k{i}") for i, k in enumerate(key)]
    )
    if order == "alphabet" or not key:
        numbered = number_in_order(rows.select("value").distinct(), ["value"])
    else:
        firsts = rows.groupBy("value").agg(F.min(F.struct(*[f"k{i}" for i in range(len(key))])).alias("place"))
        names = [f"k{i}" for i in range(len(key))]
        numbered = number_in_order(firsts.select("value", "place.*"), [*names, "value"])
    path = shared_path(df.sparkSession, "codes")
    return CodeTable(path, written(numbered.select("value", "code"), "codes", path).count())
