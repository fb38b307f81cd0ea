"""Registration, the test tables, and the rules that put dirt into them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.readers import DatasetRef, load


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        REGISTERED[name] = Query(function, sql)
        return function

    return add


LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; they hold no NaN, so filters may reach the Parquet reader."""
    return load(spark, DatasetRef(f"{sf}/{name}.parquet", nan_free=True))


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def events_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Missing numbers and texts at fixed places."""
    e = table(spark, sf, "events")
    return e.withColumns(
        {
            "event_type": F.when(F.col("event_id") % 11 != 0, F.col("event_type")),
            "value": F.when(F.col("event_id") % 7 != 0, F.col("value")),
        }
    )


EVENTS_DIRTY = """dirty AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS value, props
  FROM events)"""


def lineitem_y(spark: SparkSession, sf: str) -> DataFrame:
    """A label that depends on two of the three features."""
    li = table(spark, sf, "lineitem")
    score = F.col("l_quantity") * 0.04 + F.col("l_discount") * 10
    return li.select(
        *LINEITEM_KEY, "l_quantity", "l_discount", "l_tax", (score > 1.5).cast("bigint").alias("y")
    )


LINEITEM_Y = """labelled AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
         CASE WHEN l_quantity * 0.04::DOUBLE + l_discount * 10 > 1.5 THEN 1 ELSE 0 END AS y
  FROM lineitem)"""


def lineitem_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Return flags, and a prediction of them that is wrong at fixed places."""
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    other = F.when(flag == "A", "N").when(flag == "N", "R").otherwise("A")
    return li.withColumn("predicted", F.when(F.col("l_partkey") % 10 == 0, other).otherwise(flag))


LINEITEM_PRED = """pred AS (
  SELECT *, CASE WHEN l_partkey % 10 <> 0 THEN l_returnflag
                 WHEN l_returnflag = 'A' THEN 'N' WHEN l_returnflag = 'N' THEN 'R' ELSE 'A' END AS predicted
  FROM lineitem)"""

# The number pattern of the library, for the other side of the check.
SQL_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
