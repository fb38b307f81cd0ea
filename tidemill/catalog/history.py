"""Snapshot comparison and run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.base import query, table
from tidemill.plans import runs, snapshots

_V2 = """v2 AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
  c_mktsegment, 'new' AS extra FROM customer WHERE c_acctbal > -900)"""


def _v2(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > -900")
    raised = F.when(F.col("c_nationkey") == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    return c.withColumn("c_acctbal", raised).withColumn("extra", F.lit("new"))


@query(
    "diff_columns",
    f"""WITH {_V2} """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.{c} IS DISTINCT FROM b.{c}) > 0 AS changed,
   count(*) FILTER (a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.{c} IS DISTINCT FROM b.{c}) AS cells
 FROM customer a FULL JOIN v2 b ON a.c_custkey = b.c_custkey"""
        for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ),
)
def diff_columns(spark, sf):
    return snapshots.changed_columns(table(spark, sf, "customer"), _v2(spark, sf), ["c_custkey"])


_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query(
    "diff_rows",
    f"""WITH {_V2} SELECT *, 'a' AS side FROM (SELECT {_C} FROM customer EXCEPT ALL SELECT {_C} FROM v2)
UNION ALL SELECT *, 'b' FROM (SELECT {_C} FROM v2 EXCEPT ALL SELECT {_C} FROM customer)""",
)
def diff_rows(spark, sf):
    return snapshots.diff_rows(table(spark, sf, "customer"), _v2(spark, sf))


@query(
    "snapshot_summary",
    """SELECT count(*) AS rows, 5::BIGINT AS columns, 0::BIGINT AS missing_total,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicates FROM customer""",
)
def snapshot_summary(spark, sf):
    s = snapshots.summary(table(spark, sf, "customer"))
    row = (s["rows"], s["columns"], s["missing_total"], s["duplicates"])
    return spark.createDataFrame([row], "rows bigint, columns bigint, missing_total bigint, duplicates bigint")


def _log(spark, sf):
    """Events read as a metric log: a user is a run, an event type is a metric."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "error", "val_mse").otherwise(F.col("event_type")).alias("key"),
        "value",
        F.col("event_id").alias("step"),
        "ts",
    )


_LOG = """log AS (SELECT user_id AS run_id, CASE WHEN event_type = 'error' THEN 'val_mse' ELSE event_type END AS key,
  value, event_id AS step, ts FROM events)"""


@query(
    "run_list",
    f"""WITH {_LOG} SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_time, count(*) AS metrics
FROM log GROUP BY 1 ORDER BY min(ts) DESC, run_id LIMIT 50""",
)
def run_list(spark, sf):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_time", "end_time")}
    return runs.run_list(_log(spark, sf)).withColumns(shown)


@query(
    "metric_history",
    f"""WITH {_LOG} SELECT run_id, key, arg_max(value, step) AS last, min(value) AS low, max(value) AS high, count(*) AS points FROM log GROUP BY 1, 2""",
)
def metric_history(spark, sf):
    return runs.metric_history(_log(spark, sf))


_BEST = """l AS (SELECT run_id, key, arg_max(value, step) AS value FROM log GROUP BY 1, 2),
 e AS (SELECT key, CASE WHEN key = 'val_mse' THEN min(value) ELSE max(value) END AS best FROM l GROUP BY 1)"""


@query(
    "run_compare",
    f"WITH {_LOG}, {_BEST} SELECT key, run_id, value, abs(value - e.best) < 1e-12::DOUBLE AS best FROM l JOIN e USING (key)",
)
def run_compare(spark, sf):
    return runs.compare_runs(_log(spark, sf))


@query(
    "run_compare_table",
    f"""WITH {_LOG}, l AS (SELECT run_id, key, arg_max(value, step) AS value FROM log GROUP BY 1, 2)
SELECT key, max(value) FILTER (run_id = 1) AS "1", max(value) FILTER (run_id = 2) AS "2", max(value) FILTER (run_id = 3) AS "3" FROM l
WHERE run_id IN (1, 2, 3) GROUP BY 1""",
)
def run_compare_table(spark, sf):
    """The comparison is of runs the user picks, here three."""
    return runs.compare_table(_log(spark, sf), [1, 2, 3])


@query(
    "run_params",
    """SELECT o_custkey AS run_id, count(*) AS params, max(o_totalprice) AS highest FROM orders GROUP BY 1""",
)
def run_params(spark, sf):
    """Long parameters to one map per run, as the run detail reads them."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")
    )
    maps = runs.params_by_run(rows)
    return maps.select(
        "run_id",
        F.size("params").cast("bigint").alias("params"),
        F.array_max(F.map_values("params")).alias("highest"),
    )
