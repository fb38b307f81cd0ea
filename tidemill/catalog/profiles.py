"""Column profiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.base import (
    EVENTS_DIRTY,
    LINEITEM_PRED,
    events_dirty,
    lineitem_pred,
    query,
    r,
    rounded,
    table,
)
from tidemill.operators import metrics, profile

_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}
_NUMBERS = ["event_id", "user_id", "value"]


def _per_column(select: str) -> str:
    return " UNION ALL ".join(select.format(c=c, t=t) for c, t in _TYPES.items())


@query(
    "info",
    f"WITH {EVENTS_DIRTY} "
    + _per_column(
        """SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing,
   round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique" FROM dirty"""
    ),
)
def info(spark, sf):
    return profile.info(events_dirty(spark, sf))


@query(
    "missing_values",
    f"WITH {EVENTS_DIRTY} SELECT * FROM ("
    + _per_column(
        """SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
   round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM dirty"""
    )
    + ") WHERE missing > 0 ORDER BY missing DESC",
)
def missing_values(spark, sf):
    return profile.missing_values(events_dirty(spark, sf))


def _top(c: str, what: str) -> str:
    shown = f"CAST({c} AS VARCHAR)"
    pick = {"top": shown, "freq": "count(*)"}[what]
    return f"(SELECT {pick} FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _describe_sql() -> str:
    parts = []
    for c in _TYPES:
        if c in _NUMBERS:
            parts.append(
                f"""SELECT '{c}' AS "column", count({c}) AS "count", NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq,
   round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
   round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
   CAST(max({c}) AS DOUBLE) AS max FROM dirty"""
            )
        else:
            parts.append(
                f"""SELECT '{c}', count({c}), count(DISTINCT {c}), {_top(c, 'top')}, {_top(c, 'freq')},
   NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dirty"""
            )
    return f"WITH {EVENTS_DIRTY} SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@query("describe", _describe_sql())
def describe(spark, sf):
    out = profile.describe(events_dirty(spark, sf))
    return rounded(out, ["mean", "std", "q25", "q50", "q75"], 4)


@query("duplicates", "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS duplicates FROM documents")
def duplicates(spark, sf):
    return profile.duplicates(table(spark, sf, "documents").select("lang", "source", "text"))


@query("value_counts", f'WITH {EVENTS_DIRTY} SELECT event_type AS "value", count(*) AS "count" FROM dirty GROUP BY 1')
def value_counts(spark, sf):
    return profile.unique_values(events_dirty(spark, sf), "event_type")


@query(
    "class_distribution",
    f"""WITH {EVENTS_DIRTY} SELECT event_type AS "value",
   round_even(count(*)::DOUBLE / (SELECT count(*) FROM dirty) * 100, 2) AS pct FROM dirty GROUP BY 1""",
)
def class_distribution(spark, sf):
    return profile.class_distribution(events_dirty(spark, sf), "event_type")


@query(
    "class_distribution_top",
    """SELECT CAST(user_id AS VARCHAR) AS "value", round_even(count(*)::DOUBLE / (SELECT count(*) FROM events) * 100, 2) AS pct
FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 32""",
)
def class_distribution_top(spark, sf):
    return profile.top_classes(table(spark, sf, "events"), "user_id")


def _stats_sql() -> str:
    parts = []
    for c, t in _TYPES.items():
        head = f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing,
   round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique","""
        if c in _NUMBERS:
            parts.append(
                f"""{head} round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
   CAST(max({c}) AS DOUBLE) AS max, NULL::VARCHAR AS top, NULL::DOUBLE AS top_pct FROM dirty"""
            )
        else:
            parts.append(
                f"""{head} NULL, NULL, NULL, NULL, {_top(c, 'top')}, round_even({_top(c, 'freq')}::DOUBLE / count(*) * 100, 2) FROM dirty"""
            )
    return f"WITH {EVENTS_DIRTY} SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@query("column_stats", _stats_sql())
def column_stats(spark, sf):
    return rounded(profile.column_stats(events_dirty(spark, sf)), ["mean", "std"], 4)


@query(
    "feature_profile",
    f"""WITH {EVENTS_DIRTY}
SELECT 'value' AS "column", 'double' AS dtype, CAST((SELECT value FROM dirty ORDER BY event_id LIMIT 1) AS VARCHAR) AS sample,
   round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max FROM dirty
UNION ALL SELECT DISTINCT 'event_type', 'string', (SELECT event_type FROM dirty ORDER BY event_id LIMIT 1), NULL, NULL, NULL FROM dirty""",
)
def feature_profile(spark, sf):
    clean = events_dirty(spark, sf)
    return rounded(profile.feature_profile(clean, ["value", "event_type"], ["event_id"]), ["mean"], 4)


@query(
    "table_hash",
    """SELECT count(*) AS rows, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|',
  concat(length(CAST(c_custkey AS VARCHAR)), ':', c_custkey), concat(length(c_name), ':', c_name),
  concat(length(CAST(c_nationkey AS VARCHAR)), ':', c_nationkey), concat(length(c_mktsegment), ':', c_mktsegment))), 1, 15)) AS BIGINT)) AS VARCHAR) AS checksum
FROM customer""",
)
def table_hash(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return profile.content_hash(c).drop("hash")


# --- metrics ---------------------------------------------------------------------------


@query(
    "confusion",
    f"""WITH {LINEITEM_PRED}, l AS (SELECT DISTINCT l_returnflag AS v FROM pred UNION SELECT DISTINCT predicted FROM pred)
SELECT a.v AS actual, p.v AS predicted, (SELECT count(*) FROM pred WHERE l_returnflag = a.v AND predicted = p.v) AS n FROM l a, l p""",
)
def confusion(spark, sf):
    return metrics.confusion(lineitem_pred(spark, sf), "l_returnflag", "predicted")


def _metrics_sql(by: str) -> str:
    return f"""WITH {LINEITEM_PRED}, k AS (SELECT {by} AS "by", l_returnflag AS a, predicted AS p FROM pred),
s AS (SELECT "by", a AS g, count(*) AS support, count(*) FILTER (a = p) AS tp FROM k GROUP BY 1, 2),
m AS (SELECT "by", p AS g, count(*) AS named FROM k GROUP BY 1, 2),
j AS (SELECT s.*, coalesce(named, 0) AS named FROM s LEFT JOIN m USING ("by", g))
SELECT "by", round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
  round(sum(support * 2.0::DOUBLE * tp / (support + named)) / sum(support), 6) AS f1,
  round(sum(support * CASE WHEN named = 0 THEN 0 ELSE tp::DOUBLE / named END) / sum(support), 6) AS precision,
  round(sum(tp)::DOUBLE / sum(support), 6) AS recall FROM j GROUP BY 1"""


_CLASS = ["accuracy", "f1", "precision", "recall"]


@query("class_metrics", _metrics_sql("'all'"))
def class_metrics(spark, sf):
    return rounded(metrics.class_metrics(lineitem_pred(spark, sf), "l_returnflag", "predicted"), _CLASS)


@query("metrics_by_split", _metrics_sql("l_linestatus"))
def metrics_by_split(spark, sf):
    found = metrics.class_metrics(lineitem_pred(spark, sf), "l_returnflag", "predicted", "l_linestatus")
    return rounded(found, _CLASS)


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_quantity AS y, l_quantity + (l_partkey % 7 - 3) * 0.5::DOUBLE AS p, l_returnflag AS "by" FROM lineitem)
SELECT "by", round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM p GROUP BY 1""",
)
def regression_metrics(spark, sf):
    off = (F.col("l_partkey") % 7 - 3) * 0.5
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") + off)
    found = metrics.regression_metrics(li, "l_quantity", "p", "l_returnflag")
    return rounded(found, ["mse", "rmse", "mae", "r2"])


_SCORED = """scored AS (SELECT l_returnflag AS "by", (l_partkey % 1000) / 1000.0::DOUBLE AS s,
  CASE WHEN (l_partkey % 1000 + l_suppkey % 500) > 700 THEN 1 ELSE 0 END AS y FROM lineitem)"""


def _scored(spark, sf):
    li = table(spark, sf, "lineitem")
    part = F.col("l_partkey") % 1000
    y = ((part + F.col("l_suppkey") % 500) > 700).cast("bigint")
    return li.select(F.col("l_returnflag").alias("flag"), (part / 1000.0).alias("s"), y.alias("y"))


@query(
    "roc_auc",
    f"""WITH {_SCORED}, ranked AS (SELECT *, rank() OVER (PARTITION BY "by" ORDER BY s) + (count(*) OVER (PARTITION BY "by", s) - 1) / 2.0::DOUBLE AS rk FROM scored),
t AS (SELECT "by", sum(rk) FILTER (y = 1) AS rs, count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS n FROM ranked GROUP BY 1)
SELECT "by", round((rs - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM t""",
)
def roc_auc(spark, sf):
    found = metrics.roc_auc(_scored(spark, sf), "y", "s", 1, "flag")
    return found.select("by", r("roc_auc").alias("roc_auc"))


@query(
    "roc_auc_multiclass",
    """WITH b AS (SELECT l_returnflag AS y, CASE WHEN l_returnflag = 'A' THEN 0.6 ELSE 0.2 END::DOUBLE + (l_partkey % 11) / 20.0::DOUBLE AS a,
    CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 0.2 END::DOUBLE + (l_suppkey % 7) / 20.0::DOUBLE AS n, (l_partkey % 13) / 13.0::DOUBLE AS r FROM lineitem),
 u AS (SELECT 'A' AS g, y, a AS s FROM b UNION ALL SELECT 'N', y, n FROM b UNION ALL SELECT 'R', y, r FROM b),
 k AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS rk FROM u),
 t AS (SELECT g, sum(rk) FILTER (y = g) AS rs, count(*) FILTER (y = g)::DOUBLE AS p, count(*) FILTER (y <> g)::DOUBLE AS n FROM k GROUP BY 1)
SELECT 'all' AS "by", round(sum(p * (rs - p * (p + 1) / 2) / (p * n)) / sum(p), 6) AS roc_auc FROM t""",
)
def roc_auc_multiclass(spark, sf):
    flag = F.col("l_returnflag")
    a = F.when(flag == "A", 0.6).otherwise(0.2) + F.col("l_partkey") % 11 / 20.0
    n = F.when(flag == "N", 0.5).otherwise(0.2) + F.col("l_suppkey") % 7 / 20.0
    rest = F.col("l_partkey") % 13 / 13.0
    li = table(spark, sf, "lineitem").select("l_returnflag", F.array(a, n, rest).alias("probability"))
    found = metrics.roc_auc_weighted(li, "l_returnflag", "probability", ["A", "N", "R"])
    return found.select("by", r("roc_auc").alias("roc_auc"))
