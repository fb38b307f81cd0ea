"""Fills, filters, casts, dates, currency, maths, outliers, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.base import (
    EVENTS_DIRTY,
    SQL_NUMBER,
    events_dirty,
    query,
    r,
    rounded,
    table,
)
from tidemill.operators import missing, outliers, rows, scalars
from tidemill.plans.chain import apply_operations, audit_once, fit_chain

_FILLED = "event_id, ts, user_id, event_type, round({value}, 6) AS value, props"


def _fill_sql(value: str) -> str:
    return f"WITH {EVENTS_DIRTY} SELECT {_FILLED.format(value=value)} FROM dirty"


@query("fill_mean", _fill_sql("coalesce(value, (SELECT avg(value) FROM dirty))"))
def fill_mean(spark, sf):
    return rounded(missing.fill_missing(events_dirty(spark, sf), "value", "mean"), ["value"])


@query("fill_median", _fill_sql("coalesce(value, (SELECT median(value) FROM dirty))"))
def fill_median(spark, sf):
    return rounded(missing.fill_missing(events_dirty(spark, sf), "value", "median"), ["value"])


_MODE = "(SELECT event_type FROM dirty WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_MODE_VALUE = "(SELECT value FROM dirty WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "fill_mode",
    f"""WITH {EVENTS_DIRTY}
SELECT event_id, ts, user_id, coalesce(event_type, {_MODE}) AS event_type,
       coalesce(value, {_MODE_VALUE}) AS value, props FROM dirty""",
)
def fill_mode(spark, sf):
    return missing.fill_missing(events_dirty(spark, sf), ["event_type", "value"], "most_frequent")


@query(
    "fill_constant",
    f"""WITH {EVENTS_DIRTY}
SELECT event_id, ts, user_id, coalesce(event_type, 'missing') AS event_type, value, props FROM dirty""",
)
def fill_constant(spark, sf):
    return missing.fill_missing(events_dirty(spark, sf), "event_type", "constant")


@query(
    "auto_fill",
    f"""WITH {EVENTS_DIRTY}
SELECT event_id, ts, user_id, coalesce(event_type, {_MODE}) AS event_type,
       round(coalesce(value, (SELECT median(value) FROM dirty)), 6) AS value, props FROM dirty""",
)
def auto_fill(spark, sf):
    return rounded(missing.auto_fill(events_dirty(spark, sf)), ["value"])


@query("drop_missing_any", f"WITH {EVENTS_DIRTY} SELECT * FROM dirty WHERE event_type IS NOT NULL AND value IS NOT NULL")
def drop_missing_any(spark, sf):
    return rows.drop_missing_rows(events_dirty(spark, sf))


@query(
    "drop_missing_all",
    f"WITH {EVENTS_DIRTY} SELECT * FROM dirty WHERE event_type IS NOT NULL OR value IS NOT NULL",
)
def drop_missing_all(spark, sf):
    return rows.drop_missing_rows(events_dirty(spark, sf), ["event_type", "value"], "all")


@query("drop_empty_columns", f"WITH {EVENTS_DIRTY} SELECT * FROM dirty")
def drop_empty_columns(spark, sf):
    return rows.drop_empty_columns(events_dirty(spark, sf).withColumn("empty", F.lit(None).cast("double")))


@query(
    "drop_dups_full",
    "SELECT DISTINCT * FROM (SELECT lang, source, text FROM documents UNION ALL SELECT lang, source, text FROM documents)",
)
def drop_dups_full(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", "text")
    return rows.drop_duplicates(d.unionByName(d))


@query(
    "drop_dups_subset",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
)
def drop_dups_subset(spark, sf):
    return rows.drop_duplicates(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"])


@query("filter_compare", "SELECT * FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05 AND l_returnflag IN ('A', 'R')")
def filter_compare(spark, sf):
    return rows.filter_rows(
        table(spark, sf, "lineitem"), "l_quantity > 30 & l_discount <= 0.05 & l_returnflag in ['A', 'R']"
    )


@query(
    "filter_null_logic",
    f"""WITH {EVENTS_DIRTY}
SELECT * FROM dirty WHERE (event_type <> 'click' OR event_type IS NULL)
  AND (NOT (value > 50) OR value IS NULL) AND (user_id NOT IN (1, 2, 3) OR user_id IS NULL)""",
)
def filter_null_logic(spark, sf):
    return rows.filter_rows(
        events_dirty(spark, sf), "event_type != 'click' and not (value > 50) and user_id not in [1, 2, 3]"
    )


@query(
    "filter_arithmetic",
    """SELECT * FROM orders WHERE (o_totalprice / 1000 + 1 > 50 AND 100000 < o_totalprice AND o_totalprice <= 200000)
   OR o_orderstatus = 'F'""",
)
def filter_arithmetic(spark, sf):
    return rows.filter_rows(
        table(spark, sf, "orders"),
        "(`o_totalprice` / 1000 + 1 > 50 and 100000 < o_totalprice <= 200000) | o_orderstatus == 'F'",
    )


@query("drop_rename", "SELECT o_orderkey AS o_custkey, o_custkey AS o_orderkey, o_totalprice AS price, o_orderdate FROM orders")
def drop_rename(spark, sf):
    kept = rows.drop_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return rows.rename_columns(
        kept, {"o_orderkey": "o_custkey", "o_custkey": "o_orderkey", "o_totalprice": "price"}
    )


@query("preview_head", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def preview_head(spark, sf):
    return rows.head(table(spark, sf, "customer"), 20, ["c_custkey"])


# --- casts -----------------------------------------------------------------------------

_MONEY = """money AS (
  SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'n/a'
    ELSE concat(' $', CAST(c_custkey * 7919 // 1000 AS VARCHAR), ',', lpad(CAST(c_custkey * 7919 % 1000 AS VARCHAR), 3, '0')) END AS price,
    concat(CAST(c_custkey % 101 AS VARCHAR), '%') AS rate,
    CASE WHEN c_custkey % 5 = 0 THEN '1d' WHEN c_custkey % 5 = 1 THEN '1_0' WHEN c_custkey % 5 = 2 THEN concat(' ', CAST(c_custkey AS VARCHAR), 'e1 ')
         WHEN c_custkey % 5 = 3 THEN '.5' ELSE '' END AS odd
  FROM customer)"""


def _money(spark, sf):
    k = F.col("c_custkey")
    thousands = F.floor(k * 7919 / 1000).cast("string")
    rest = F.lpad((k * 7919 % 1000).cast("string"), 3, "0")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 13 == 0, "n/a").otherwise(F.concat(F.lit(" $"), thousands, F.lit(","), rest)).alias("price"),
        F.concat((k % 101).cast("string"), F.lit("%")).alias("rate"),
        F.when(k % 5 == 0, "1d")
        .when(k % 5 == 1, "1_0")
        .when(k % 5 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit("e1 ")))
        .when(k % 5 == 3, ".5")
        .otherwise("")
        .alias("odd"),
    )


@query(
    "cast_numeric",
    f"""WITH {_MONEY} SELECT c_custkey, CASE WHEN regexp_matches(odd, '{SQL_NUMBER}') THEN CAST(trim(odd) AS DOUBLE) END AS odd FROM money""",
)
def cast_numeric(spark, sf):
    return scalars.convert_dtype(_money(spark, sf).select("c_custkey", "odd"), "odd", "numeric")


@query("cast_int", "SELECT l_orderkey, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice FROM lineitem")
def cast_int(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    return scalars.convert_dtype(li, "l_extendedprice", "int")


@query("cast_float", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def cast_float(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"))
    return scalars.convert_dtype(p, "p_size", "float")


@query(
    "cast_bool",
    f"""WITH {EVENTS_DIRTY} SELECT event_id, CASE WHEN event_type IS NULL THEN TRUE ELSE event_type <> '' END AS event_type,
       CASE WHEN value IS NULL THEN TRUE ELSE value <> 0 END AS value FROM dirty""",
)
def cast_bool(spark, sf):
    d = events_dirty(spark, sf).select("event_id", "event_type", "value")
    return scalars.convert_dtype(scalars.convert_dtype(d, "event_type", "bool"), "value", "bool")


@query("cast_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_string(spark, sf):
    return scalars.convert_dtype(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "string")


@query("cast_category", "SELECT p_partkey, p_type FROM part")
def cast_category(spark, sf):
    return scalars.convert_dtype(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "category")


_DATES = """texts AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'junk' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
         strftime(o_orderdate, '%d/%m/%Y') AS e FROM orders)"""


def _dates(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 17 == 0, "junk").otherwise(day).alias("d"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("e"),
    )


@query(
    "parse_dates",
    f"""WITH {_DATES} SELECT o_orderkey, strftime(TRY_CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS d,
       strftime(strptime(e, '%d/%m/%Y'), '%Y-%m-%d %H:%M:%S') AS e FROM texts""",
)
def parse_dates(spark, sf):
    parsed = scalars.parse_dates(scalars.parse_dates(_dates(spark, sf), "d"), "e", ["dd/MM/yyyy"])
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("d", "e")}
    return parsed.withColumns(shown)


_PARTS = [
    ("year", "year(d)"),
    ("month", "month(d)"),
    ("day", "day(d)"),
    ("day_of_week", "isodow(d) - 1"),
    ("day_of_year", "dayofyear(d)"),
    ("week_of_year", "weekofyear(d)"),
    ("quarter", "quarter(d)"),
    ("hour", "hour(d)"),
    ("is_month_start", "coalesce(CAST(day(d) = 1 AS INT), 0)"),
    ("is_month_end", "coalesce(CAST(last_day(d) = CAST(d AS DATE) AS INT), 0)"),
    ("is_weekend", "coalesce(CAST(isodow(d) >= 6 AS INT), 0)"),
]


@query(
    "date_features",
    f"""WITH {_DATES}, parsed AS (SELECT o_orderkey, TRY_CAST(d AS TIMESTAMP) AS d FROM texts)
SELECT o_orderkey, {", ".join(f"CAST({sql} AS BIGINT) AS d_{n}" for n, sql in _PARTS)} FROM parsed""",
)
def date_features(spark, sf):
    names = [n for n, _ in _PARTS]
    made = scalars.create_date_features(_dates(spark, sf).drop("e"), "d", names)
    return made.select("o_orderkey", *[F.col(f"d_{n}").cast("bigint").alias(f"d_{n}") for n in names])


@query(
    "date_features_ts",
    f"""SELECT event_id, {", ".join(f"CAST({sql.replace('(d)', '(ts)').replace('CAST(d ', 'CAST(ts ')} AS BIGINT) AS ts_{n}" for n, sql in _PARTS)} FROM events""",
)
def date_features_ts(spark, sf):
    names = [n for n, _ in _PARTS]
    made = scalars.create_date_features(table(spark, sf, "events").select("event_id", "ts"), "ts", names)
    return made.select("event_id", *[F.col(f"ts_{n}").cast("bigint").alias(f"ts_{n}") for n in names])


@query(
    "clean_currency",
    f"""WITH {_MONEY}, bare AS (SELECT c_custkey, trim(translate(price, '$€£¥,', '')) AS price FROM money)
SELECT c_custkey, CASE WHEN regexp_matches(price, '{SQL_NUMBER}') THEN CAST(price AS DOUBLE) END AS price FROM bare""",
)
def clean_currency(spark, sf):
    return scalars.clean_numeric(_money(spark, sf).select("c_custkey", "price"), "price")


@query(
    "clean_percent",
    f"WITH {_MONEY} SELECT c_custkey, round(CAST(replace(rate, '%', '') AS DOUBLE) / 100, 6) AS rate FROM money",
)
def clean_percent(spark, sf):
    return rounded(
        scalars.clean_numeric(_money(spark, sf).select("c_custkey", "rate"), "rate", percent=True), ["rate"]
    )


@query("log1p", "SELECT l_orderkey, round(ln(1 + l_extendedprice), 6) AS l_extendedprice FROM lineitem")
def log1p(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    return rounded(scalars.transform_numeric(li, "l_extendedprice", "log1p"), ["l_extendedprice"])


@query("sqrt", "SELECT l_orderkey, round(sqrt(l_quantity), 6) AS l_quantity FROM lineitem")
def sqrt(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    return rounded(scalars.transform_numeric(li, "l_quantity", "sqrt"), ["l_quantity"])


@query("square", "SELECT c_custkey, c_nationkey::BIGINT * c_nationkey AS c_nationkey, round(c_acctbal * c_acctbal, 4) AS c_acctbal FROM customer")
def square(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(scalars.transform_numeric(c, ["c_nationkey", "c_acctbal"], "square"), ["c_acctbal"], 4)


@query("absolute", "SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer")
def absolute(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return scalars.transform_numeric(c, "c_acctbal", "absolute")


# --- outliers --------------------------------------------------------------------------

_SPIKED = f"""{EVENTS_DIRTY}, spiked AS (
  SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN value * 100 ELSE value END AS value FROM dirty)"""
_IQR = """b AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
             quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM spiked)"""
_Z = "b AS (SELECT avg(value) - 2 * stddev_samp(value) AS lo, avg(value) + 2 * stddev_samp(value) AS hi FROM spiked)"


def _spiked(spark, sf):
    d = events_dirty(spark, sf)
    spike = F.when(F.col("event_id") % 97 == 0, F.col("value") * 100).otherwise(F.col("value"))
    return d.select("event_id", "user_id", spike.alias("value"))


def _bounds(spark, bounds):
    rows_ = [(c, *b) for c, b in sorted(bounds.items())]
    return rounded(spark.createDataFrame(rows_, "column string, lo double, hi double"), ["lo", "hi"], 4)


def _li_bounds(lo: str, hi: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round({lo.format(c=c)}, 4) AS lo, round({hi.format(c=c)}, 4) AS hi FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
    )


_Q = "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"


@query(
    "iqr_bounds",
    _li_bounds(
        "quantile_cont({c}, 0.25) - 1.5 * " + _Q, "quantile_cont({c}, 0.75) + 1.5 * " + _Q
    ),
)
def iqr_bounds(spark, sf):
    li = table(spark, sf, "lineitem")
    return _bounds(spark, outliers.outlier_bounds(li, ["l_extendedprice", "l_quantity"]))


@query("zscore_bounds", _li_bounds("avg({c}) - 2 * stddev_samp({c})", "avg({c}) + 2 * stddev_samp({c})"))
def zscore_bounds(spark, sf):
    li = table(spark, sf, "lineitem")
    return _bounds(spark, outliers.outlier_bounds(li, ["l_extendedprice", "l_quantity"], "zscore", 2))


@query(
    "detect_outliers",
    f"WITH {_SPIKED}, {_IQR} SELECT event_id, coalesce(value < lo OR value > hi, FALSE) AS value FROM spiked, b",
)
def detect_outliers(spark, sf):
    return outliers.detect_outliers(_spiked(spark, sf), "value", key=["event_id"])


@query(
    "remove_outliers",
    f"WITH {_SPIKED}, {_IQR} SELECT event_id, user_id, value FROM spiked, b WHERE NOT coalesce(value < lo OR value > hi, FALSE)",
)
def remove_outliers(spark, sf):
    return outliers.remove_outliers(_spiked(spark, sf), "value")


@query(
    "remove_outliers_zscore",
    f"WITH {_SPIKED}, {_Z} SELECT event_id, user_id, value FROM spiked, b WHERE NOT coalesce(value < lo OR value > hi, FALSE)",
)
def remove_outliers_zscore(spark, sf):
    return outliers.remove_outliers(_spiked(spark, sf), "value", "zscore", 2)


@query(
    "clip_outliers",
    f"""WITH {_SPIKED}, {_IQR} SELECT event_id, user_id,
       round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, lo), hi) END, 4) AS value FROM spiked, b""",
)
def clip_outliers(spark, sf):
    return rounded(outliers.clip_outliers(_spiked(spark, sf), "value"), ["value"], 4)


# --- chains ----------------------------------------------------------------------------

CHAIN = [
    {"operation": "filter_rows", "expression": "user_id > 10"},
    {"operation": "fill_missing", "columns": "value", "strategy": "median"},
    {"operation": "drop_missing_rows", "columns": ["event_type"]},
    {"operation": "create_date_features", "column": "ts", "features": ["month", "is_weekend"]},
    {"operation": "clip_outliers", "columns": "value"},
    {"operation": "drop_columns", "columns": ["props", "ts"]},
]
_CHAIN_SQL = f"""{EVENTS_DIRTY}, f AS (SELECT * FROM dirty WHERE user_id > 10),
m AS (SELECT event_id, user_id, event_type, ts, coalesce(value, (SELECT median(value) FROM f)) AS value FROM f),
d AS (SELECT * FROM m WHERE event_type IS NOT NULL),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d)"""


@query(
    "clean_chain",
    f"""WITH {_CHAIN_SQL} SELECT event_id, user_id, event_type,
   round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 4) AS value,
   CAST(month(ts) AS BIGINT) AS ts_month, CAST(isodow(ts) >= 6 AS BIGINT) AS ts_is_weekend FROM d, b""",
)
def clean_chain(spark, sf):
    out = apply_operations(events_dirty(spark, sf), CHAIN, ["event_id"])
    return out.select(
        "event_id",
        "user_id",
        "event_type",
        r("value", 4).alias("value"),
        F.col("ts_month").cast("bigint").alias("ts_month"),
        F.col("ts_is_weekend").cast("bigint").alias("ts_is_weekend"),
    )


@query(
    "chain_audit",
    f"""WITH {_CHAIN_SQL}, n AS (SELECT (SELECT count(*) FROM dirty) AS a, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM d) AS d)
SELECT * FROM (
  SELECT 1::BIGINT AS step, 'filter_rows' AS operation, f AS rows, 6::BIGINT AS cols, f - a AS row_change, 0::BIGINT AS col_change FROM n
  UNION ALL SELECT 2, 'fill_missing', f, 6, 0, 0 FROM n
  UNION ALL SELECT 3, 'drop_missing_rows', d, 6, d - f, 0 FROM n
  UNION ALL SELECT 4, 'create_date_features', d, 8, 0, 2 FROM n
  UNION ALL SELECT 5, 'clip_outliers', d, 8, 0, 0 FROM n
  UNION ALL SELECT 6, 'drop_columns', d, 6, 0, -2 FROM n)""",
)
def chain_audit(spark, sf):
    dirty = events_dirty(spark, sf)
    out = audit_once(dirty, fit_chain(dirty, CHAIN, ["event_id"])[0])
    longs = {c: F.col(c).cast("bigint") for c in ("step", "cols", "col_change")}
    return out.withColumns(longs).drop("args")
