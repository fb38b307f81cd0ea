"""Learners on flags, where what they must find can be stated: a tree that may use every flag
ends in one leaf per combination, whatever cut points it draws and in whichever order it cuts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tidemill.catalog.base import EVENTS_DIRTY, LINEITEM_KEY, events_dirty, query, r, rounded, table
from tidemill.catalog.history import _V2, _v2
from tidemill.models.fitting import fit_model
from tidemill.operators import features, scalars
from tidemill.plans.chain import preview_chain
from tidemill.plans.snapshots import SnapshotStore
from tidemill.session import shared_dir

_KEY = ", ".join(LINEITEM_KEY)
FLAGS = ["f1", "f2", "f3"]

_FLAGS = f"""flags AS (SELECT {_KEY}, CAST(l_discount > 0.05 AS INT) AS f1, CAST(l_quantity > 25 AS INT) AS f2, CAST(l_tax > 0.04 AS INT) AS f3,
  l_extendedprice, CASE WHEN (l_quantity * 0.04::DOUBLE + l_discount * 10 > 1.5) <> (l_partkey % 7 = 0) THEN 1 ELSE 0 END AS y FROM lineitem)"""


def _flags(spark, sf):
    li = table(spark, sf, "lineitem")
    told = (F.col("l_quantity") * 0.04 + F.col("l_discount") * 10 > 1.5) != (F.col("l_partkey") % 7 == 0)
    cuts = {"f1": F.col("l_discount") > 0.05, "f2": F.col("l_quantity") > 25, "f3": F.col("l_tax") > 0.04}
    return li.select(*LINEITEM_KEY, *[c.cast("int").alias(n) for n, c in cuts.items()], "l_extendedprice", told.cast("bigint").alias("y"))


_SHARE = f"""WITH {_FLAGS}, cell AS (SELECT f1, f2, f3, avg(y) AS p FROM flags GROUP BY 1, 2, 3)
SELECT {_KEY}, CAST(p > 0.5 AS BIGINT) AS prediction{{p}} FROM flags JOIN cell USING (f1, f2, f3)"""
_MEAN = f"""WITH {_FLAGS}, cell AS (SELECT f1, f2, f3, avg(l_extendedprice) AS m FROM flags GROUP BY 1, 2, 3)
SELECT {_KEY}, round(m, 3) AS prediction FROM flags JOIN cell USING (f1, f2, f3)"""
# boosting fits +1 and -1, and takes the logistic curve of twice the sum; Spark's classification
# trees merge leaves that predict alike, so only their predictions are those of the cells
_BOOSTED = ", round(1 / (1 + exp(-2 * (2 * p - 1))), 5) AS p"
_ALL = {"max_depth": 3, "max_features": None}
_SHARES = {
    "decision_tree": (_ALL, ""),
    "random_forest": ({**_ALL, "n_estimators": 3, "bootstrap": False}, ""),
    "extra_trees": ({**_ALL, "n_estimators": 3, "bootstrap": False}, ""),
    "bagging": ({"n_estimators": 2, "bootstrap": False}, ""),
    "gradient_boosting": ({"n_estimators": 1, "max_depth": 3}, _BOOSTED),
    "hist_gradient_boosting": ({"max_iter": 1, "max_leaf_nodes": 8}, _BOOSTED),
    "xgb": ({"n_estimators": 1, "max_depth": 3}, _BOOSTED),
}


def _register(name: str, params: dict, share: str) -> None:
    @query(f"{name}_cells_classifier", _SHARE.format(p=share))
    def classifier(spark, sf):
        df = _flags(spark, sf)
        model = fit_model(df, f"{name}_classifier", "classification", FLAGS, "y", params)
        out = model.transform(df)
        p = [F.round(F.col("probability")[1], 5).alias("p")] if share else []
        return out.select(*LINEITEM_KEY, F.col("prediction").cast("bigint").alias("prediction"), *p)

    @query(f"{name}_cells_regressor", _MEAN)
    def regressor(spark, sf):
        df = _flags(spark, sf)
        model = fit_model(df, f"{name}_regressor", "regression", FLAGS, "l_extendedprice", params)
        return model.transform(df).select(*LINEITEM_KEY, r("prediction", 3).alias("prediction"))


for _name, (_params, _share) in _SHARES.items():
    _register(_name, _params, _share)


# --- one flag: a line or curve goes through both means ------------------------------------

_ONE = f"""WITH {_FLAGS}, cell AS (SELECT f2, avg(y) AS p, avg(l_extendedprice) AS m FROM flags GROUP BY 1)
SELECT {_KEY}, {{value}} FROM flags JOIN cell USING (f2)"""


def _one_flag(name: str, model_name: str, params: dict) -> None:
    @query(name, _ONE.format(value="CAST(p > 0.5 AS BIGINT) AS prediction, round(p, 3) AS p"))
    def run(spark, sf):
        df = _flags(spark, sf)
        out = fit_model(df, model_name, "classification", ["f2"], "y", params).transform(df)
        return out.select(*LINEITEM_KEY, F.col("prediction").cast("bigint").alias("prediction"), F.round(F.col("probability")[1], 3).alias("p"))


_one_flag("logistic_one_flag", "logistic_regression", {"penalty": "none"})
_one_flag("sgd_log_loss_one_flag", "sgd_classifier", {"loss": "log_loss", "alpha": 0.0})


@query("sgd_squared_error_one_flag", _ONE.format(value="round(m, 2) AS prediction"))
def sgd_squared_error_one_flag(spark, sf):
    df = _flags(spark, sf)
    params = {"loss": "squared_error", "alpha": 0.0}
    out = fit_model(df, "sgd_regressor", "regression", ["f2"], "l_extendedprice", params).transform(df)
    return out.select(*LINEITEM_KEY, r("prediction", 2).alias("prediction"))


# --- boosting over two rounds --------------------------------------------------------------


def _round(i: int) -> str:
    """The best flag by weighted impurity, its error, its vote, and the rows' next weights."""
    flag = f"CASE (SELECT j FROM b{i}) WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END"
    rows = " UNION ALL ".join(f"SELECT {j} AS j, f{j} AS v, y, w FROM t{i - 1}" for j in (1, 2, 3))
    return f"""c{i} AS (SELECT j, v, coalesce(sum(w) FILTER (y = 0), 0) AS n0, coalesce(sum(w) FILTER (y = 1), 0) AS n1 FROM ({rows}) GROUP BY 1, 2),
b{i} AS (SELECT j FROM c{i} GROUP BY j ORDER BY sum(n0 + n1 - (n0 * n0 + n1 * n1) / (n0 + n1)), j LIMIT 1),
p{i} AS (SELECT v, CAST(n1 > n0 AS INT) AS h FROM c{i} JOIN b{i} USING (j)),
s{i} AS (SELECT t{i - 1}.*, h AS h{i} FROM t{i - 1} JOIN p{i} ON v = {flag}),
a{i} AS (SELECT ln((1 - e) / e) AS alpha{i} FROM (SELECT sum(w) FILTER (h{i} <> y) / sum(w) AS e FROM s{i})),
t{i} AS (SELECT * REPLACE (w * exp(alpha{i} * CAST(h{i} <> y AS INT)) AS w) FROM s{i}, a{i})"""


@query(
    "adaboost_two_rounds",
    f"""WITH {_FLAGS}, t0 AS (SELECT *, 1.0::DOUBLE AS w FROM flags), {_round(1)}, {_round(2)},
v AS (SELECT {_KEY}, (alpha1 * h1 + alpha2 * h2) / (alpha1 + alpha2) AS one FROM t2)
SELECT {_KEY}, CAST(one > 1 - one AS BIGINT) AS prediction, round(exp(2 * one - 1) / (exp(2 * one - 1) + exp(1 - 2 * one)), 6) AS p FROM v""",
)
def adaboost_two_rounds(spark, sf):
    df = _flags(spark, sf)
    out = fit_model(df, "adaboost_classifier", "classification", FLAGS, "y", {"n_estimators": 2}).transform(df)
    return out.select(*LINEITEM_KEY, F.col("prediction").cast("bigint").alias("prediction"), F.round(F.col("probability")[1], 6).alias("p"))


@query(
    "adaboost_regressor_two_rounds",
    f"""WITH {_FLAGS}, c1 AS (SELECT f1, f2, f3, avg(l_extendedprice) AS m1 FROM flags GROUP BY 1, 2, 3),
e1 AS (SELECT *, abs(m1 - l_extendedprice) AS miss FROM flags JOIN c1 USING (f1, f2, f3)),
l1 AS (SELECT worst, loss / (1 - loss) AS beta1 FROM (SELECT max(miss) AS worst, avg(miss) / max(miss) AS loss FROM e1)),
w1 AS (SELECT e1.*, beta1, exp(ln(beta1) * (1 - miss / worst)) AS w FROM e1, l1),
c2 AS (SELECT f1, f2, f3, sum(w * l_extendedprice) / sum(w) AS m2 FROM w1 GROUP BY 1, 2, 3),
e2 AS (SELECT *, abs(m2 - l_extendedprice) AS miss2 FROM w1 JOIN c2 USING (f1, f2, f3)),
l2 AS (SELECT loss / (1 - loss) AS beta2 FROM (SELECT sum(w * miss2) / sum(w) / max(miss2) AS loss FROM e2)),
v AS (SELECT {_KEY}, least(m1, m2) AS low, greatest(m1, m2) AS high, CASE WHEN m1 <= m2 THEN ln(1 / beta1) ELSE ln(1 / beta2) END AS weight,
  (ln(1 / beta1) + ln(1 / beta2)) / 2 AS half FROM e2, l2)
SELECT {_KEY}, round(CASE WHEN weight >= half THEN low ELSE high END, 3) AS prediction FROM v""",
)
def adaboost_regressor_two_rounds(spark, sf):
    df = _flags(spark, sf)
    out = fit_model(df, "adaboost_regressor", "regression", FLAGS, "l_extendedprice", {"n_estimators": 2}).transform(df)
    return out.select(*LINEITEM_KEY, r("prediction", 3).alias("prediction"))


# --- what had no row yet -------------------------------------------------------------------


@query(
    "convert_datetime",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS day FROM orders""",
)
def convert_datetime(spark, sf):
    """Texts to times; what is no date becomes missing."""
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("no date")
    told = scalars.convert_dtype(o.select("o_orderkey", text.alias("day")), "day", "datetime")
    return told.select("o_orderkey", F.col("day").cast("timestamp_ntz").alias("day"))


@query(
    "imputer_unseen",
    f"""WITH {EVENTS_DIRTY}, m AS (SELECT median(value) AS v FROM dirty WHERE value IS NOT NULL AND event_type IS NOT NULL),
t AS (SELECT event_type AS t FROM dirty WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
d AS (SELECT event_id, coalesce(value, v) AS value, coalesce(event_type, t) AS event_type FROM dirty, m, t)
SELECT event_id, round(value, 6) AS value, CAST(event_type = 'click' AS INT) AS event_type_click, CAST(event_type = 'error' AS INT) AS event_type_error,
  CAST(event_type = 'purchase' AS INT) AS event_type_purchase, CAST(event_type = 'signup' AS INT) AS event_type_signup, CAST(event_type = 'view' AS INT) AS event_type_view FROM d""",
)
def imputer_unseen(spark, sf):
    """Fitted on rows without a missing value, applied to rows with some."""
    d = events_dirty(spark, sf).select("event_id", "value", "event_type")
    plan = features.fit_transformer(d.dropna(), ["value"], ["event_type"], scaling="none")
    return rounded(plan.apply(d, ["event_id"]), ["value"])


@query(
    "chain_preview",
    f"""WITH {EVENTS_DIRTY}, f AS (SELECT * FROM dirty WHERE value > 50)
SELECT (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM f) AS rows_after, 6::BIGINT AS columns_before, 5::BIGINT AS columns_after,
  (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM f ORDER BY event_id LIMIT 5)) AS first_ids""",
)
def chain_preview(spark, sf):
    """A dry run: shapes before and after, and the first rows of the result."""
    steps = [{"operation": "filter_rows", "expression": "value > 50"}, {"operation": "drop_columns", "columns": "props"}]
    told = preview_chain(events_dirty(spark, sf), steps, 5, key=["event_id"])
    ids = ",".join(str(row["event_id"]) for row in told["preview"])
    row = (told["before_shape"][0], told["after_shape"][0], told["before_shape"][1], told["after_shape"][1], ids)
    return spark.createDataFrame([row], "rows_before bigint, rows_after bigint, columns_before bigint, columns_after bigint, first_ids string")


@query(
    "snapshot_differences",
    f"""WITH {_V2}, n AS (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(*) FROM v2) AS b)
SELECT 'rows' AS kind, NULL AS "column", CAST(a AS VARCHAR) AS before, CAST(b AS VARCHAR) AS after FROM n WHERE a <> b
UNION ALL SELECT 'added', 'extra', NULL, 'string' """
    + " ".join(
        f"""UNION ALL SELECT 'values', '{c}', NULL, CAST(n AS VARCHAR) FROM (SELECT count(*) FILTER (b.c_custkey IS NULL OR a.{c} IS DISTINCT FROM b.{c}) AS n
 FROM customer a LEFT JOIN v2 b ON a.c_custkey = b.c_custkey) WHERE n > 0"""
        for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ),
)
def snapshot_differences(spark, sf):
    """Two snapshots of a table, and what is not alike in them."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/tidemill-versions-{uuid4().hex}")
    first = store.create(table(spark, sf, "customer"), "customer")
    second = store.create(_v2(spark, sf), "customer")
    return store.differences(first["id"], second["id"], ["c_custkey"]).where("kind <> 'hash'")


@query(
    "snapshot_list",
    """SELECT 'orders' AS name, 1 AS version, count(*) AS rows FROM orders UNION ALL
SELECT 'orders', 3, count(*) FROM orders WHERE o_orderstatus = 'F'""",
)
def snapshot_list(spark, sf):
    """Three snapshots, of which the second is deleted: its number stays taken."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/tidemill-versions-{uuid4().hex}")
    o = table(spark, sf, "orders")
    store.create(o, "orders")
    store.delete(store.create(o.where("o_orderstatus = 'O'"), "orders")["id"])
    store.create(o.where("o_orderstatus = 'F'"), "orders")
    return store.list("orders").select("name", "version", "rows")
