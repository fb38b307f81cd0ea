"""Model fits, tuning and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.catalog.base import LINEITEM_KEY, LINEITEM_Y, lineitem_y, query, r, table
from tidemill.models.fitting import class_probabilities, fit_model
from tidemill.models.tuning import grid_search
from tidemill.operators.metrics import evaluate
from tidemill.operators.splits import split
from tidemill.plans.experiment import run_experiment
from tidemill.session import spread_small

FEATURES = ["l_quantity", "l_discount", "l_tax"]
_KEY = ", ".join(LINEITEM_KEY)


# --- closed forms ----------------------------------------------------------------------


def _density(c: int) -> str:
    terms = " - ".join(
        f"0.5 * (ln(2 * pi() * v{c}_{i}) + ({f} - m{c}_{i}) * ({f} - m{c}_{i}) / v{c}_{i})"
        for i, f in enumerate(FEATURES)
    )
    return f"ln(n{c}) - {terms}"


_NB_STATS = ", ".join(
    f"count(*) FILTER (y = {c})::DOUBLE / count(*) AS n{c}, "
    + ", ".join(
        f"avg({f}) FILTER (y = {c}) AS m{c}_{i}, var_pop({f}) FILTER (y = {c}) + 1e-9::DOUBLE * (SELECT greatest(var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)) FROM labelled) AS v{c}_{i}"
        for i, f in enumerate(FEATURES)
    )
    for c in (0, 1)
)


@query(
    "gaussian_nb",
    f"""WITH {LINEITEM_Y}, s AS (SELECT {_NB_STATS} FROM labelled), j AS (SELECT {_KEY}, {_density(0)} AS d0, {_density(1)} AS d1 FROM labelled, s)
SELECT {_KEY}, CAST(d1 > d0 AS BIGINT) AS prediction, round(1 / (1 + exp(d0 - d1)), 6) AS p1 FROM j""",
)
def gaussian_nb(spark, sf):
    df = lineitem_y(spark, sf)
    scored = fit_model(df, "gaussian_nb_classifier", "classification", FEATURES, "y").transform(df)
    return scored.select(*LINEITEM_KEY, "prediction", r(F.col("probability")[1]).alias("p1"))


def _line(spark, sf, name, params=None, digits=4):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = fit_model(li, name, "regression", ["l_quantity"], "l_extendedprice", params)
    core = model.spark_model.stages[-1]
    row = (round(float(core.coefficients[0]), digits), round(float(core.intercept), digits))
    return spark.createDataFrame([row], "slope double, intercept double")


def _line_sql(slope: str, digits: int = 4) -> str:
    return f"""WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx,
  covar_pop(l_quantity, l_extendedprice) AS cxy FROM lineitem), b AS (SELECT *, {slope} AS slope FROM m)
SELECT round(slope, {digits}) AS slope, round(my - slope * mx, {digits}) AS intercept FROM b"""


@query("linear_regression", _line_sql("cxy / vx"))
def linear_regression(spark, sf):
    return _line(spark, sf, "linear_regression")


@query("ridge_regression", _line_sql("n * cxy / (n * vx + 50000)", 3))
def ridge_regression(spark, sf):
    return _line(spark, sf, "ridge_regression", {"alpha": 50000.0}, 3)


@query("lasso_regression", _line_sql("sign(cxy) * greatest(abs(cxy) - 40, 0) / vx", 3))
def lasso_regression(spark, sf):
    return _line(spark, sf, "lasso_regression", {"alpha": 40.0}, 3)


@query("elasticnet_regression", _line_sql("sign(cxy) * greatest(abs(cxy) - 40 * 0.3, 0) / (vx + 40 * 0.7)", 3))
def elasticnet_regression(spark, sf):
    return _line(spark, sf, "elasticnet_regression", {"alpha": 40.0, "l1_ratio": 0.3}, 3)


_PAIRS = """d AS (SELECT q.vec_id, t.vec_id AS tid, t.label, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS dist
  FROM embeddings q, embeddings t), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, tid) <= 5)"""


@query(
    "knn_classifier",
    f"""WITH {_PAIRS}, v AS (SELECT vec_id, label, count(*) AS n FROM k GROUP BY 1, 2)
SELECT vec_id, CAST(label AS BIGINT) AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""",
)
def knn_classifier(spark, sf):
    e = table(spark, sf, "embeddings")
    model = fit_model(e, "knn_classifier", "classification", ["embedding"], "label", key=["vec_id"])
    return model.transform(e).select("vec_id", F.col("prediction").cast("bigint").alias("prediction"))


@query("knn_regressor", f"WITH {_PAIRS} SELECT vec_id, round(avg(label), 6) AS prediction FROM k GROUP BY 1")
def knn_regressor(spark, sf):
    e = table(spark, sf, "embeddings")
    model = fit_model(e, "knn_regressor", "regression", ["embedding"], "label", key=["vec_id"])
    return model.transform(e).select("vec_id", r("prediction").alias("prediction"))


# --- a tree of depth one: every threshold between neighbouring values is tried ------------

_STUMP = f"""{LINEITEM_Y}, long AS (SELECT 0 AS f, l_quantity AS x, y FROM labelled UNION ALL SELECT 1, l_discount, y FROM labelled UNION ALL SELECT 2, l_tax, y FROM labelled),
g AS (SELECT f, x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM long GROUP BY 1, 2),
c AS (SELECT f, (x + lead(x) OVER w) / 2 AS t, sum(n) OVER w AS nl, sum(p) OVER w AS pl, sum(n) OVER (PARTITION BY f) AS nt, sum(p) OVER (PARTITION BY f) AS pt FROM g WINDOW w AS (PARTITION BY f ORDER BY x)),
s AS (SELECT f, t, nl, pl, nt - nl AS nr, pt - pl AS pr, nt FROM c WHERE t IS NOT NULL),
b AS (SELECT f, t, pl > nl / 2 AS lv, pr > nr / 2 AS rv FROM s
  ORDER BY (nl - (pl * pl + (nl - pl) * (nl - pl)) / nl) + (nr - (pr * pr + (nr - pr) * (nr - pr)) / nr) LIMIT 1)"""


@query(
    "decision_tree_classifier",
    f"""WITH {_STUMP} SELECT {_KEY}, CAST(CASE WHEN (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) <= t THEN lv ELSE rv END AS BIGINT) AS prediction
FROM labelled, b""",
)
def decision_tree_classifier(spark, sf):
    df = lineitem_y(spark, sf)
    params = {"max_depth": 1, "max_features": None}
    model = fit_model(df, "decision_tree_classifier", "classification", FEATURES, "y", params)
    return model.transform(df).select(*LINEITEM_KEY, "prediction")


@query(
    "adaboost_first_round",
    f"""WITH {_STUMP} SELECT {_KEY}, CAST(CASE WHEN (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) <= t THEN lv ELSE rv END AS BIGINT) AS prediction
FROM labelled, b""",
)
def adaboost_first_round(spark, sf):
    """One round of boosting is the best single split."""
    df = lineitem_y(spark, sf)
    model = fit_model(df, "adaboost_classifier", "classification", FEATURES, "y", {"n_estimators": 1})
    return model.transform(df).select(*LINEITEM_KEY, "prediction")


@query(
    "forest_of_one_tree",
    f"""WITH {_STUMP} SELECT {_KEY}, CAST(CASE WHEN (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) <= t THEN lv ELSE rv END AS BIGINT) AS prediction
FROM labelled, b""",
)
def forest_of_one_tree(spark, sf):
    """A forest of one tree over all rows and features is that tree."""
    df = lineitem_y(spark, sf)
    params = {"n_estimators": 1, "max_depth": 1, "max_features": None, "bootstrap": False}
    model = fit_model(df, "random_forest_classifier", "classification", FEATURES, "y", params)
    return model.transform(df).select(*LINEITEM_KEY, "prediction")


@query(
    "regression_stump",
    f"""WITH long AS (SELECT 0 AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 1, l_discount, l_extendedprice FROM lineitem
  UNION ALL SELECT 2, l_tax, l_extendedprice FROM lineitem),
g AS (SELECT f, x, count(*)::DOUBLE AS n, sum(y) AS p FROM long GROUP BY 1, 2),
c AS (SELECT f, (x + lead(x) OVER w) / 2 AS t, sum(n) OVER w AS nl, sum(p) OVER w AS pl, sum(n) OVER (PARTITION BY f) AS nt, sum(p) OVER (PARTITION BY f) AS pt FROM g WINDOW w AS (PARTITION BY f ORDER BY x)),
b AS (SELECT f, t, pl / nl AS lv, (pt - pl) / (nt - nl) AS rv FROM c WHERE t IS NOT NULL
  ORDER BY pl * pl / nl + (pt - pl) * (pt - pl) / (nt - nl) DESC LIMIT 1)
SELECT {_KEY}, round(CASE WHEN (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) <= t THEN lv ELSE rv END, 3) AS prediction FROM lineitem, b""",
)
def regression_stump(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINEITEM_KEY, *FEATURES, "l_extendedprice")
    params = {"max_depth": 1, "max_features": None}
    model = fit_model(li, "decision_tree_regressor", "regression", FEATURES, "l_extendedprice", params)
    return model.transform(li).select(*LINEITEM_KEY, r("prediction", 3).alias("prediction"))


# --- learners without a closed form: metrics per part ------------------------------------


def _fit_and_score(spark, sf, name, task="classification", params=None):
    label = "y" if task == "classification" else "l_extendedprice"
    if task == "classification":
        df = lineitem_y(spark, sf)
        used = FEATURES
    else:
        used = ["l_quantity", "l_discount", "p_retailprice"]
        part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        df = table(spark, sf, "lineitem").join(part, "l_partkey")
        df = df.select(*LINEITEM_KEY, *used, label)
    parted = split(df, label, 0.2, stratify=task == "classification", key=LINEITEM_KEY)
    # the keys have dealt the rows; kept, they would be half of what stays in memory and every task reads
    parted = spread_small(parted).select(*used, label, "split").persist()
    model = fit_model(parted.where("split = 'train'"), name, task, used, label, params)
    scored = model.transform(parted)
    found = evaluate(scored, task, label, "prediction", "split")
    return found.select("split", "metric", r("value", 4).alias("value"))


_SMALL = {"n_estimators": 5, "max_depth": 4}
_CLASSIFIERS = {
    "logistic_regression": {"max_iter": 50},
    "random_forest_classifier": {**_SMALL, "random_state": 1},
    "extra_trees_classifier": {**_SMALL, "random_state": 1},
    "bagging_classifier": {"n_estimators": 3},
    "gradient_boosting_classifier": {"n_estimators": 5, "max_depth": 3},
    "hist_gradient_boosting_classifier": {"max_iter": 5, "max_leaf_nodes": 8},
    "xgb_classifier": {"n_estimators": 5, "max_depth": 3},
    "xgb_rf_classifier": _SMALL,
    "adaboost_classifier": {"n_estimators": 5},
    "svm_classifier": {"C": 1.0},
    "sgd_classifier": {"max_iter": 50},
    "mlp_classifier": {"hidden_layer_sizes": "8", "max_iter": 40},
}
_REGRESSORS = {
    "decision_tree_regressor": {"max_depth": 4},
    "random_forest_regressor": _SMALL,
    "extra_trees_regressor": _SMALL,
    "bagging_regressor": {"n_estimators": 3},
    "gradient_boosting_regressor": {"n_estimators": 5},
    "hist_gradient_boosting_regressor": {"max_iter": 5, "max_leaf_nodes": 8},
    "xgb_regressor": {"n_estimators": 5, "max_depth": 3},
    "xgb_rf_regressor": _SMALL,
    "adaboost_regressor": {"n_estimators": 5},
    "sgd_regressor": {"max_iter": 100},
}


def _register(name: str, task: str, params: dict) -> None:
    @query(name)
    def run(spark, sf):
        return _fit_and_score(spark, sf, name, task, params)


for _name, _params in _CLASSIFIERS.items():
    _register(_name, "classification", _params)
for _name, _params in _REGRESSORS.items():
    _register(_name, "regression", _params)


@query("grid_search")
def grid(spark, sf):
    df = lineitem_y(spark, sf)
    found = grid_search(
        df,
        "decision_tree_classifier",
        "classification",
        FEATURES,
        {"max_depth": [1, 3]},
        "y",
        cv=3,
        n_jobs=2,
        key=LINEITEM_KEY,
    )
    rows = [(i, str(c["params"]["max_depth"]), round(c["mean_score"], 4)) for i, c in enumerate(found.candidates)]
    return spark.createDataFrame(rows, "candidate int, max_depth string, mean_score double")


_SPEC = {
    "dataset": "events",
    "target": "event_type",
    "model_name": "gaussian_nb_classifier",
    "operations": [
        {"operation": "create_date_features", "column": "ts", "features": ["hour", "day_of_week"]},
        {"operation": "fill_missing", "columns": "value", "strategy": "median"},
        {"operation": "transform_numeric", "columns": "value", "transformation": "log1p"},
    ],
    "drop": ["ts", "props"],
    "key": ["event_id"],
}


@query("experiment")
def experiment(spark, sf):
    """Operations, preparation, split, fit and metrics of every part."""
    found = run_experiment(table(spark, sf, "events"), _SPEC)
    return found.metrics.select("split", "metric", r("value", 4).alias("value"))


@query("batch_score")
def batch_score(spark, sf):
    """The fitted scorer on the raw table: prediction and class probabilities."""
    events = table(spark, sf, "events")
    found = run_experiment(events, _SPEC)
    scored = found.scorer.transform(events.drop("event_type"), ["event_id"])
    classes = found.scorer.model.classes
    return scored.select(
        "event_id",
        F.col("prediction").cast("bigint").alias("prediction"),
        F.round(F.array_max(F.map_values(class_probabilities(scored, classes))), 4).alias("p"),
    )
