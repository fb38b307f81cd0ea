import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.models import neighbours, registry
from tidemill.models.adaboost import read_tree
from tidemill.models.fitting import FittedModel, class_probabilities, fit_model
from tidemill.models.tuning import grid_search
from tidemill.operators.metrics import evaluate

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)) * [1.0, 2.0, 0.5]
    y = 3 * x[:, 0] - x[:, 1] + 0.2 * x[:, 2] + 1.5 + rng.normal(0, 0.3, 240)
    g = (x[:, 0] + x[:, 1] > 0.3).astype(int)
    h = np.digitize(x[:, 0], [-0.5, 0.5])
    return x, y, g, h


@pytest.fixture(scope="module")
def table(spark, numbers):
    x, y, g, h = numbers
    rows = [(i, *map(float, x[i]), float(y[i]), int(g[i]), int(h[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "k int, a double, b double, c double, y double, g int, h int").coalesce(2).cache()


def _coefficients(model):
    core = model.spark_model.stages[-1]
    return np.array(core.coefficients.toArray()), core.intercept


def _descend(x, y, alpha, ratio):
    """Coordinate descent on least squares / 2n + alpha (ratio |w| + (1 - ratio) w^2 / 2)."""
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize(
    "name, params, alpha, ratio",
    [
        ("linear_regression", {}, 0.0, 0.0),
        ("ridge_regression", {"alpha": 24.0}, 24.0 / 240, 0.0),
        ("lasso_regression", {"alpha": 0.2}, 0.2, 1.0),
        ("elasticnet_regression", {"alpha": 0.3, "l1_ratio": 0.4}, 0.3, 0.4),
        ("sgd_regressor", {"alpha": 0.05}, 0.05, 0.0),
        ("sgd_regressor", {"alpha": 0.05, "penalty": "elasticnet"}, 0.05, 0.15),
    ],
)
def test_linear_family(table, numbers, name, params, alpha, ratio):
    w, b = _coefficients(fit_model(table, name, "regression", X, "y", params))
    expected, intercept = _descend(numbers[0], numbers[1], alpha, ratio)
    assert w == pytest.approx(expected, abs=1e-5) and b == pytest.approx(intercept, abs=1e-5)


def test_logistic_is_at_its_optimum(table, numbers):
    x, _, g, _ = numbers
    w, b = _coefficients(fit_model(table, "logistic_regression", "classification", X, "g", {"C": 0.5}))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + 0.5 * x.T @ (p - g)).max() < 1e-2
    assert abs((p - g).sum()) < 1e-2


def test_bayes(table, numbers):
    x, _, _, h = numbers
    model = fit_model(table, "gaussian_nb_classifier", "classification", X, "h")
    joint = []
    for k in range(3):
        part = x[h == k]
        var = part.var(0) + 1e-9 * x.var(0).max()
        joint.append(np.log(len(part) / len(x)) - 0.5 * (np.log(2 * np.pi * var) + (x - part.mean(0)) ** 2 / var).sum(1))
    joint = np.array(joint).T
    out = model.transform(table).orderBy("k").collect()
    assert [r["prediction"] for r in out] == list(joint.argmax(1))
    p = np.exp(joint - joint.max(1, keepdims=True))
    assert np.array([r["probability"] for r in out]) == pytest.approx(p / p.sum(1, keepdims=True), abs=1e-9)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("blocks", [False, True])
def test_neighbours(table, numbers, monkeypatch, p, weights, blocks):
    x, y, g, _ = numbers
    if blocks:
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", 70)
        monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 50)
        monkeypatch.setattr(neighbours.nearest, "__defaults__", (2, 0))
    d = (np.abs(x[:, None] - x[None]) ** p).sum(2) ** (1 / p)
    order = d.argsort(1, kind="stable")[:, :4]
    params = {"n_neighbors": 4, "weights": weights, "p": p}
    if weights == "distance":  # every row meets itself at distance 0
        mean, vote = y, g
    else:
        mean, vote = y[order].mean(1), (g[order].sum(1) > 2).astype(int)
    for key in (["k"], []):
        model = fit_model(table, "knn_regressor", "regression", X, "y", params, key)
        got = [r["prediction"] for r in model.transform(table).orderBy("k").collect()]
        assert got == pytest.approx(list(mean))
    model = fit_model(table, "knn_classifier", "classification", X, "g", params, ["k"])
    assert [r["prediction"] for r in model.transform(table).orderBy("k").collect()] == list(vote)


def test_neighbours_with_a_point_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(neighbours.nearest, "__defaults__", (2, 0))
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 40)
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 10).alias("v"), (F.col("id") % 2).alias("y")
    )
    model = fit_model(df, "knn_regressor", "regression", ["v"], "y", {"n_neighbors": 3})
    out = model.transform(df)
    assert out.count() == 300
    pdf = df.toPandas()
    hot = pdf[pdf["v"] == 1.0]["y"]
    got = out.where("v = 1.0").select("prediction").distinct().collect()
    assert len(got) == 1 and 0 <= got[0][0] <= 1 and len(hot) == 101


CLASSIFIERS = {
    "random_forest_classifier": {"n_estimators": 8},
    "extra_trees_classifier": {"n_estimators": 8},
    "bagging_classifier": {"n_estimators": 5},
    "gradient_boosting_classifier": {"n_estimators": 5},
    "decision_tree_classifier": {"criterion": "log_loss", "min_samples_split": 4.0},
    "adaboost_classifier": {"n_estimators": 12},
    "svm_classifier": {},
    "sgd_classifier": {"loss": "hinge", "max_iter": 10, "alpha": 0.01},
    "mlp_classifier": {"hidden_layer_sizes": "(6,)", "max_iter": 100, "random_state": 1},
    "xgb_rf_classifier": {"n_estimators": 8, "colsample_bynode": 0.7},
}


@pytest.mark.parametrize("name", CLASSIFIERS)
def test_classifiers(table, spark, tmp_path, name):
    floor = {"adaboost_classifier": 0.85, "gradient_boosting_classifier": 0.85}.get(name, 0.88)
    # labels need not start at 0
    df = table.withColumn("g", F.col("g") * 5 + 2)
    model = fit_model(df, name, "classification", X, "g", CLASSIFIERS[name])
    assert model.classes == [2, 7]
    scored = model.transform(df)
    assert scored.columns[: len(df.columns)] == df.columns
    assert scored.where("g = prediction").count() / 240 > floor
    first = scored.withColumn("m", class_probabilities(scored, model.classes)).first()
    if name in ("svm_classifier", "sgd_classifier"):
        assert first["m"] is None
    else:
        assert sum(first["m"].values()) == pytest.approx(1) and set(first["m"]) == {"2", "7"}
    model.save(f"{tmp_path}/m")
    again = FittedModel.load(spark, f"{tmp_path}/m").transform(df)
    assert again.select("k", "prediction").exceptAll(scored.select("k", "prediction")).count() == 0
    if name == "mlp_classifier":
        assert any("activation" in n for n in model.notes)
    if name == "decision_tree_classifier":
        assert any("min_samples_split" in n for n in model.notes)


@pytest.mark.parametrize("name", ["gradient_boosting_classifier", "sgd_classifier", "adaboost_classifier"])
def test_three_classes(table, name):
    params = {"loss": "hinge", "max_iter": 4} if name.startswith("sgd") else {"n_estimators": 4}
    model = fit_model(table, name, "classification", X, "h", params)
    assert model.transform(table).where("h = prediction").count() / 240 > 0.6


REGRESSORS = {
    "decision_tree_regressor": {"max_depth": 5},
    "random_forest_regressor": {"n_estimators": 8, "max_features": None},
    "extra_trees_regressor": {"n_estimators": 8, "max_features": None},
    "bagging_regressor": {"n_estimators": 4},
    "gradient_boosting_regressor": {"n_estimators": 20, "learning_rate": 0.3},
    "hist_gradient_boosting_regressor": {"max_iter": 20, "learning_rate": 0.3, "min_samples_leaf": 5},
    "adaboost_regressor": {"n_estimators": 10},
    "xgb_regressor": {"n_estimators": 10},
    "sgd_regressor": {"loss": "huber"},
}


@pytest.mark.parametrize("name", REGRESSORS)
def test_regressors(table, name):
    scored = fit_model(table, name, "regression", X, "y", REGRESSORS[name]).transform(table)
    got = {r["metric"]: r["value"] for r in evaluate(scored, "regression", "y", "prediction").collect()}
    assert got["r2"] > 0.8


@pytest.mark.parametrize(
    "name, task, label, params",
    [("sgd_regressor", "regression", "y", {"loss": "huber"}), ("svm_classifier", "classification", "g", {})],
)
def test_iterations_are_what_was_asked_for(table, name, task, label, params):
    for steps in (1, 450):
        model = fit_model(table, name, task, X, label, {**params, "max_iter": steps})
        stages = model.spark_model.stages
        core = stages[-1].models[0] if hasattr(stages[-1], "models") else stages[-1]
        assert core.getMaxIter() == steps


def test_tree_text():
    text = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= -1.5E-4)
   Predict: 0.0
  Else (feature 0 > -1.5E-4)
   If (feature 2 <= 3.0)
    Predict: 1.0
   Else (feature 2 > 3.0)
    Predict: 2.0
"""
    assert read_tree(text) == [0, -1.5e-4, 0.0, [2, 3.0, 1.0, 2.0]]
    assert read_tree("DecisionTree: depth=0\n  Predict: 1.0\n") == 1.0


def test_registry_checks():
    names = {m["model_name"] for m in registry.list_models()}
    assert len(names) == 30
    full = registry.check_params("logistic_regression", "classification", {"C": 2})
    assert full["max_iter"] == 100 and full["C"] == 2
    for name, task, params, error in [
        ("nope", "classification", {}, registry.UnsupportedModelError),
        ("mlp_regressor", "regression", {}, registry.UnsupportedModelError),
        ("linear_regression", "classification", {}, registry.InvalidTaskError),
        ("linear_regression", "nope", {}, registry.InvalidTaskError),
        ("logistic_regression", "classification", {"x": 1}, registry.InvalidParameterError),
        ("logistic_regression", "classification", {"C": None}, registry.InvalidParameterError),
        ("logistic_regression", "classification", {"penalty": "l3"}, registry.InvalidParameterError),
        ("logistic_regression", "classification", {"C": -1.0}, registry.InvalidParameterError),
        ("sgd_classifier", "classification", {"alpha": "x"}, registry.InvalidParameterError),
        ("gradient_boosting_classifier", "classification", {"subsample": 1.5}, registry.InvalidParameterError),
    ]:
        with pytest.raises(error):
            registry.check_params(name, task, params)
    assert registry.hidden_layers("(64, 32)") == [64, 32] and registry.hidden_layers([3]) == [3]


def test_no_silent_substitution(table):
    with pytest.raises(registry.InvalidParameterError, match="kernel"):
        fit_model(table, "svm_classifier", "classification", X, "g", {"kernel": "rbf"})
    with pytest.raises(registry.InvalidParameterError, match="loss"):
        fit_model(table, "sgd_classifier", "classification", X, "g", {"loss": "perceptron"})
    with pytest.raises(ValueError, match="Missing features"):
        fit_model(table, "linear_regression", "regression", X, "y").transform(table.drop("a"))
    with pytest.raises(ValueError, match="fewer than 2"):
        fit_model(table.where("g = 1"), "logistic_regression", "classification", X, "g")


def test_grid_search(table):
    found = grid_search(
        table, "decision_tree_classifier", "classification", X, {"max_depth": [1, 4], "criterion": ["gini"]}, "g",
        cv=3, n_jobs=2, key=["k"],
    )
    assert found.best_params == {"max_depth": 4, "criterion": "gini"}
    assert (found.summary["n_candidates"], found.summary["best_index"], found.summary["scoring"]) == (2, 1, "accuracy")
    assert found.summary["best_score"] == found.summary["mean_test_score"]
    assert found.model.params["max_depth"] == 4
    reg = grid_search(
        table, "ridge_regression", "regression", X, {"alpha": [1.0, 1.0]}, "y",
        cv=3, scoring="neg_mean_squared_error", key=["k"], refit=False,
    )
    assert reg.summary["best_index"] == 0 and reg.summary["best_score"] < 0 and reg.model is None
    for bad in ({"cv": 1}, {"scoring": "r2"}, {"grid": {}}, {"grid": {"max_depth": []}}, {"grid": {"nope": [1]}}):
        args = {"grid": {"max_depth": [1]}, **bad}
        grid = args.pop("grid")
        with pytest.raises((ValueError, registry.ModelError)):
            grid_search(table, "decision_tree_classifier", "classification", X, grid, "g", **args)
