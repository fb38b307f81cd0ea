"""Spark ML estimators for the registered models.

Spark's objectives are means over rows, so strengths that are given per table are divided
by the row count; ``Facts`` carries what that needs. ``notes`` collect every parameter
that Spark has no counterpart for.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.base import Estimator
from pyspark.sql import SparkSession

from tidemill.models.registry import InvalidParameterError, hidden_layers
from tidemill.session import shared_path

DEEPEST = 30
BINS = 64
SEED = 42


@dataclass
class Facts:
    rows: int
    classes: int
    features: int
    label_std: float
    notes: list[str] = field(default_factory=list)

    def ignore(self, params: dict[str, Any], defaults: dict[str, Any]) -> None:
        for name, neutral in defaults.items():
            if params.get(name) != neutral:
                self.notes.append(f"{name}={params.get(name)!r} has no counterpart and was ignored")


def _seed(p: dict[str, Any]) -> int:
    return SEED if p.get("random_state") is None else p["random_state"]


def _many(estimator: Estimator, facts: Facts) -> Estimator:
    return C.OneVsRest(classifier=estimator) if facts.classes > 2 else estimator


def alone(model, spark: SparkSession):
    """The model without its training summary, which holds on to the training rows and to
    the session, and cannot be sent to executors once the session observes metrics."""
    if isinstance(model, C.OneVsRestModel):
        model.models = [alone(part, spark) for part in model.models]
        return model
    if not getattr(model, "hasSummary", False):
        return model
    path = shared_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def _logistic(p, f: Facts):
    if p["penalty"] == "elasticnet":
        raise InvalidParameterError("penalty 'elasticnet' needs a mix that this model does not take")
    off = p["penalty"] == "none" or p["C"] == 0
    return C.LogisticRegression(
        standardization=False,
        regParam=0.0 if off else 1.0 / (p["C"] * f.rows),
        elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0,
        maxIter=p["max_iter"],
        tol=1e-8,
    )


def _penalised(alpha: float, ratio: float, f: Facts, iterations: int, intercept: bool = True):
    """Least squares / 2n + alpha * (ratio * |w| + (1 - ratio) / 2 * w^2).

    The label is scaled by its deviation inside the solver, which rescales the squared
    part of the penalty; the two strengths are set so that the objective is the above.
    """
    l1 = alpha * ratio
    l2 = f.label_std * alpha * (1 - ratio)
    strength = l1 + l2
    return R.LinearRegression(
        regParam=strength,
        elasticNetParam=l1 / strength if strength else 0.0,
        standardization=False,
        solver="l-bfgs",
        maxIter=iterations,
        tol=1e-12,
        fitIntercept=intercept,
    )


def _linear(p, f: Facts):
    return R.LinearRegression(regParam=0.0, fitIntercept=p["fit_intercept"], solver="auto")


def _ridge(p, f: Facts):
    return _penalised(p["alpha"] / f.rows, 0.0, f, 1000, p["fit_intercept"])


def _lasso(p, f: Facts):
    return _penalised(p["alpha"], 1.0, f, p["max_iter"], p["fit_intercept"])


def _elastic(p, f: Facts):
    return _penalised(p["alpha"], p["l1_ratio"], f, p["max_iter"], p["fit_intercept"])


def _depth(value: int | None, f: Facts) -> int:
    if value is None or value == 0:
        f.notes.append(f"max_depth={value!r}: trees grow to {DEEPEST} levels at most")
        return DEEPEST
    if value > DEEPEST:
        raise InvalidParameterError(f"max_depth={value} is beyond the {DEEPEST} levels that trees can have")
    return value


def _subset(value: str | None) -> str:
    return {"sqrt": "sqrt", "log2": "log2", None: "all"}[value]


def _tree(p, f: Facts):
    f.ignore(p, {"min_samples_split": 2.0})
    common = {
        "maxDepth": _depth(p["max_depth"], f),
        "minInstancesPerNode": p["min_samples_leaf"],
        "seed": _seed(p),
        "maxBins": BINS,
    }
    if not f.classes:
        f.ignore(p, {"criterion": "squared_error"})
    else:
        common["impurity"] = "gini" if p["criterion"] == "gini" else "entropy"
    if p["max_features"] is not None:  # a forest of one tree draws features at every node
        one = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": _subset(p["max_features"])}
        return (C.RandomForestClassifier if f.classes else R.RandomForestRegressor)(**common, **one)
    return (C.DecisionTreeClassifier if f.classes else R.DecisionTreeRegressor)(**common)


def _forest(p, f: Facts, **more):
    kind = C.RandomForestClassifier if f.classes else R.RandomForestRegressor
    settings = {"numTrees": p["n_estimators"], "seed": _seed(p), "maxBins": BINS, **more}
    return kind(**settings)


def _random_forest(p, f: Facts):
    f.ignore(p, {"min_samples_split": 2.0})
    return _forest(
        p,
        f,
        maxDepth=_depth(p["max_depth"], f),
        bootstrap=p["bootstrap"],
        featureSubsetStrategy=_subset(p["max_features"]),
    )


def extra_forest(p, f: Facts, trees: int, seed: int) -> Estimator:
    """Trees over cut points that were drawn beforehand, so there is nothing to search."""
    f.ignore(p, {"min_samples_split": 2.0})
    settings = {
        "numTrees": trees, "seed": seed, "maxBins": BINS, "maxDepth": _depth(p["max_depth"], f),
        "bootstrap": p["bootstrap"], "featureSubsetStrategy": _subset(p["max_features"]),
    }
    return (C.RandomForestClassifier if f.classes else R.RandomForestRegressor)(**settings)


def _bagging(p, f: Facts):
    f.ignore(p, {"max_features": 1.0, "n_jobs": None})
    return _forest(
        p,
        f,
        maxDepth=DEEPEST,
        bootstrap=p["bootstrap"],
        featureSubsetStrategy="all",
        subsamplingRate=max(p["max_samples"], 1e-6),
    )


def _boosted(f: Facts, rounds, rate, depth, share, seed, bins=BINS, leaf=1):
    kind = C.GBTClassifier if f.classes else R.GBTRegressor
    estimator = kind(
        maxIter=rounds,
        stepSize=max(rate, 1e-6),
        maxDepth=depth,
        subsamplingRate=max(share, 1e-6),
        seed=seed,
        maxBins=bins,
        minInstancesPerNode=leaf,
    )
    return _many(estimator, f) if f.classes else estimator


def _gradient_boosting(p, f: Facts):
    return _boosted(f, p["n_estimators"], p["learning_rate"], _depth(p["max_depth"], f), p["subsample"], _seed(p))


def _hist_boosting(p, f: Facts):
    f.ignore(p, {"l2_regularization": 0.0})
    depth = math.ceil(math.log2(p["max_leaf_nodes"]))
    if p["max_depth"] is not None:
        depth = min(depth, p["max_depth"])
    return _boosted(
        f, p["max_iter"], p["learning_rate"], min(depth, DEEPEST), 1.0, _seed(p), 255, p["min_samples_leaf"]
    )


def _xgb(p, f: Facts):
    f.notes.append("fitted by Spark's own boosted trees")
    f.ignore(p, {"reg_lambda": 0.0, "reg_alpha": 0.0, "colsample_bytree": 1.0})
    return _boosted(
        f, p["n_estimators"], p["learning_rate"], _depth(p["max_depth"], f), p["subsample"], _seed(p), 255
    )


def _xgb_forest(p, f: Facts):
    f.notes.append("fitted by Spark's own forest")
    f.ignore(p, {"reg_lambda": 0.0, "learning_rate": 1.0})
    share = p["colsample_bynode"]
    return _forest(
        p,
        f,
        maxDepth=_depth(p["max_depth"], f),
        subsamplingRate=max(p["subsample"], 1e-6),
        featureSubsetStrategy="all" if share >= 1 else str(max(share, 1e-6)),
    )


def _linear_svm(strength: float, iterations: int, f: Facts):
    return _many(C.LinearSVC(regParam=strength, maxIter=iterations, standardization=False, tol=1e-4), f)


def _svm(p, f: Facts):
    if p["kernel"] != "linear":
        raise InvalidParameterError(f"kernel {p['kernel']!r} has no distributed solver; use 'linear'")
    f.ignore(p, {"probability": False})
    return _linear_svm(1.0 / (max(p["C"], 1e-12) * f.rows), p["max_iter"], f)


# Fixed value: share of the absolute penalty in the mixed one.
_ELASTIC_SHARE = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.15}


def _sgd_classifier(p, f: Facts):
    f.notes.append("the loss is minimised exactly; step sizes do not apply")
    if p["loss"] == "log_loss":
        return C.LogisticRegression(
            standardization=False,
            regParam=p["alpha"],
            elasticNetParam=_ELASTIC_SHARE[p["penalty"]],
            maxIter=p["max_iter"],
            tol=1e-8,
        )
    if p["loss"] == "hinge" and p["penalty"] == "l2":
        return _linear_svm(p["alpha"], p["max_iter"], f)
    raise InvalidParameterError(f"loss {p['loss']!r} with penalty {p['penalty']!r} has no distributed solver")


def _sgd_regressor(p, f: Facts):
    f.notes.append("the loss is minimised exactly; step sizes do not apply")
    if p["loss"] == "squared_error":
        return _penalised(p["alpha"], _ELASTIC_SHARE[p["penalty"]], f, p["max_iter"])
    if p["loss"] == "huber" and p["penalty"] == "l2":
        return R.LinearRegression(loss="huber", regParam=p["alpha"], standardization=False, maxIter=p["max_iter"])
    raise InvalidParameterError(f"loss {p['loss']!r} with penalty {p['penalty']!r} has no distributed solver")


def _mlp(p, f: Facts):
    if p["activation"] != "logistic":
        f.notes.append(f"activation {p['activation']!r} was replaced by 'logistic'")
    f.ignore(p, {"alpha": 0.0})
    if p["solver"] != "lbfgs":
        f.notes.append(f"solver {p['solver']!r} was replaced by 'lbfgs', which takes no learning_rate_init")
    layers = [f.features, *hidden_layers(p["hidden_layer_sizes"]), max(f.classes, 2)]
    return C.MultilayerPerceptronClassifier(layers=layers, maxIter=p["max_iter"], seed=_seed(p))


ESTIMATORS: dict[str, Callable[[dict[str, Any], Facts], Estimator]] = {
    "logistic_regression": _logistic,
    "linear_regression": _linear,
    "ridge_regression": _ridge,
    "lasso_regression": _lasso,
    "elasticnet_regression": _elastic,
    "decision_tree_classifier": _tree,
    "decision_tree_regressor": _tree,
    "random_forest_classifier": _random_forest,
    "random_forest_regressor": _random_forest,
    "bagging_classifier": _bagging,
    "bagging_regressor": _bagging,
    "gradient_boosting_classifier": _gradient_boosting,
    "gradient_boosting_regressor": _gradient_boosting,
    "hist_gradient_boosting_classifier": _hist_boosting,
    "hist_gradient_boosting_regressor": _hist_boosting,
    "xgb_classifier": _xgb,
    "xgb_regressor": _xgb,
    "xgb_rf_classifier": _xgb_forest,
    "xgb_rf_regressor": _xgb_forest,
    "svm_classifier": _svm,
    "sgd_classifier": _sgd_classifier,
    "sgd_regressor": _sgd_regressor,
    "mlp_classifier": _mlp,
}
NEEDS_LABEL_STD = {"ridge_regression", "lasso_regression", "elasticnet_regression", "sgd_regressor"}
