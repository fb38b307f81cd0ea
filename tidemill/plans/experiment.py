"""From a table to a fitted, evaluated and recorded model, driven by one mapping."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.models.fitting import FittedModel, fit_model
from tidemill.models.registry import check_grid, check_params
from tidemill.models.tuning import SCORERS, grid_search
from tidemill.operators.metrics import confusion, evaluate, roc_auc, roc_auc_weighted
from tidemill.operators.rows import stride_sample
from tidemill.operators.splits import split
from tidemill.plans.chain import FittedChain, audit_once, check_operations, fit_chain
from tidemill.plans.prepare import PreparePlan, fit_prepare
from tidemill.session import spread_small

# The keys of a specification, their defaults, and the size limits.
DEFAULTS: dict[str, Any] = {
    "dataset": None,
    "target": None,
    "task": "classification",
    "model_name": "logistic_regression",
    "params": {},
    "param_config": None,
    "operations": [],
    "test_size": 0.2,
    "validation_size": 0.1,
    "stratify": True,
    "random_state": 42,
    "drop": [],
    "key": None,
    "fit_on": "all",
    "run_name": None,
}
SIZE_LIMITS = {"test_size": (0.05, 0.5), "validation_size": (0.0, 0.5)}
GRID_DEFAULTS = {"cv": 5, "scoring": None, "refit": True, "n_jobs": None}


def check_spec(spec: Mapping[str, Any]) -> dict[str, Any]:
    """The specification with defaults; every fault raises before a job starts. A
    validation size of None or 0 means a two-way split."""
    if not isinstance(spec, Mapping):
        raise ValueError("the specification must be an object.")
    unknown = sorted(set(spec) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"Unknown keys: {unknown}. Allowed: {sorted(DEFAULTS)}")
    full = {**DEFAULTS, **spec}
    if not full["target"]:
        raise ValueError("target is required.")
    if full["fit_on"] not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'.")
    full["operations"] = check_operations(full["operations"])
    for name, (low, high) in SIZE_LIMITS.items():
        value = full[name]
        if value is None and name == "validation_size":
            continue
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{name}={value!r} is no number")
        if not low <= value <= high:
            raise ValueError(f"{name}={value} lies outside {low} to {high}")
    full["validation_size"] = full["validation_size"] or None
    if full["params"] is None or not isinstance(full["params"], Mapping):
        raise ValueError("params maps names to values")
    check_params(full["model_name"], full["task"], full["params"])
    if full["param_config"] is not None:
        config = {**GRID_DEFAULTS, **full["param_config"]}
        extra = sorted(set(config) - set(GRID_DEFAULTS) - {"grid"})
        if extra:
            raise ValueError(f"Unknown param_config keys: {extra}")
        check_grid(full["model_name"], full["task"], config.get("grid") or {})
        if config["cv"] < 2:
            raise ValueError("cv must be >= 2.")
        if config["scoring"] is not None and SCORERS.get(config["scoring"], ("",))[0] != full["task"]:
            raise ValueError(f"Unknown scoring {config['scoring']!r}.")
        if not config["refit"]:
            raise ValueError("refit=False leaves no model to evaluate; grid_search takes it")
        full["param_config"] = config
    return full


@dataclass
class Scorer:
    """Operations, preparation and model as fitted; scores raw tables and streams."""

    chain: FittedChain
    prepare: PreparePlan
    model: FittedModel

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One prediction for every row: filters, samples and the like shaped the training
        table and are skipped, everything that changes values is repeated."""
        prepared = self.prepare.apply(self.chain.apply(df, select_rows=False), keep)
        scored = self.model.transform(prepared)
        extra = [c for c in ("label", "prediction", "probability") if c in scored.columns]
        return scored.select(*[col(k) for k in keep], *extra)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        line = json.dumps({"chain": self.chain.to_json(), "prepare": self.prepare.to_json()})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/plans"
        )
        self.model.save(f"{path}/fitted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        plans = json.loads(spark.read.text(f"{path}/plans").first()["value"])
        return cls(
            FittedChain.from_json(plans["chain"]),
            PreparePlan.from_json(plans["prepare"]),
            FittedModel.load(spark, f"{path}/fitted"),
        )


@dataclass
class Experiment:
    spec: dict[str, Any]
    scorer: Scorer
    scored: DataFrame  # key columns, split, label, prediction, probability
    metrics: DataFrame  # split, metric, value
    steps: list[dict[str, Any]]
    best_params: dict[str, Any] | None
    cv_summary: dict[str, Any] | None
    train_time: float
    source: DataFrame
    rows: dict[str, int] = field(default_factory=dict)
    prepared: DataFrame | None = None  # cached; everything above reads it

    def close(self) -> None:
        """Frees the cached table."""
        if self.prepared is not None:
            self.prepared.unpersist()

    @property
    def audit(self) -> DataFrame:
        """Rows and columns after every operation; one pass over the table, when asked for."""
        return audit_once(self.source, self.scorer.chain)

    def confusion(self, part: str = "test") -> DataFrame:
        return confusion(self.scored.where(F.col("split") == part), "label", "prediction")

    def sample(self, part: str = "test", points: int = 300, key: Sequence[str] | None = None) -> DataFrame:
        """About ``points`` (actual, predicted) pairs at a regular stride."""
        rows = self.scored.where(F.col("split") == part)
        kept = [*(key or []), "label", "prediction"]
        return stride_sample(rows.select(*kept), points, key=key)


def run_experiment(df: DataFrame, spec: Mapping[str, Any]) -> Experiment:
    """Operations, preparation, split, fit or grid search, metrics of every part."""
    full = check_spec(spec)
    key, target, task = full["key"], full["target"], full["task"]
    chain, tables = fit_chain(df, full["operations"], key)
    table = tables[-1]
    stratify = bool(full["stratify"]) and task == "classification"
    sizes = (full["test_size"], full["validation_size"], full["random_state"])
    parted = split(table, target, *sizes, stratify, key)
    # only the prepared table is cached: it is read many times, and holds nothing else
    learned_on = parted if full["fit_on"] == "all" else parted.where(F.col("split") == "train")
    plan = fit_prepare(learned_on.drop("split"), target, task, key or (), full["drop"])
    ready = spread_small(plan.apply(parted, keep=[*(key or []), "split"])).persist()
    try:
        train = ready.where(F.col("split") == "train").drop("split")
        start = time.perf_counter()
        best, summary = None, None
        if full["param_config"] is None:
            model = fit_model(
                train, full["model_name"], task, plan.features, plan.label, full["params"], key or ()
            )
        else:
            config = full["param_config"]
            found = grid_search(
                train,
                full["model_name"],
                task,
                plan.features,
                config["grid"],
                plan.label,
                full["params"],
                config["cv"],
                config["scoring"],
                True,
                config["n_jobs"],
                full["random_state"],
                key,
            )
            model, best, summary = found.model, found.best_params, found.summary
        spent = time.perf_counter() - start
        kept = [*(key or []), "split", "label", "prediction"]
        scored = model.transform(ready)
        if "probability" in scored.columns:
            kept.append("probability")
        scored = scored.select(*kept)
        metrics = evaluate(scored, task, "label", "prediction", "split")
        if "probability" in kept:
            metrics = metrics.unionByName(_auc(scored, model.classes))
        counts = {r["split"]: r["count"] for r in ready.groupBy("split").count().collect()}
    except Exception:
        ready.unpersist()
        raise
    return Experiment(
        full,
        Scorer(chain, plan, model),
        scored,
        metrics,
        _steps(full, plan, counts),
        best,
        summary,
        spent,
        df,
        counts,
        ready,
    )


def _auc(scored: DataFrame, classes: Sequence[Any]) -> DataFrame:
    if len(classes) == 2:
        flat = scored.withColumn("_p", F.col("probability")[1])
        found = roc_auc(flat, "label", "_p", classes[1], "split")
    else:
        found = roc_auc_weighted(scored, "label", "probability", classes, "split")
    return found.where(F.col("roc_auc").isNotNull()).select(
        F.col("by").alias("split"), F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")
    )


def _steps(spec: Mapping[str, Any], plan: PreparePlan, counts: Mapping[str, int]) -> list[dict[str, Any]]:
    """What ran, in order."""
    steps = [{"operation": "load", "args": {"dataset": spec["dataset"]}}]
    for raw in spec["operations"]:
        steps.append(
            {"operation": raw["operation"], "args": {k: v for k, v in raw.items() if k != "operation"}}
        )
    steps += [
        {"operation": "prepare", "args": {"target": spec["target"], "n_features": len(plan.features)}},
        {"operation": "split", "args": dict(counts)},
        {"operation": "fit", "args": {"model_name": spec["model_name"], "task": spec["task"]}},
        {"operation": "evaluate", "args": {"parts": sorted(counts)}},
    ]
    return [{"step": i, **s} for i, s in enumerate(steps)]


def reevaluate(
    scorer: Scorer, df: DataFrame, spec: Mapping[str, Any], part: str = "test"
) -> tuple[DataFrame, DataFrame]:
    """Metrics and scored rows of one part, after rebuilding the recorded operations and
    split on ``df`` with the recorded settings."""
    full = check_spec(spec)
    stratify = bool(full["stratify"]) and full["task"] == "classification"
    table = scorer.chain.apply(df)
    parted = split(
        table,
        full["target"],
        full["test_size"],
        full["validation_size"],
        full["random_state"],
        stratify,
        full["key"],
    ).where(F.col("split") == part)
    keep = [*(full["key"] or []), "split"]
    scored = scorer.model.transform(scorer.prepare.apply(parted, keep))
    return evaluate(scored, full["task"], "label", "prediction", "split"), scored
