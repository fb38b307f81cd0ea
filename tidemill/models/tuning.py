"""Grid search with exact, repeatable folds."""

from __future__ import annotations

import statistics
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.models.fitting import FittedModel, fit_model
from tidemill.models.registry import check_grid, check_params
from tidemill.operators.metrics import class_metrics, regression_metrics
from tidemill.operators.splits import assign_folds
from tidemill.session import spread_small

# Scorer name -> task, metric, sign (the best score is the largest one).
SCORERS = {
    "accuracy": ("classification", "accuracy", 1),
    "f1_weighted": ("classification", "f1", 1),
    "precision_weighted": ("classification", "precision", 1),
    "recall_weighted": ("classification", "recall", 1),
    "r2": ("regression", "r2", 1),
    "neg_mean_squared_error": ("regression", "mse", -1),
    "neg_root_mean_squared_error": ("regression", "rmse", -1),
    "neg_mean_absolute_error": ("regression", "mae", -1),
}
DEFAULT_SCORER = {"classification": "accuracy", "regression": "r2"}


@dataclass
class GridResult:
    best_params: dict[str, Any]
    summary: dict[str, Any]
    candidates: list[dict[str, Any]]  # params, mean_score, std_score, mean_fit_time
    model: FittedModel | None


def grid_search(
    df: DataFrame,
    name: str,
    task: str,
    features: Sequence[str],
    grid: Mapping[str, list],
    label: str = "label",
    params: Mapping[str, Any] | None = None,
    cv: int = 5,
    scoring: str | None = None,
    refit: bool = True,
    n_jobs: int | None = None,
    random_state: int = 42,
    key: Sequence[str] | None = None,
) -> GridResult:
    """Mean score over ``cv`` folds for every combination; the first of equal ones wins."""
    check_grid(name, task, grid)
    check_params(name, task, params)
    if cv < 2:
        raise ValueError("cv must be >= 2.")
    scorer = scoring or DEFAULT_SCORER[task]
    if scorer not in SCORERS or SCORERS[scorer][0] != task:
        raise ValueError(f"Unknown scoring {scorer!r} for {task}. Available: {sorted(SCORERS)}")
    wanted = [*features, label, *[k for k in key or [] if k not in {*features, label}]]
    folded = assign_folds(
        df.select(*[col(c) for c in wanted]), label, cv, task == "classification", random_state, key, "_fold"
    )
    rows = spread_small(folded).persist()
    combinations = [dict(zip(grid, values)) for values in product(*grid.values())]

    def one(job: tuple[int, int]) -> tuple[int, float, float]:
        place, fold = job
        start = time.perf_counter()
        model = fit_model(
            rows.where(F.col("_fold") != fold),
            name,
            task,
            features,
            label,
            {**(params or {}), **combinations[place]},
            key or (),
        )
        spent = time.perf_counter() - start
        scored = model.transform(rows.where(F.col("_fold") == fold))
        return place, _score(scored, scorer, label), spent

    jobs = [(place, fold) for place in range(len(combinations)) for fold in range(cv)]
    try:
        # -1: as many fits at a time as there are cores, -2: one fewer, and so on
        cores = df.sparkSession.sparkContext.defaultParallelism
        wide = n_jobs if (n_jobs or 1) > 0 else cores + 1 + n_jobs
        with ThreadPoolExecutor(max_workers=max(wide or 1, 1)) as pool:
            results = list(pool.map(one, jobs))
    finally:
        rows.unpersist()
    candidates = []
    for place, combination in enumerate(combinations):
        scores = [s for p, s, _ in results if p == place]
        candidates.append(
            {
                "params": combination,
                "mean_score": statistics.fmean(scores),
                "std_score": statistics.pstdev(scores),
                "mean_fit_time": statistics.fmean(t for p, _, t in results if p == place),
            }
        )
    best = max(range(len(candidates)), key=lambda i: candidates[i]["mean_score"])
    chosen = candidates[best]
    summary = {
        "best_score": chosen["mean_score"],
        "best_index": best,
        "scoring": scorer,
        "cv": cv,
        "mean_test_score": max(c["mean_score"] for c in candidates),
        "std_test_score": chosen["std_score"],
        "mean_fit_time": statistics.fmean(c["mean_fit_time"] for c in candidates),
        "n_candidates": len(candidates),
    }
    model = None
    if refit:
        model = fit_model(df, name, task, features, label, {**(params or {}), **chosen["params"]}, key or ())
    return GridResult(chosen["params"], summary, candidates, model)


def _score(scored: DataFrame, scorer: str, label: str) -> float:
    task, metric, sign = SCORERS[scorer]
    wide = (class_metrics if task == "classification" else regression_metrics)(scored, label, "prediction")
    return sign * wide.first()[metric]
