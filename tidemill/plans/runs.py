"""Run history: append-only tables of runs, parameters and metrics, and reports on them."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from typing import Any
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_id string, event string, name string, status string, start_time double, "
    "end_time double, path string, event_time double"
)
PARAM_SCHEMA = "run_id string, key string, value string"
METRIC_SCHEMA = "run_id string, key string, value double, step bigint, ts double"

# Metrics where a smaller number is better, and the prefixes of a part.
LOWER_IS_BETTER = ["mse", "rmse", "mae", "train_time", "eval_time"]
PART_PREFIXES = ["val_", "test_", "cv_"]
TIE = 1e-12
SPLIT_KEYS = ["test_size", "validation_size", "stratify", "random_state", "task", "model_name"]
DATASET_KEYS = ["dataset", "target", "n_operations"]


class RunStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        if rows:
            frame = self.spark.createDataFrame(rows, schema).coalesce(1)
            frame.write.mode("append").parquet(f"{self.root}/{table}")

    def log(
        self,
        params: Mapping[str, Any],
        metrics: Mapping[str, float],
        name: str | None = None,
        start_time: float | None = None,
        path: str | None = None,
    ) -> str:
        run_id = uuid4().hex
        end = time.time()
        self._append("params", [(run_id, k, _text(v)) for k, v in params.items()], PARAM_SCHEMA)
        self.log_metrics(run_id, metrics)
        row = (run_id, "finish", name, "FINISHED", start_time or end, end, path, end)
        self._append("runs", [row], RUN_SCHEMA)
        return run_id

    def log_metrics(self, run_id: str, metrics: Mapping[str, float], step: int = 0) -> None:
        now = time.time()
        rows = [(run_id, k, float(v), step, now) for k, v in metrics.items() if v is not None]
        self._append("metrics", rows, METRIC_SCHEMA)

    def log_experiment(self, experiment, name: str | None = None) -> str:
        """Parameters, metrics of every part (train without prefix) and the scorer."""
        spec, model = experiment.spec, experiment.scorer.model
        names = {"train": "", "validation": "val_", "test": "test_"}
        metrics = {f"{names[r['split']]}{r['metric']}": r["value"] for r in experiment.metrics.collect()}
        metrics["train_time"] = experiment.train_time
        for k, v in (experiment.cv_summary or {}).items():
            if isinstance(v, (int, float)):
                metrics[f"cv_{k}"] = v
        params = {k: spec[k] for k in (*SPLIT_KEYS, "dataset", "target")}
        params["n_operations"] = len(spec["operations"])
        params["operations"] = spec["operations"]
        params["steps"] = experiment.steps
        params["spec"] = spec
        params.update({f"estimator__{k}": v for k, v in model.params.items()})
        if experiment.best_params is not None:
            params["best_params"] = experiment.best_params
            params["grid_cv"] = spec["param_config"]["cv"]
            params["grid_scoring"] = experiment.cv_summary["scoring"]
        path = f"{self.root}/models/{uuid4().hex}"
        experiment.scorer.save(path)
        return self.log(params, metrics, name or spec["run_name"], path=path)

    def state(self) -> DataFrame:
        """One row per run as it is now, deleted ones included."""
        return current_state(self._read("runs", RUN_SCHEMA))

    def list(self, limit: int = 50) -> DataFrame:
        active = self.state().where("not deleted")
        return active.orderBy(F.desc("start_time"), "run_id").limit(limit)

    def count(self) -> int:
        return self.state().where("not deleted").count()

    def _mark(self, run_id: str, event: str, name: str | None = None) -> None:
        if self.state().where(F.col("run_id") == run_id).isEmpty():
            raise FileNotFoundError(f"Run not found: {run_id}")
        row = (run_id, event, name, None, None, None, None, time.time())
        self._append("runs", [row], RUN_SCHEMA)

    def rename(self, run_id: str, name: str) -> None:
        self._mark(run_id, "rename", name)

    def delete(self, run_id: str) -> None:
        self._mark(run_id, "delete")

    def restore(self, run_id: str) -> None:
        self._mark(run_id, "restore")

    def metric_rows(self) -> DataFrame:
        return self._read("metrics", METRIC_SCHEMA)

    def detail(self, run_id: str) -> dict[str, Any]:
        """Everything about one run, parameters grouped by what they describe."""
        run = self.state().where(F.col("run_id") == run_id).first()
        if run is None:
            raise FileNotFoundError(f"Run not found: {run_id}")
        params = {
            r["key"]: r["value"]
            for r in self._read("params", PARAM_SCHEMA).where(F.col("run_id") == run_id).collect()
        }
        history = metric_history(self.metric_rows().where(F.col("run_id") == run_id)).collect()
        hyper = {k.removeprefix("estimator__"): v for k, v in params.items() if k.startswith("estimator__")}
        grid = None
        if "best_params" in params:
            grid = {
                "cv": params.get("grid_cv"),
                "scoring": params.get("grid_scoring"),
                "best_params": json.loads(params["best_params"]),
            }
        return {
            **run.asDict(),
            "duration_ms": int((run["end_time"] - run["start_time"]) * 1000),
            "params": params,
            "metrics": {r["key"]: r["last"] for r in history},
            "metric_history": {r["key"]: r.asDict() for r in history},
            "split_config": {k: params.get(k) for k in SPLIT_KEYS},
            "dataset_info": {k: params.get(k) for k in DATASET_KEYS},
            "model_hyperparams": hyper,
            "grid_config": grid,
            "operations": json.loads(params.get("operations", "[]")),
            "steps": json.loads(params.get("steps", "[]")),
        }

    def params_wide(self) -> DataFrame:
        """``run_id, params`` with all parameters of a run in one map."""
        return params_by_run(self._read("params", PARAM_SCHEMA))


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, default=str)


def params_by_run(rows: DataFrame) -> DataFrame:
    """One map per run; a run has as many entries as it has parameters."""
    entries = F.collect_list(F.struct("key", "value"))
    return rows.groupBy("run_id").agg(F.map_from_entries(entries).alias("params"))


def current_state(events: DataFrame) -> DataFrame:
    """The state of each run from its events: last name given, last of delete/restore."""
    at = F.col("event_time")
    switch = F.col("event").isin("delete", "restore")
    return events.groupBy("run_id").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), at)).alias("name"),
        F.max("status").alias("status"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max("path").alias("path"),
        F.coalesce(F.max_by(F.col("event") == "delete", F.when(switch, at)), F.lit(False)).alias("deleted"),
    )


def run_list(rows: DataFrame, limit: int = 50) -> DataFrame:
    """``run_id, start_time, end_time, metrics``: newest start first, from a metric log."""
    runs = rows.groupBy("run_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("metrics")
    )
    return runs.orderBy(F.desc("start_time"), "run_id").limit(limit)


def metric_history(rows: DataFrame) -> DataFrame:
    """``run_id, key, last, low, high, points``; non-finite values are left out."""
    finite = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.groupBy("run_id", "key").agg(
        F.max_by("value", F.struct("step", "ts")).alias("last"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("*").alias("points"),
    )


def metric_series(rows: DataFrame, run_id: Any, key: str) -> DataFrame:
    one = rows.where((F.col("run_id") == run_id) & (F.col("key") == key))
    return one.select("step", "ts", "value").orderBy("step", "ts")


def lower_is_better(key: Column) -> Column:
    bare = F.regexp_replace(key, "^(" + "|".join(PART_PREFIXES) + ")", "")
    return bare.isin(LOWER_IS_BETTER)


def compare_runs(rows: DataFrame, runs: Sequence[Any] | None = None) -> DataFrame:
    """``key, run_id, value, best``: the last value of every metric and run; ``best``
    marks the best one of a metric, and any other within the tie width."""
    if runs is not None:
        rows = rows.where(F.col("run_id").isin(list(runs)))
    last = metric_history(rows).select("key", "run_id", F.col("last").alias("value"))
    extremes = last.groupBy("key").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    target = F.when(lower_is_better(F.col("key")), F.col("lo")).otherwise(F.col("hi"))
    near = F.abs(F.col("value") - target) < TIE
    return last.join(extremes, "key").select("key", "run_id", "value", near.alias("best"))


def compare_table(rows: DataFrame, runs: Sequence[Any]) -> DataFrame:
    """One row per metric and one column per chosen run."""
    compared = compare_runs(rows, runs)
    return compared.groupBy("key").pivot("run_id", list(runs)).agg(F.first("value"))
