"""The audit of a chain in one pass."""

import pytest
from conftest import values
from pyspark.sql import DataFrameWriter

from tidemill.models.fitting import fit_model
from tidemill.plans import chain

STEPS = [
    {"operation": "filter_rows", "expression": "v > 2"},
    {"operation": "fill_missing", "columns": "w"},
    {"operation": "drop_duplicates", "subset": ["w"]},
    {"operation": "clip_outliers", "columns": "v"},
    {"operation": "sample_rows", "n": 5},
    {"operation": "drop_columns", "columns": "v"},
]


def test_six_steps_are_counted_by_one_scan(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id", "id % 7 AS v", "IF(id % 5 = 0, NULL, id % 50) AS w").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    fitted, tables = chain.fit_chain(df, STEPS, ["id"])
    plans, save = [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **k: (plans.append(self._df), save(self, *a, **k))[1])
    once = chain.audit_once(df, fitted)
    monkeypatch.undo()
    assert len(plans) == 1
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("CollectMetrics") == len(STEPS) + 1
    names = ["step", "operation", "rows", "cols", "row_change", "col_change"]
    assert values(once, *names) == values(chain.audit_tables(tables, STEPS), *names)


def test_an_empty_chain(spark):
    assert chain.audit_once(spark.range(3), chain.FittedChain([])).count() == 0


@pytest.mark.parametrize(
    "name, params",
    [
        ("extra_trees_classifier", {"n_estimators": 2, "max_depth": 2}), ("random_forest_classifier", {"n_estimators": 2, "max_depth": 2}),
        ("svm_classifier", {"max_iter": 5}), ("logistic_regression", {"max_iter": 5}), ("mlp_classifier", {"max_iter": 2}),
    ],
)
def test_models_score_in_a_session_that_has_observed(spark, name, params):
    chain.audit_once(spark.range(3), chain.FittedChain([]))
    for classes in (2, 3):
        df = spark.range(60).selectExpr("CAST(id % 7 AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS z", f"id % {classes} AS y")
        model = fit_model(df, name, "classification", ["x", "z"], "y", params)
        assert model.transform(df).where("prediction IS NOT NULL").count() == 60
