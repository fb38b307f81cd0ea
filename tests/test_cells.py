"""Trees over counted cells, next to the same trees over all rows."""

import pytest
from pyspark.sql import functions as F

from tidemill.models import cells, fitting
from tidemill.models.fitting import FittedModel, fit_model

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def grid(spark):
    rows = spark.range(24_000).select("id", *[(F.col("id") % n).cast("int").alias(x) for x, n in zip(X, (2, 7, 5))])
    z = F.col("a") * 3 + F.col("b") * F.col("c") + F.col("b") * 0.71 + F.col("c") * 0.29 + F.col("id") % 3
    return rows.withColumns({"z": z.cast("double"), "y": ((z + F.col("b")).cast("int") % 9 > 3).cast("long")}).cache()


def both(monkeypatch, grid, name, task, label, params):
    """Predictions per cell by counted cells and by all rows, and how many cells were counted."""
    counted, count = [], cells.count_cells
    monkeypatch.setattr(cells, "count_cells", lambda *told: counted.append(count(*told)) or counted[-1])
    out = []
    for most in (20_000, 10**9):
        monkeypatch.setattr(cells, "CELLS", most)
        model = fit_model(grid, name, task, X, label, params)
        told = model.transform(grid.select(*X).distinct()).orderBy(*X).collect()
        out.append([[r["prediction"], *(r["probability"] if task == "classification" else [])] for r in told])
    return [c.count() for c in counted], *out


@pytest.mark.parametrize("name", ["bagging_classifier", "extra_trees_classifier", "bagging_regressor", "extra_trees_regressor"])
def test_cells_give_the_trees_of_all_rows(grid, monkeypatch, name):
    task, label = ("classification", "y") if name.endswith("classifier") else ("regression", "z")
    params = {"n_estimators": 2, "bootstrap": False, **({"max_depth": 5, "max_features": None} if "extra" in name else {})}
    counted, short, whole = both(monkeypatch, grid, name, task, label, params)
    assert counted and max(counted) <= 140
    assert short == [pytest.approx(w, abs=1e-9) for w in whole]


def test_fewer_cells_than_intervals(grid, monkeypatch):
    monkeypatch.setattr(cells, "CELLS", 20_000)
    params = {"n_estimators": 1, "bootstrap": False, "max_depth": 2, "max_features": None}
    model = fit_model(grid, "extra_trees_regressor", "regression", ["a"], "z", params)
    told = {r["a"]: r["prediction"] for r in model.transform(grid.select("a").distinct()).collect()}
    assert told == pytest.approx({r["a"]: r["m"] for r in grid.groupBy("a").agg(F.mean("z").alias("m")).collect()})


@pytest.mark.parametrize("name", ["bagging_classifier", "extra_trees_classifier", "bagging_regressor", "extra_trees_regressor"])
def test_drawn_cells_are_near_drawn_rows(grid, monkeypatch, name):
    task, label = ("classification", "y") if name.endswith("classifier") else ("regression", "z")
    params = {"n_estimators": 4, **({"max_depth": 6, "max_features": None} if "extra" in name else {"max_samples": 0.8})}
    counted, short, whole = both(monkeypatch, grid, name, task, label, params)
    assert counted and max(counted) <= 140
    assert short != whole  # other draws
    misses = [abs(s[-1] - w[-1]) for s, w in zip(short, whole)]
    assert sum(misses) / len(misses) < (0.05 if task == "classification" else 0.6)


def test_rows_are_drawn_as_often_as_they_should(spark):
    u = spark.range(200_000).select(F.rand(5).alias("u"))
    for share, replace, variance in ((1.0, True, 1.0), (0.4, True, 0.4), (0.4, False, 0.24), (1.0, False, 0.0)):
        w = u.select(cells.times_drawn(share, replace, F.col("u")).alias("w"))
        row = w.agg(F.mean("w").alias("m"), F.variance("w").alias("v")).first()
        assert row["m"] == pytest.approx(share, abs=0.01) and row["v"] == pytest.approx(variance, abs=0.02)


def test_many_cells_missing_values_and_more_trees_take_all_rows(grid, monkeypatch):
    monkeypatch.setattr(cells, "CELLS", 20_000)
    facts = fitting.Facts(24_000, 0, 1, 0.0)
    params = fitting.check_params("bagging_regressor", "regression", {"n_estimators": 2})
    forest = fitting.ESTIMATORS["bagging_regressor"](params, facts)
    rows = grid.select(*[F.col(x).cast("double").alias(x) for x in [*X, "id"]], F.col("z").alias("_y"))
    assert cells.fit_bags(rows.withColumn("a", F.expr("nullif(a, 1)")), ["a"], forest, facts) is None
    assert cells.fit_bags(rows, ["a"], forest.copy({forest.numTrees: 17}), facts) is None
    monkeypatch.setattr(cells, "CELLS", 60)
    assert cells.fit_bags(rows, X, forest, facts) is None


def test_many_values_are_cut_evenly_and_saved_models_score_alike(spark, grid, monkeypatch, tmp_path):
    monkeypatch.setattr(cells, "CELLS", 20_000)
    splits = cells.cut_evenly(grid, ["id", "b"])
    assert len(splits[0]) == 65 and splits[1][1:-1] == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    model = fit_model(grid, "bagging_regressor", "regression", ["id", "b"], "z", {"n_estimators": 2})
    assert len(model.spark_model.stages) == 4
    model.save(str(tmp_path / "m"))
    again = FittedModel.load(spark, str(tmp_path / "m"))
    assert again.transform(grid).exceptAll(model.transform(grid)).count() == 0
