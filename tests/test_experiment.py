import pytest
from pyspark.sql import functions as F

from tidemill.models.registry import ModelError
from tidemill.plans.experiment import Scorer, check_spec, reevaluate, run_experiment
from tidemill.plans.runs import RunStore
from tidemill.streaming.apply import score_stream, write_stream


@pytest.fixture(scope="module")
def people(spark):
    """Mixed columns with missing values and a text label that can be learned."""
    i = F.col("id")
    age = (i * 37 % 60 + 18).cast("double")
    fare = (i * 53 % 97).cast("double")
    return spark.range(600).select(
        i.alias("k"),
        F.when(i % 9 != 0, age).alias("age"),
        F.concat(F.lit("$"), fare.cast("int").cast("string")).alias("fare"),
        F.when(i % 7 != 0, F.element_at(F.array(F.lit("f"), F.lit("m")), (i % 2 + 1).cast("int"))).alias("sex"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd").alias("day"),
        F.when((i % 2 == 1) & (fare < 80) | (fare > 90), "yes").otherwise("no").alias("survived"),
    )


SPEC = {
    "dataset": "people",
    "target": "survived",
    "model_name": "logistic_regression",
    "params": {"max_iter": 50},
    "operations": [
        {"operation": "clean_numeric", "column": "fare"},
        {"operation": "fill_missing", "columns": "age", "strategy": "median"},
        {"operation": "create_date_features", "column": "day", "features": ["month", "is_weekend"]},
        {"operation": "clip_outliers", "columns": ["fare"]},
        {"operation": "drop_columns", "columns": "day"},
    ],
    "key": ["k"],
}


def test_run_score_log_and_reevaluate(people, spark, tmp_path):
    done = run_experiment(people, SPEC)
    got = {(r["split"], r["metric"]): r["value"] for r in done.metrics.collect()}
    assert got[("test", "accuracy")] > 0.7 and got[("train", "roc_auc")] > 0.7
    assert {s for s, _ in got} == {"train", "validation", "test"}
    assert done.rows == {"train": 419, "validation": 60, "test": 121}
    assert [s["operation"] for s in done.steps][:2] == ["load", "clean_numeric"]
    assert done.audit.count() == 5
    assert done.confusion().agg(F.sum("n")).first()[0] == 121
    assert done.sample(points=50, key=["k"]).count() == 61

    store = RunStore(spark, f"{tmp_path}/runs")
    run_id = store.log_experiment(done, "first")
    detail = store.detail(run_id)
    assert detail["metrics"]["test_accuracy"] == pytest.approx(got[("test", "accuracy")])
    assert detail["operations"] == SPEC["operations"] and detail["model_hyperparams"]["max_iter"] == "50"

    scorer = Scorer.load(spark, detail["path"])
    metrics, scored = reevaluate(scorer, people, SPEC)
    again = {r["metric"]: r["value"] for r in metrics.collect()}
    assert again["accuracy"] == pytest.approx(got[("test", "accuracy")]) and scored.count() == 121

    batch = scorer.transform(people.drop("survived"), ["k"])
    assert batch.columns == ["k", "prediction", "probability"] and batch.count() == 600
    with pytest.raises(ValueError, match="Missing features"):
        scorer.prepare.apply(people.drop("sex"))

    people.drop("survived").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(people.drop("survived").schema).parquet(f"{tmp_path}/in")
    query = write_stream(score_stream(stream, scorer, ["k"]), f"{tmp_path}/out", f"{tmp_path}/offsets")
    query.awaitTermination(120)
    streamed = spark.read.parquet(f"{tmp_path}/out")
    assert streamed.select("k", "prediction").exceptAll(batch.select("k", "prediction")).count() == 0
    assert streamed.count() == 600


def test_grid_two_way_and_regression(people):
    spec = {
        **SPEC,
        "target": "age",
        "task": "regression",
        "model_name": "ridge_regression",
        "params": {},
        "param_config": {"grid": {"alpha": [0.1, 10.0]}, "cv": 3},
        "validation_size": 0,
        "fit_on": "train",
    }
    done = run_experiment(people, spec)
    assert set(done.rows) == {"train", "test"}
    assert done.best_params["alpha"] in (0.1, 10.0) and done.cv_summary["n_candidates"] == 2
    assert done.metrics.where("metric = 'r2'").count() == 2


@pytest.mark.parametrize(
    "change",
    [
        {"nope": 1},
        {"target": None},
        {"model_name": "nope"},
        {"task": "regression"},
        {"params": {"nope": 1}},
        {"params": None},
        {"test_size": 0.01},
        {"test_size": "x"},
        {"validation_size": 0.6},
        {"operations": [{"operation": "nope"}]},
        {"param_config": {"grid": {}}},
        {"param_config": {"grid": {"C": [-1.0]}}},
        {"param_config": {"grid": {"C": [1.0]}, "cv": 1}},
        {"param_config": {"grid": {"C": [1.0]}, "scoring": "r2"}},
        {"fit_on": "nope"},
    ],
)
def test_spec_faults(change):
    with pytest.raises((ValueError, ModelError)):
        check_spec({**SPEC, **change})


def test_scoring_keeps_every_row(people):
    choosing = [
        {"operation": "filter_rows", "expression": "age > 30"},
        {"operation": "sample_rows", "n": 200},
        {"operation": "shuffle"},
    ]
    spec = {**SPEC, "model_name": "svm_classifier", "params": {}, "operations": SPEC["operations"] + choosing}
    done = run_experiment(people, spec)
    assert sum(done.rows.values()) == 200
    assert done.scorer.transform(people, ["k"]).count() == 600
    # no probabilities, so no area under the curve
    assert done.metrics.where("metric = 'roc_auc'").count() == 0
    done.close()


def test_explicit_null_is_kept():
    assert check_spec({**SPEC, "validation_size": None})["validation_size"] is None
    assert check_spec(SPEC)["validation_size"] == 0.1
