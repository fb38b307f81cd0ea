import pytest
from conftest import values
from pyspark.sql import functions as F

from tidemill.plans.chain import (
    OPERATIONS,
    FittedChain,
    apply_operations,
    audit,
    check_operations,
    fit_chain,
    preview_chain,
)
from tidemill.streaming.apply import clean_stream, write_stream

CHAIN = [
    {"operation": "filter_rows", "expression": "a != 1"},
    {"operation": "fill_missing", "columns": ["a"], "strategy": "mean"},
    {"operation": "clip_outliers", "columns": "a"},
    {"operation": "drop_columns", "columns": "b"},
]


def test_names():
    assert len(OPERATIONS) == 15


def test_apply_and_audit(gaps):
    out = apply_operations(gaps, CHAIN)
    assert values(out, "a") == [(3.0,), (4.0,), (4.0,), (5.0,)]
    steps = audit(gaps, CHAIN).orderBy("step").collect()
    assert [(r["rows"], r["cols"], r["row_change"], r["col_change"]) for r in steps] == [
        (4, 3, -1, 0),
        (4, 3, 0, 0),
        (4, 3, 0, 0),
        (4, 2, 0, -1),
    ]


@pytest.mark.parametrize(
    "bad",
    [
        "text",
        ["drop_columns"],
        [{"operation": "nope"}],
        [{"columns": "a"}],
        [{"operation": "drop_columns"}],
        [{"operation": "drop_columns", "columns": "a", "extra": 1}],
    ],
)
def test_faults_before_any_job(bad):
    with pytest.raises(ValueError):
        check_operations(bad)


def test_a_fault_in_the_last_entry_stops_the_first(gaps):
    with pytest.raises(ValueError, match="unknown operation"):
        apply_operations(gaps, [{"operation": "drop_columns", "columns": "nope"}, {"operation": "x"}])


def test_every_operation_runs(frame):
    df = frame(
        "k int, n double, s string, d string, m string",
        [(i, float(i % 5), "ab"[i % 2], "2024-01-0%d" % (i % 9 + 1), "$%d" % i) for i in range(20)],
    )
    operations = [
        {"operation": "drop_duplicates", "subset": ["k"]},
        {"operation": "drop_missing_rows", "columns": ["n"]},
        {"operation": "convert_dtype", "column": "s", "dtype": "category"},
        {"operation": "parse_dates", "columns": "d"},
        {"operation": "clean_numeric", "column": "m"},
        {"operation": "shuffle", "random_state": 3},
        {"operation": "sample_rows", "n": 10},
        {"operation": "remove_outliers", "columns": "m", "method": "zscore", "threshold": 3},
        {"operation": "create_date_features", "column": "d", "features": ["month"]},
        {"operation": "transform_numeric", "columns": "n", "transformation": "sqrt"},
        {"operation": "rename_columns", "mapping": {"n": "root"}},
    ]
    out = apply_operations(df, operations, ["k"])
    assert out.columns == ["k", "root", "s", "d", "m", "d_month"] and out.count() == 10


def test_fitted_chain_keeps_its_values(gaps, frame):
    fitted, _ = fit_chain(gaps, CHAIN)
    again = FittedChain.from_json(fitted.to_json())
    fresh = frame("a double, b double, c string", [(None, 1.0, "x"), (1000.0, 1.0, "x")])
    assert values(again.apply(fresh), "a") == [(4.0,), (5.0,)]


def test_stream(gaps, spark, tmp_path):
    fitted, _ = fit_chain(gaps, CHAIN)
    gaps.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(gaps.schema).parquet(f"{tmp_path}/in")
    query = write_stream(clean_stream(stream, fitted), f"{tmp_path}/out", f"{tmp_path}/offsets")
    query.awaitTermination(120)
    assert values(spark.read.parquet(f"{tmp_path}/out"), "a") == [(3.0,), (4.0,), (4.0,), (5.0,)]
    whole, _ = fit_chain(gaps, [{"operation": "shuffle"}])
    with pytest.raises(ValueError, match="whole table"):
        clean_stream(stream, whole)
    with pytest.raises(ValueError, match="not a streaming"):
        clean_stream(gaps, fitted)


def test_preview(sample):
    report = preview_chain(sample, [{"operation": "filter_rows", "expression": "age > 30"}], 2, key=["age"])
    assert (report["before_shape"], report["after_shape"]) == ((5, 4), (3, 4))
    assert len(report["preview"]) == 2 and report["operations"][0]["operation"] == "filter_rows"


def test_one_plan_without_python(spark, tmp_path):
    """The applied chain is a single stage over the scan, with pruned columns."""
    path = f"{tmp_path}/t"
    base = spark.range(500).select(
        "id", (F.col("id") % 50).cast("double").alias("v"), F.lit("x").alias("unused")
    )
    base.write.parquet(path)
    operations = [
        {"operation": "filter_rows", "expression": "v > 3"},
        {"operation": "fill_missing", "columns": "v"},
        {"operation": "clip_outliers", "columns": "v"},
        {"operation": "transform_numeric", "columns": "v", "transformation": "log1p"},
    ]
    out = apply_operations(spark.read.parquet(path), operations).select("id", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "GreaterThan(v,3.0)" in plan and "unused" not in plan


def test_audit_reads_its_input_once_per_step(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    steps = [{"operation": "filter_rows", "expression": "v > 2"}, {"operation": "drop_columns", "columns": "v"}]
    report = audit(df, steps)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(steps) + 1
    assert [r["row_change"] for r in report.orderBy("step").collect()][0] < 0
