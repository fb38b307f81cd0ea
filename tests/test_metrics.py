import numpy as np
import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemill.operators import metrics


def test_class_metrics(frame):
    df = frame("a int, p int", list(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1])))
    m = metrics.class_metrics(df, "a", "p").first()
    assert m["accuracy"] == pytest.approx(0.8)
    assert m["precision"] == pytest.approx(2 / 5 * 2 / 3 + 3 / 5 * 1)
    assert m["recall"] == pytest.approx(0.8)
    assert m["f1"] == pytest.approx(2 / 5 * 0.8 + 3 / 5 * 0.8)


def test_never_predicted_and_new_labels(frame):
    df = frame("a string, p string", [("x", "y"), ("x", "y"), ("z", "x")])
    m = metrics.class_metrics(df, "a", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0, 0, 0, 0)
    full = metrics.confusion(df, "a", "p")
    assert full.count() == 9
    assert {(r["actual"], r["predicted"]): r["n"] for r in full.collect()}[("x", "y")] == 2


def test_regression(frame):
    df = frame("a double, p double", list(zip([1.0, 2.0, 3.0, 4.0], [1.1, 2.2, 2.8, 4.1])))
    m = metrics.regression_metrics(df, "a", "p").first()
    assert (m["mse"], m["mae"]) == (pytest.approx(0.025), pytest.approx(0.15))
    assert m["rmse"] == pytest.approx(0.025**0.5) and m["r2"] == pytest.approx(1 - 0.1 / 5)
    same = metrics.regression_metrics(frame("a double, p double", [(2.0, 2.0), (2.0, 2.0)]), "a", "p").first()
    assert same["r2"] == 1.0
    off = metrics.regression_metrics(frame("a double, p double", [(2.0, 3.0), (2.0, 2.0)]), "a", "p").first()
    assert off["r2"] == 0.0


def _auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_auc_simple(frame):
    df = frame("y int, s double", list(zip([0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8])))
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == 1.0
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()["roc_auc"] is None


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(-20, 20)), min_size=2, max_size=80))
def test_auc_against_pairs(spark, rows):
    y = np.array([r[0] for r in rows])
    s = np.array([r[1] / 7 for r in rows])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = metrics.roc_auc(df, "y", "s").first()["roc_auc"]
    if y.min() == y.max():
        assert got is None
    else:
        assert got == pytest.approx(_auc(y, s))


def test_auc_hot_score_and_groups(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(
        (F.col("id") * 31 % 7 < 3).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") * 17 % 1009 / 1009).alias("s"),
        (F.col("id") % 2).cast("string").alias("g"),
    )
    pdf = df.toPandas()
    got = {r["by"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "s", 1, "g").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(_auc(part["y"].to_numpy(), part["s"].to_numpy()))


def test_evaluate(frame):
    df = frame("a int, p int, g string", [(0, 0, "train"), (1, 0, "test"), (1, 1, "test")])
    got = {(s, m): v for s, m, v in values(metrics.evaluate(df, "classification", "a", "p", "g"))}
    assert got[("train", "accuracy")] == 1.0 and got[("test", "accuracy")] == 0.5
    with pytest.raises(ValueError, match="Unknown task"):
        metrics.evaluate(df, "nope", "a", "p")
