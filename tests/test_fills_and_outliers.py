import math

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions.order_stats import exact_quantiles
from tidemill.operators import missing, outliers


def test_fills(gaps):
    assert values(missing.fill_missing(gaps, "a", "mean"), "a") == [(1.0,), (3.0,), (3.0,), (3.0,), (5.0,)]
    assert values(missing.fill_missing(gaps, ["a", "b"]), "b") == [(2.0,), (3.0,), (3.0,), (3.0,), (4.0,)]
    assert values(missing.fill_missing(gaps, "c", "most_frequent"), "c").count(("x",)) == 3
    assert values(missing.fill_missing(gaps, "c", "constant"), "c").count(("missing",)) == 1
    assert values(missing.fill_missing(gaps, "a", "constant", 0), "a").count((0.0,)) == 2


def test_fill_faults(gaps):
    for strategy in ("mean", "median"):
        with pytest.raises(TypeError, match="numeric columns"):
            missing.fill_missing(gaps, "c", strategy)
    with pytest.raises(TypeError):
        missing.fill_missing(gaps, "a", "constant", "text")
    with pytest.raises(ValueError, match="strategy"):
        missing.fill_missing(gaps, "a", "nope")
    with pytest.raises(KeyError):
        missing.fill_missing(gaps, "nope")


def test_mode_ties_and_empty(frame):
    df = frame("s string, n int, e string", [("b", 10, None), ("a", 9, None), (None, None, None)])
    out = missing.fill_missing(df, ["s", "n", "e"], "most_frequent")
    assert values(out, "s", "n").count(("a", 9)) == 2
    assert out.where("e is not null").count() == 0


def test_types_after_fill(frame):
    df = frame("i int, j int, b boolean", [(1, 1, True), (2, 2, None), (None, 4, True)])
    out = missing.auto_fill(df)
    assert dict(out.dtypes) == {"i": "double", "j": "int", "b": "boolean"}
    assert values(out, "i", "b") == [(1.0, True), (1.5, True), (2.0, True)]
    assert dict(missing.auto_fill(frame("e string", [(None,), (None,)])).dtypes) == {"e": "string"}
    assert values(missing.auto_fill(frame("e string", [(None,)]))) == [("missing",)]


def _linear(values_, q):
    ordered = sorted(values_)
    place = q * (len(ordered) - 1)
    low = math.floor(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (place - low) * (ordered[high] - ordered[low])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(st.one_of(st.none(), st.integers(-50, 50).map(lambda v: v / 4)), min_size=1, max_size=60),
    probs=st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]), min_size=1, max_size=4),
)
def test_quantiles_by_refinement(spark, data, probs):
    """Forced through the bracket rounds, the result is the plain interpolated quantile."""
    df = spark.createDataFrame([(v,) for v in data], "v double")
    got = exact_quantiles(df, {"v": probs}, in_one_task=0, on_driver=2)["v"]
    present = [v for v in data if v is not None]
    if not present:
        assert got == [None] * len(probs)
    else:
        assert got == pytest.approx([_linear(present, p) for p in probs])


def test_quantiles_with_a_hot_value(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 10007) / 10.0).alias("v")
    )
    probs = [0.01, 0.25, 0.3, 0.5, 0.75, 0.999]
    small = exact_quantiles(df, {"v": probs})["v"]
    large = exact_quantiles(df, {"v": probs}, in_one_task=10, on_driver=20)["v"]
    assert small == pytest.approx(large)


def test_bounds(frame):
    df = frame("x int", [(1,), (2,), (3,), (4,), (5,), (100,)])
    assert outliers.outlier_bounds(df, "x")["x"] == pytest.approx((-1.5, 8.5))
    assert values(outliers.detect_outliers(df, "x"), "x").count((True,)) == 1
    assert outliers.remove_outliers(df, "x").count() == 5
    assert outliers.clip_outliers(df, "x").agg(F.max("x")).first()[0] == 8.5
    flags = outliers.detect_outliers(df, "x", "zscore", 2, key=["x"])
    assert flags.columns == ["x", "x"]
    assert outliers.remove_outliers(df, "x", "zscore", 2).count() == 5


def test_constant_and_missing(frame):
    same = frame("x int", [(5,), (5,), (5,)])
    assert outliers.outlier_bounds(same, "x", "zscore")["x"] == (-math.inf, math.inf)
    assert dict(outliers.clip_outliers(same, "x", "zscore").dtypes) == {"x": "int"}
    df = frame("x double", [(1.0,), (2.0,), (None,), (3.0,), (99.0,)])
    assert outliers.remove_outliers(df, "x").where("x is null").count() == 1
    assert outliers.clip_outliers(df, "x").where("x is null").count() == 1
    empty = frame("x double", [(None,)])
    assert outliers.remove_outliers(empty, "x").count() == 1


def test_outlier_faults(sample):
    with pytest.raises(TypeError, match="numeric"):
        outliers.clip_outliers(sample, "city")
    with pytest.raises(ValueError, match="iqr"):
        outliers.remove_outliers(sample, "age", "nope")
