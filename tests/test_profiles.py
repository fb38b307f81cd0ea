import pytest
from conftest import values

from tidemill.operators import profile


def _by(df, name="column"):
    return {r[name]: r for r in df.collect()}


def test_info_and_missing(gaps):
    out = _by(profile.info(gaps))
    assert (out["a"]["non_null"], out["a"]["missing"], out["a"]["missing_pct"]) == (3, 2, 40.0)
    assert (out["c"]["unique"], out["c"]["dtype"]) == (3, "string")
    assert [r["column"] for r in profile.missing_values(gaps).collect()] == ["b", "a", "c"]
    assert _by(profile.info(gaps, approx=True))["c"]["unique"] == 3


def test_describe(gaps, sample):
    out = _by(profile.describe(sample))
    assert (out["age"]["mean"], out["age"]["q50"], out["age"]["min"]) == (35.0, 35.0, 25.0)
    assert out["age"]["std"] == pytest.approx(7.9057, abs=1e-4)
    assert (out["city"]["top"], out["city"]["freq"], out["city"]["unique"]) == ("Oslo", 2, 3)
    assert out["city"]["mean"] is None and out["age"]["top"] is None
    assert _by(profile.describe(gaps))["b"]["count"] == 2
    assert set(_by(profile.describe(gaps, "number"))) == {"a", "b"}
    assert set(_by(profile.describe(gaps, "other"))) == {"c"}
    with pytest.raises(ValueError, match="include"):
        profile.describe(gaps, "nope")


def test_column_stats(frame):
    df = frame("a double, b string, f boolean", [(1.0, "x", True), (2.0, "x", None), (None, "y", True)])
    out = _by(profile.column_stats(df))
    assert (out["a"]["mean"], out["a"]["missing"], out["a"]["unique"]) == (1.5, 1, 2)
    assert (out["b"]["top"], out["b"]["top_pct"]) == ("x", 66.67)
    assert (out["f"]["top"], out["f"]["mean"]) == ("true", None)
    one = _by(profile.column_stats(frame("a int, e string", [(4, None), (None, None)])))
    assert one["a"]["std"] == 0.0
    assert (one["e"]["unique"], one["e"]["top"], one["e"]["top_pct"]) == (0, None, None)


def test_counts(frame, sample):
    df = frame("a int, b int", [(1, 3), (1, 3), (2, 4)])
    assert profile.duplicates(df).first().asDict() == {"rows": 3, "duplicates": 1}
    c = frame("s string", [("x",), ("x",), (None,), ("a",)])
    assert [(r["value"], r["count"]) for r in profile.unique_values(c, "s").collect()] == [("x", 2), ("a", 1), (None, 1)]
    shares = [(r["value"], r["pct"]) for r in profile.class_distribution(c, "s").collect()]
    assert shares == [("x", 50.0), ("a", 25.0), (None, 25.0)]
    assert profile.top_classes(c, "nope") is None
    assert profile.top_classes(c.limit(0), "s") is None
    many = frame("k int", [(i,) for i in range(40)])
    assert profile.top_classes(many, "k").count() == 32
    with pytest.raises(KeyError):
        profile.unique_values(sample, "nope")


def test_target_and_preview(frame, sample):
    assert profile.guess_target(frame("y int, label int", [(1, 2)])) == "label"
    assert profile.guess_target(sample, "city") == "city"
    assert profile.guess_target(sample, "nope") is None
    report = profile.preview(sample, 2, "bought", ["age"], "people")
    assert (report["rows"], report["duplicates"], report["missing"]) == (5, 0, {})
    assert report["class_distribution"] == {"1": 60.0, "0": 40.0}
    assert [r["age"] for r in report["preview"]] == [25, 30]
    assert [s["column"] for s in report["columns_stats"]] == sample.columns


def test_content_hash(frame):
    rows = [(1, "a", None), (2, "b", 0.5)]
    a = frame("k int, s string, v double", rows)
    first = profile.content_hash(a).first()["hash"]
    assert first == profile.content_hash(frame("k int, s string, v double", rows[::-1])).first()["hash"]
    assert first == profile.summary(a)["hash"]
    assert first != profile.content_hash(frame("k int, s string, v double", [(1, "a", None), (2, "b", 0.6)])).first()["hash"]
    left = profile.content_hash(frame("s string, t string", [("a|1:b", "c")])).first()["checksum"]
    right = profile.content_hash(frame("s string, t string", [("a", "b|1:c")])).first()["checksum"]
    assert left != right


def test_summary(gaps):
    s = profile.summary(gaps)
    assert (s["rows"], s["columns"], s["missing"], s["missing_total"]) == (5, 3, {"a": 2, "b": 3, "c": 1}, 6)


def test_feature_profile(sample):
    out = _by(profile.feature_profile(sample, ["salary", "city"], ["age"]))
    assert (out["salary"]["sample"], out["salary"]["mean"], out["salary"]["max"]) == ("3000", 5000.0, 7000.0)
    assert (out["city"]["sample"], out["city"]["mean"]) == ("Oslo", None)


def test_distinct_values_limit(frame):
    df = frame("a int, s string", [(i, "x") for i in range(20)])
    assert profile.distinct_values(df, ["s"], 5) == {"s": ["x"]}
    with pytest.raises(ValueError, match="more than 5"):
        profile.distinct_values(df, ["a", "s"], 5)


def test_values_helper(sample):
    assert len(values(sample)) == 5
