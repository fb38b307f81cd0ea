"""The same small tables through pandas, the usual single-machine tool."""

import numpy as np
import pandas as pd
import pytest

from tidemill.operators import features, missing, outliers, profile, rows, scalars

N = 60


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    x = rng.integers(-5, 30, N).astype(float)
    x[::7] = np.nan
    return pd.DataFrame(
        {
            "k": np.arange(N),
            "x": x,
            "y": rng.normal(10, 4, N).round(3),
            "s": [None if i % 9 == 0 else "abcd"[i * 7 % 4] for i in range(N)],
            "t": pd.date_range("2023-12-20", periods=N, freq="31h"),
        }
    )


@pytest.fixture(scope="module")
def df(spark, pdf):
    schema = "k bigint, x double, y double, s string, t timestamp"
    data = [
        (int(r.k), None if np.isnan(r.x) else float(r.x), float(r.y), r.s, r.t.to_pydatetime())
        for r in pdf.itertuples()
    ]
    return spark.createDataFrame(data, schema).cache()


@pytest.mark.parametrize(
    "text",
    [
        "x > 3",
        "x != 4",
        "not (x >= 3)",
        "~(x < 3 | y > 10)",
        "x > 3 & y < 12 | s == 'a'",
        "s in ['a', 'b'] and x not in [1, 2, 3]",
        "not (s not in ['a', 'c'])",
        "s != 'a'",
        "-3 < x <= 10 < y",
        "not (-3 < x <= 10)",
        "x * 2 - y / 3 > 4",
        "x / (k - 10) > 0.5",
        "x % 7 == 3 or x // 4 == 2",
        "(x + 1) ** 2 < 50",
        "`y` >= 10 and not s == 'b' and not x > 5",
        "t > '2024-01-10 00:00:00'",
        "k == [1, 2, 59]",
    ],
)
def test_filters(df, pdf, text):
    got = sorted(r["k"] for r in rows.filter_rows(df, text).collect())
    assert got == pdf.query(text)["k"].tolist()


def test_numbers_from_text(spark):
    texts = ["1", " 2", "3 ", "+4", "-5.", ".6", "7e2", "8E-1", "9d", "1f", "1_0", "1,0", "0x1", "inf", "-Infinity",
             "True", "", " ", "e5", ".", "1e", "--1", "1 2", "١", "1\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = [r["s"] for r in scalars.convert_dtype(frame, "s", "numeric").orderBy("k").collect()]
    expected = [pd.to_numeric(pd.Series([t]), errors="coerce")[0] for t in texts]
    for text, mine, theirs in zip(texts, got, expected):
        assert (mine is None and pd.isna(theirs)) or mine == theirs, text


def test_profiles(df, pdf):
    info = {r["column"]: r for r in profile.info(df).collect()}
    stats = {r["column"]: r for r in profile.column_stats(df).collect()}
    table = {r["column"]: r for r in profile.describe(df).collect()}
    for c in pdf.columns:
        assert info[c]["unique"] == pdf[c].nunique() and info[c]["missing"] == pdf[c].isna().sum()
        assert info[c]["missing_pct"] == pytest.approx(pdf[c].isna().mean() * 100, abs=0.0051)
    for c in ("k", "x", "y"):
        assert stats[c]["mean"] == pytest.approx(pdf[c].mean()) and stats[c]["std"] == pytest.approx(pdf[c].std())
        d = pdf[c].describe()
        for mine, theirs in (("count", "count"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert table[c][mine] == pytest.approx(d[theirs])
    assert table["s"]["freq"] == pdf["s"].value_counts().iloc[0]


def test_rows(df, pdf):
    got = sorted(r["k"] for r in rows.drop_duplicates(df, ["s", "x"], ["k"]).collect())
    assert got == pdf.drop_duplicates(["s", "x"])["k"].tolist()
    for how in ("any", "all"):
        got = sorted(r["k"] for r in rows.drop_missing_rows(df, ["x", "s"], how).collect())
        assert got == pdf.dropna(subset=["x", "s"], how=how)["k"].tolist()


@pytest.mark.parametrize("method, threshold", [("iqr", 0.5), ("zscore", 1.0)])
def test_outliers(df, pdf, method, threshold):
    x = pdf["x"]
    if method == "iqr":
        reach = threshold * (x.quantile(0.75) - x.quantile(0.25))
        low, high = x.quantile(0.25) - reach, x.quantile(0.75) + reach
    else:
        low, high = x.mean() - threshold * x.std(), x.mean() + threshold * x.std()
    got = [r["x"] for r in outliers.clip_outliers(df, "x", method, threshold).orderBy("k").collect()]
    assert np.array(got, dtype=float) == pytest.approx(x.clip(low, high).to_numpy(), nan_ok=True)
    kept = sorted(r["k"] for r in outliers.remove_outliers(df, "x", method, threshold).collect())
    assert kept == pdf[~((x < low) | (x > high))]["k"].tolist()


def test_dates(df, pdf):
    names = ["year", "month", "day", "day_of_week", "day_of_year", "quarter", "hour", "is_month_start", "is_month_end",
             "is_weekend", "week_of_year"]
    out = scalars.create_date_features(df, "t", names).orderBy("k").toPandas()
    dt = pdf["t"].dt
    expected = {
        "year": dt.year, "month": dt.month, "day": dt.day, "day_of_week": dt.dayofweek, "day_of_year": dt.dayofyear,
        "quarter": dt.quarter, "hour": dt.hour, "is_month_start": dt.is_month_start, "is_month_end": dt.is_month_end,
        "is_weekend": dt.dayofweek >= 5, "week_of_year": dt.isocalendar().week,
    }
    for n in names:
        assert out[f"t_{n}"].tolist() == expected[n].astype(int).tolist(), n


@pytest.mark.parametrize("strategy", ["mean", "median", "most_frequent"])
def test_fills(df, pdf, strategy):
    value = {"mean": pdf["x"].mean(), "median": pdf["x"].median(), "most_frequent": pdf["x"].mode().iloc[0]}[strategy]
    got = [r["x"] for r in missing.fill_missing(df, "x", strategy).orderBy("k").collect()]
    assert got == pytest.approx(pdf["x"].fillna(value).tolist())


def test_dummies(df, pdf):
    got = features.dummies(df.select("k", "s"), ["s"]).orderBy("k").toPandas().drop(columns="k")
    expected = pd.get_dummies(pdf[["s"]], columns=["s"], drop_first=True).astype(int)
    assert list(got.columns) == list(expected.columns)
    assert (got.to_numpy() == expected.to_numpy()).all()
