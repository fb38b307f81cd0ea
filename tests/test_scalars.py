from datetime import datetime

import pytest
from conftest import values

from tidemill.operators import scalars


def _texts(frame, *texts):
    return frame("k int, s string", list(enumerate(texts)))


def test_numeric_text(frame):
    texts = ["1", " 2 ", "1e3", ".5", "5.", "+3", "inf", "1d", "1f", "1_0", "1,000", "0x1", "True", "", None, "-Infinity", "1\t"]
    out = scalars.convert_dtype(_texts(frame, *texts), "s", "numeric").orderBy("k").collect()
    inf = float("inf")
    expected = [1.0, 2.0, 1000.0, 0.5, 5.0, 3.0, inf] + [None] * 8 + [-inf, 1.0]
    assert [r["s"] for r in out] == expected


def test_int_and_float(frame):
    df = frame("x double", [(1.9,), (-1.9,)])
    assert values(scalars.convert_dtype(df, "x", "int")) == [(-1,), (1,)]
    assert values(scalars.convert_dtype(_texts(frame, " 7", "8"), "s", "int"), "s") == [(7,), (8,)]
    for bad in (_texts(frame, "1.5"), _texts(frame, "1", None), _texts(frame, "x")):
        with pytest.raises(ValueError, match="cannot be converted"):
            scalars.convert_dtype(bad, "s", "int")
    assert values(scalars.convert_dtype(_texts(frame, "1.5", None), "s", "float"), "s") == [(1.5,), (None,)]
    with pytest.raises(ValueError):
        scalars.convert_dtype(_texts(frame, "x"), "s", "float")


def test_bool(frame):
    out = scalars.convert_dtype(_texts(frame, "False", "", None), "s", "bool").orderBy("k").collect()
    assert [r["s"] for r in out] == [True, False, True]
    assert values(scalars.convert_dtype(frame("x int", [(0,), (2,), (None,)]), "x", "bool")) == [(False,), (True,), (True,)]


def test_string_category_and_unknown(sample):
    assert dict(scalars.convert_dtype(sample, "age", "string").dtypes)["age"] == "string"
    out = scalars.convert_dtype(sample, "city", "category")
    assert out.schema["city"].metadata["ml_attr"]["vals"] == ["Bern", "Oslo", "Rome"]
    with pytest.raises(ValueError, match="Unsupported dtype"):
        scalars.convert_dtype(sample, "age", "complex")
    with pytest.raises(KeyError):
        scalars.convert_dtype(sample, "nope", "int")


def test_dates(frame):
    df = _texts(frame, "2024-01-01", "2024-06-15 10:20:30", "2024-13-01", "junk", "12:30:00", None)
    out = [r["s"] for r in scalars.parse_dates(df, "s").orderBy("k").collect()]
    assert out == [datetime(2024, 1, 1), datetime(2024, 6, 15, 10, 20, 30), None, None, None, None]
    mixed = _texts(frame, "31/12/2024", "2024.05.06")
    got = scalars.parse_dates(mixed, "s", ["dd/MM/yyyy", "yyyy.MM.dd"]).orderBy("k").collect()
    assert [r["s"] for r in got] == [datetime(2024, 12, 31), datetime(2024, 5, 6)]


@pytest.mark.parametrize(
    "text, feature, expected",
    [
        ("2024-03-15", "day_of_year", 75),
        ("2024-03-15", "quarter", 1),
        ("2024-03-18", "day_of_week", 0),
        ("2024-03-16", "is_weekend", 1),
        ("2024-03-01", "is_month_start", 1),
        ("2024-02-29", "is_month_end", 1),
        ("2024-03-15 14:30:00", "hour", 14),
        ("2024-12-30", "week_of_year", 1),
        ("junk", "is_weekend", 0),
        ("junk", "year", None),
    ],
)
def test_date_features(frame, text, feature, expected):
    out = scalars.create_date_features(_texts(frame, text), "s", [feature])
    assert out.first()[f"s_{feature}"] == expected


def test_unknown_date_feature(frame):
    with pytest.raises(ValueError, match="Unsupported date feature"):
        scalars.create_date_features(_texts(frame, "2024-01-01"), "s", ["era"])


def test_currency_and_percent(frame):
    df = _texts(frame, "$1,000", "€100", "£ 5", "n/a", None, "\t$7 ")
    out = scalars.clean_numeric(df, "s").orderBy("k").collect()
    assert [r["s"] for r in out] == [1000.0, 100.0, 5.0, None, None, 7.0]
    rates = scalars.clean_numeric(_texts(frame, "50%", "75.5%", "1,0%"), "s", percent=True).orderBy("k").collect()
    assert [r["s"] for r in rates] == [0.5, 0.755, None]
    assert scalars.clean_numeric(_texts(frame, "kr5"), "s", currency_symbols="kr").first()["s"] == 5.0


def test_maths(frame):
    df = frame("x int", [(0,), (1,), (4,), (None,)])
    assert values(scalars.transform_numeric(df, "x", "sqrt")) == [(0.0,), (1.0,), (2.0,), (None,)]
    assert values(scalars.transform_numeric(df, "x", "square")) == [(0,), (1,), (16,), (None,)]
    neg = frame("x double", [(-1.0,), (3.0,)])
    assert values(scalars.transform_numeric(neg, "x", "absolute")) == [(1.0,), (3.0,)]
    assert values(scalars.transform_numeric(neg, "x", "log1p"))[0][0] == float("-inf")
    with pytest.raises(ValueError, match="log1p"):
        scalars.transform_numeric(frame("x int", [(-2,)]), "x", "log1p")
    with pytest.raises(ValueError, match="sqrt"):
        scalars.transform_numeric(frame("x int", [(-1,)]), "x", "sqrt")
    with pytest.raises(ValueError, match="Unsupported transformation"):
        scalars.transform_numeric(df, "x", "cube")
    with pytest.raises(TypeError, match="numeric"):
        scalars.transform_numeric(_texts(frame, "a"), "s", "sqrt")
