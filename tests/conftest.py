import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture
def frame(spark):
    """``frame("a bigint, b string", [(1, "x")])``"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture
def sample(frame):
    rows = [
        (25, 3000, "Oslo", 0),
        (30, 4000, "Rome", 1),
        (35, 5000, "Oslo", 0),
        (40, 6000, "Bern", 1),
        (45, 7000, "Rome", 1),
    ]
    return frame("age int, salary int, city string, bought int", rows)


@pytest.fixture
def gaps(frame):
    rows = [(1.0, None, "x"), (None, 2.0, "y"), (3.0, None, "x"), (None, 4.0, "z"), (5.0, None, None)]
    return frame("a double, b double, c string", rows)


def values(df, *columns):
    columns = columns or df.columns
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=repr)
