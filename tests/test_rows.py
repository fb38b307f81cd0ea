import pytest
from conftest import values
from pyspark.sql import functions as F

from tidemill.operators import rows


def test_drop_columns(sample):
    assert rows.drop_columns(sample, "city").columns == ["age", "salary", "bought"]
    assert rows.drop_columns(sample, ["age", "city"]).columns == ["salary", "bought"]
    with pytest.raises(KeyError, match="Columns not found"):
        rows.drop_columns(sample, "nope")


def test_rename_swaps(sample):
    out = rows.rename_columns(sample, {"age": "salary", "salary": "age"})
    assert out.columns == ["salary", "age", "city", "bought"]
    assert out.first()["salary"] == 25
    with pytest.raises(KeyError):
        rows.rename_columns(sample, {"nope": "x"})


def test_dotted_names(frame):
    df = frame("`a.b` int, `c d` string", [(1, "x"), (None, "y")])
    assert rows.drop_missing_rows(df).count() == 1
    assert rows.rename_columns(df, {"a.b": "z"}).columns == ["z", "c d"]
    assert rows.filter_rows(df, "`a.b` == 1").count() == 1


@pytest.mark.parametrize(
    "text, expected",
    [
        ("x > 3", [4]),
        ("x != 4", [1, 2, None]),
        ("not (x > 3)", [1, 2, None]),
        ("~(x > 3)", [1, 2, None]),
        ("x not in [1, 2]", [4, None]),
        ("x in (1, 2)", [1, 2]),
        ("x == [1, 4]", [1, 4]),
        ("x > 1 & s == 'b'", [2]),
        ("x > 1 | s == 'n'", [2, 4, None]),
        ("1 < x <= 4", [2, 4]),
        ("not (1 < x <= 4)", [1, None]),
        ("`x` * 2 + 1 == 5", [2]),
        ("x / 0 > 10", [1, 2, 4]),
        ("x % 2 == 0 and not s == 'd'", [2]),
        ("s == 1", []),
        ("s != 1", [1, 2, 4, None]),
        ("abs(-x) ** 2 > 3.5", [2, 4]),
        ("x // 2 == 1", [2]),
    ],
)
def test_filter(frame, text, expected):
    df = frame("x int, s string", [(1, "a"), (2, "b"), (4, "d"), (None, "n")])
    got = [r["x"] for r in rows.filter_rows(df, text).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("text", ["nope > 1", "x >", "x + 1", "s > 1", "__import__('os')", "x in s", "lambda: 1"])
def test_filter_faults(frame, text):
    with pytest.raises(ValueError, match="Invalid row filter"):
        rows.filter_rows(frame("x int, s string", [(1, "a")]), text)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 1.0).write.parquet(f"{tmp_path}/t")
    out = rows.filter_rows(spark.read.parquet(f"{tmp_path}/t"), "v > 5 and not (id < 7)").select("id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,5.0)" in plan and "GreaterThanOrEqual(id,7)" in plan


def test_drop_missing(gaps):
    assert rows.drop_missing_rows(gaps).count() == 0
    assert rows.drop_missing_rows(gaps, how="all").count() == 5
    assert rows.drop_missing_rows(gaps, ["a"]).count() == 3
    with pytest.raises(KeyError):
        rows.drop_missing_rows(gaps, ["nope"])


def test_drop_duplicates(frame):
    assert rows.drop_duplicates(frame("a int, b int", [(1, 3), (1, 3), (2, 4)])).count() == 2
    df = frame("a int, b int", [(1, 4), (1, 3), (2, 5), (None, 1), (None, 0)])
    assert values(rows.drop_duplicates(df, "a", ["b"])) == [(1, 3), (2, 5), (None, 0)]
    assert values(rows.drop_duplicates(df, "a")) == [(1, 3), (2, 5), (None, 0)]
    assert rows.drop_duplicates(df, ["a", "b"]).count() == 5


def test_drop_duplicates_keeps_missing_rest(frame):
    df = frame("a int, k int, b string", [(1, 1, None), (1, 2, "x")])
    assert values(rows.drop_duplicates(df, ["a"], ["k"])) == [(1, 1, None)]


def test_empty_columns(frame):
    df = frame("a int, b string, c double", [(1, None, None), (None, None, 2.0)])
    assert rows.drop_empty_columns(df).columns == ["a", "c"]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_shuffle_and_sample_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    order = [r["id"] for r in rows.shuffle(df.repartition(parts), 1, ["id"]).collect()]
    assert sorted(order) == list(range(1000)) and order != sorted(order)
    assert order == [r["id"] for r in rows.shuffle(df, 1, ["id"]).collect()]
    picked = {r["id"] for r in rows.sample_rows(df.repartition(parts), n=137, random_state=1, key=["id"]).collect()}
    assert picked == set(order[:137])
    strided = {r["id"] for r in rows.stride_sample(df.repartition(parts), 100, 1, ["id"]).collect()}
    assert strided == set(order[::10])


@pytest.mark.parametrize("frac, expected", [(0.5, 2), (0.0, 0), (1.0, 5), (0.3, 2)])
def test_sample_fraction_is_exact(sample, frac, expected):
    assert rows.sample_rows(sample, frac=frac).count() == expected


def test_sample_faults(sample):
    for bad in ({}, {"n": 1, "frac": 0.5}, {"n": 6}, {"n": -1}, {"frac": 1.5}):
        with pytest.raises(ValueError):
            rows.sample_rows(sample, **bad)
    twice = sample.unionByName(sample)
    with pytest.raises(ValueError, match="not unique"):
        for n in range(1, 10):
            rows.sample_rows(twice, n=n, key=["age"]).count()


def test_sample_of_one_row_repeated_often(spark):
    """A third of the rows are the same: copies are dealt out, none is lost."""
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    for n in (1, 500, 700, 1999):
        out = rows.sample_rows(df, n=n)
        assert out.count() == n
        assert out.where("v <> -1").distinct().count() == out.where("v <> -1").count()
    every = rows.stride_sample(df, points=100)
    assert every.count() == 100


def test_shuffle_without_key_spreads_copies(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    out = [r["v"] for r in rows.shuffle(df).collect()]
    assert sorted(out) == sorted(r["v"] for r in df.collect())
    assert out == [r["v"] for r in rows.shuffle(df.repartition(5)).collect()]
    places = [i for i, v in enumerate(out) if v == -1]
    assert max(b - a for a, b in zip(places, places[1:])) < 40


def test_head(sample):
    assert [r["age"] for r in rows.head(sample, 2, ["salary"]).collect()] == [25, 30]
    for n in (0, -1):
        with pytest.raises(ValueError):
            rows.head(sample, n)
    assert rows.shape(sample) == (5, 4)


def test_hash_order_with_deep_cells(spark, monkeypatch):
    """Forced through every refinement step, places are still exact."""
    from tidemill.functions import ranking

    monkeypatch.setattr(ranking, "LEAVES", 3)
    monkeypatch.setattr(ranking, "CELLS", 300)
    df = spark.range(3000)
    order = [r["id"] for r in rows.shuffle(df, 42, ["id"]).collect()]
    marks = ranking.HashOrder(df, ["id"], 42)
    got = {r["id"] for r in marks.at([0, 1, 17, 999, 2999]).collect()}
    assert got == {order[i] for i in (0, 1, 17, 999, 2999)}


def test_repeat_rows_in_chunks(frame, monkeypatch):
    from tidemill.functions import ranking

    monkeypatch.setattr(ranking, "COPIES_PER_ROW", 10)
    df = frame("a int, n bigint", [(1, 1), (2, 7), (3, 25), (4, 10), (5, 0)])
    out = ranking.repeat_rows(df, F.col("n"), "i").groupBy("a").agg(F.count("*").alias("c"), F.sum("i").alias("s"))
    assert values(out, "a", "c", "s") == [(1, 1, 1), (2, 7, 28), (3, 25, 325), (4, 10, 55)]


def test_separators_in_texts_do_not_collide(frame):
    texts = [("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("a\\", "|b"), ("a|", "\\b")]
    df = frame("x string, y string", texts)
    for n in range(7):
        assert rows.sample_rows(df, n=n).count() == min(n, len(texts))
        assert rows.sample_rows(df, n=n, key=["x", "y"]).count() == min(n, len(texts))


def test_not_a_number_is_missing_in_filters(frame):
    df = frame("v double", [(-4.0,), (16.0,), (4.0,), (None,)])
    assert values(rows.filter_rows(df, "sqrt(v) > 3")) == [(16.0,)]
    assert rows.filter_rows(df, "v ** 0.5 > 3").count() == 1


def test_head_has_no_upper_limit(spark):
    assert rows.head(spark.range(900).toDF("x"), 700, ["x"]).count() == 700
