"""Categories, classes and scores beyond what a plan or one task should hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.models.fitting import fit_model
from tidemill.operators import codes, features, metrics
from tidemill.plans.prepare import fit_prepare, label_codes
from tidemill.plans.sparse import SparsePlan


def test_numbers_follow_the_order_over_many_ranges(spark):
    values = random.Random(3).sample(range(10**6), 5_000)
    df = spark.createDataFrame([(v, "x") for v in values], "v bigint, _part string").repartition(7)
    got = {r["v"]: r["code"] for r in codes.number_in_order(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert codes.number_in_order(df.limit(0), ["v"]).count() == 0


def test_codes_without_a_limit(spark, monkeypatch):
    n = 60_000
    df = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id") % 55_000).alias("s"))
    table = codes.fit_codes(df, "s", "first", ["id"])
    assert table.rows == 55_000
    for limit in (0, 10**6):  # joined by a shuffle, joined by a broadcast
        monkeypatch.setattr(codes, "BROADCAST_ROWS", limit)
        coded = table.encode(df, F.col("s"), "code")
        assert coded.columns == ["id", "s", "code"]
        assert coded.where(F.col("code") != F.col("id") % 55_000).count() == 0 and coded.count() == n
        told = "strategy=broadcast" in coded._jdf.queryExecution().analyzed().toString()
        assert told == (limit > 0)  # without it, Spark decides by its own bound
    odd = spark.createDataFrame([(None,), ("v0",), ("unseen",)], "s string")
    assert [r["c"] for r in table.encode(odd, F.col("s"), "c").orderBy(F.asc_nulls_first("s")).collect()] == [None, None, 0]
    assert label_codes(df, "s", ["id"]).count() == 55_000


@pytest.fixture
def shop(frame):
    rows = [(1, 2.0, "b", True, "no"), (2, None, "a", False, "yes"), (3, 0.0, "c", None, "no"), (4, 5.0, "b", True, "yes")]
    return frame("id int, x double, s string, t boolean, y string", rows)


def test_sparse_features_are_the_dense_ones(spark, shop):
    dense = fit_prepare(shop, "y", key=["id"])
    sparse = fit_prepare(shop, "y", key=["id"], sparse=True)
    assert sparse.size == len(dense.features)
    sparse = SparsePlan.from_json(sparse.to_json())
    fresh = spark.createDataFrame([(9, None, "new", False, "no"), (10, 1.0, None, True, "?")], shop.schema)
    for rows in (shop, fresh):
        want = {r["id"]: ([float(r[f]) for f in dense.features], r["label"]) for r in dense.apply(rows, ["id"]).collect()}
        struct = sparse.apply(rows, ["id"])
        assert struct.columns == ["id", "features", "label"]
        for r in struct.collect():
            full = [0.0] * r["features"]["size"]
            for i, v in zip(r["features"]["indices"], r["features"]["values"]):
                full[i] = v
            assert (full, r["label"]) == want[r["id"]]
        vectors = sparse.vectors(rows, ["id"])
        assert {r["id"]: (list(r["features"]), r["label"]) for r in vectors.collect()} == want
    assert "label" not in sparse.apply(shop.drop("y"), ["id"]).columns
    with pytest.raises(ValueError, match="Missing features"):
        sparse.apply(shop.drop("x"))


def test_sparse_transformer(shop):
    for encoding in ("one_hot", "ordinal"):
        dense = features.fit_transformer(shop, ["x"], ["s", "t"], categorical_encoding=encoding)
        sparse = features.fit_transformer(shop, ["x"], ["s", "t"], categorical_encoding=encoding, sparse=True)
        want = {r["id"]: [float(v) for v in list(r)[1:]] for r in dense.apply(shop, ["id"]).collect()}
        got = {r["id"]: list(r["features"]) for r in sparse.vectors(shop, ["id"]).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_a_model_learns_from_more_categories_than_columns_allow(spark):
    n, kinds = 40_000, 12_000
    df = spark.range(n).select(
        "id", F.concat(F.lit("k"), F.col("id") % kinds).alias("s"), (F.col("id") % 2).cast("double").alias("x"),
        F.when(F.col("id") % kinds % 2 == 0, "even").otherwise("odd").alias("y"),
    )
    with pytest.raises(ValueError, match="different values"):
        fit_prepare(df, "y", key=["id"])
    plan = fit_prepare(df, "y", key=["id"], sparse=True)
    ready = plan.vectors(df, ["id"])
    model = fit_model(ready, "logistic_regression", "classification", plan.features, params={"max_iter": 20})
    scored = model.transform(ready)
    assert scored.where("prediction = label").count() > 0.99 * n


def brute_auc(pos, neg):
    pos, neg = np.array(pos), np.array(neg)
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(y), float(np.round(s + y * 0.3, 3)), g) for y, s, g in zip(rng.integers(0, 2, 4_000), rng.normal(size=4_000), "ab" * 2_000)]
    rows += [(1, 0.5, "b")] * 3_000 + [(0, None, "a")]
    df = spark.createDataFrame(rows, "y int, s double, g string")
    whole = {r["by"]: r["roc_auc"] for r in metrics.roc_auc(df, "y", "s", 1, "g").collect()}
    monkeypatch.setattr(metrics, "CUT_SCORES", 150)
    cut = metrics.roc_auc(df, "y", "s", 1, "g")
    assert {r["by"]: r["roc_auc"] for r in cut.collect()} == pytest.approx(whole)
    for g in "ab":
        mine = [r for r in rows if r[2] == g and r[1] is not None]
        assert whole[g] == pytest.approx(brute_auc([r[1] for r in mine if r[0]], [r[1] for r in mine if not r[0]]))


def test_no_range_of_scores_is_much_larger_than_the_bound(spark, monkeypatch):
    """The plan's windows run over ranges that were cut to the bound."""
    seen = []
    monkeypatch.setattr(metrics, "CUT_SCORES", 500)
    real = metrics.written
    monkeypatch.setattr(metrics, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    df = spark.range(20_000).select((F.col("id") % 2).alias("y"), F.sqrt("id").alias("s"))
    metrics.roc_auc(df, "y", "s").collect()
    sizes = [r["count"] for r in seen[0].groupBy("by", "cut").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 20 and max(sizes) < 2_000
