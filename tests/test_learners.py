"""Hashed neighbours, drawn cut points, feature subsets and long boosting."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import session
from tidemill.catalog import REGISTERED, models
from tidemill.catalog.base import LINEITEM_KEY
from tidemill.models import adaboost, extra_trees, fitting, neighbours
from tidemill.models.fitting import FittedModel, fit_model

X = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 6)) * 6
    x = centres[rng.integers(0, 30, 3_000)] + rng.normal(size=(3_000, 6))
    x[::3] = x[0]  # a third of the rows are one point
    return x, (x[:, 0] > 0).astype(int)


@pytest.fixture(scope="module")
def cloud(spark, points):
    x, y = points
    rows = [(i, *map(float, v), int(t), float(v[0] - v[1])) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in X) + ", y long, z double").cache()


@pytest.mark.parametrize("p", [1, 2])
def test_hashed_neighbours_find_nearly_all(cloud, monkeypatch, p):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 400)
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 300)
    train = neighbours.train_table(cloud, X, "y", ["k"], 5)
    queries = cloud.where("k % 7 = 1")
    exact = {r["k"]: {e["id"] for e in r["_near"]} for r in neighbours.nearest(queries, X, train, 5, p).collect()}
    hashed = neighbours.nearest(queries, X, train, 5, p, 0, approx=True)
    got = {r["k"]: [(e["d"], e["id"]) for e in r["_near"]] for r in hashed.collect()}
    assert got.keys() == exact.keys() and all(len(v) == 5 and v == sorted(v) for v in got.values())
    recall = sum(len({i for _, i in got[k]} & exact[k]) for k in exact) / (5 * len(exact))
    assert recall >= 0.9


def test_rows_far_from_all_are_searched_exactly(cloud, spark):
    train = neighbours.train_table(cloud, X, "y", ["k"], 3)
    far = spark.createDataFrame([(1, *[1e4 * i for i in range(6)])], "k long, " + ", ".join(f"{c} double" for c in X))
    both = [neighbours.nearest(far, X, train, 3, 2, approx=a).first()["_near"] for a in (False, True)]
    assert both[0] == both[1]


def test_both_sides_of_the_grid_are_copied_alike():
    assert neighbours.QUERY_BLOCK == neighbours.TRAIN_BLOCK


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_few_exact_distances_are_taken(far):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6_000, 24)) + far
    x[4_000:4_500] = x[:500]  # ties, told apart by id
    tid, y = rng.permutation(len(x)), rng.normal(size=len(x))
    near, taken = neighbours._near_squares(x[:200], x), []
    for rows, d, places in near(0, 200, np.full(200, np.inf), 5):
        assert np.array_equal(d, neighbours._distances(x[:200], x, 2)[rows, places])
        taken.append(len(rows))
    assert taken[0] < 200 * 60  # of 200 * 4 096
    d = neighbours._distances(x[:200], x, 2)
    best = [np.lexsort((tid, row))[:5] for row in d]
    got = list(neighbours._best(x[:200], x, y, tid, 5, 2))
    assert got == [[(d[i, j], tid[j], y[j]) for j in near] for i, near in enumerate(best)]


def test_copies_of_a_point_share_a_search(cloud):
    train = neighbours.train_table(cloud, X, "y", ["k"], 5)
    assert train.count() == 3_000 and neighbours._few_copies(train, 5).count() == 2_005
    seen = []
    plain = neighbours._with_points(cloud.withColumn("_q", F.array(*X)), lambda p: seen.append(p) or p.withColumn("_near", F.lit(0)))
    assert seen[0].count() == 2_001 and plain.count() == 3_000


def on_disk(spark):
    """Bytes of shuffles and of the shared folder."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [*(d.getAbsolutePath() for d in blocks), session.shared_dir(spark)]
    return sum(os.path.getsize(os.path.join(at, f)) for d in folders for at, _, files in os.walk(d) for f in files)


def vectors(spark, x, kind="array<float>"):
    rows = pd.DataFrame({"k": range(len(x)), "v": list(x), "y": np.arange(len(x)) % 7 / 2})
    return spark.createDataFrame(rows, f"k long, v {kind}, y double")


def brute_force(x, k):
    d = neighbours._distances(x, x, 2)
    order = [np.lexsort((np.arange(len(x)), row))[:k] for row in d]
    return [[(d[i, j], j, j % 7 / 2) for j in near] for i, near in enumerate(order)]


def test_neighbours_of_many_blocks_take_disk_in_proportion_to_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 100)
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 100)
    x = np.random.default_rng(8).normal(size=(2_000, 32)).astype(np.float32)
    df, before = vectors(spark, x), on_disk(spark)
    train = neighbours.train_table(df, ["v"], "y", ["k"], 3)
    got = neighbours.nearest(df, ["v"], train, 3, 2, 0).select("k", "_near").collect()
    assert on_disk(spark) - before < 8 * x.nbytes  # 20 blocks on either side
    assert [[tuple(e) for e in r["_near"]] for r in sorted(got)] == brute_force(x, 3)


def test_a_search_of_blocks_leaves_no_packed_table_and_no_setting(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df, before = vectors(spark, np.eye(6, 3)), spark.conf.get(name, None)
    there = set(os.listdir(session.shared_dir(spark)))
    train = neighbours.train_table(df, ["v"], "y", ["k"], 2)
    assert neighbours.nearest(df, ["v"], train, 2, 2, 0).count() == 6
    new = {f.rpartition("-")[0] for f in set(os.listdir(session.shared_dir(spark))) - there}
    assert "found" in new and not new & {"points", "train"}
    assert spark.conf.get(name, None) == before


@pytest.mark.parametrize("copied, held", [(200_000, 4_000_000), (0, 4_000_000), (200_000, 50)])
def test_neighbours_of_blocks_with_copies(spark, monkeypatch, copied, held):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 30)
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 20)
    monkeypatch.setattr(neighbours, "COPIED", copied)
    monkeypatch.setattr(neighbours, "HELD", held)
    x = np.random.default_rng(9).normal(size=(400, 5)).astype(np.float32)
    x[::2] = x[0]  # half of the rows are one point
    x[301:341] = x[1:41]
    x[0, 0], x[2, 0] = 0.0, -0.0
    x[4::2, 0] = 0.0
    # other kinds of numbers on both sides
    train = neighbours.train_table(vectors(spark, x, "array<double>"), ["v"], "y", ["k"], 4)
    got = neighbours.nearest(vectors(spark, x), ["v"], train, 4, 2, 0).select("k", "_near").collect()
    assert [[tuple(e) for e in r["_near"]] for r in sorted(got)] == brute_force(x, 4)


def test_a_missing_vector_is_an_error(spark, monkeypatch):
    df = vectors(spark, np.ones((6, 3), np.float32)).withColumn("v", F.expr("if(k = 3, NULL, v)"))
    train = neighbours.train_table(df.where("k < 3"), ["v"], "y", ["k"], 2)
    with pytest.raises(Exception, match="features are missing"):
        neighbours.nearest(df, ["v"], train, 2, 2, 0).collect()


def test_approximate_classifier(cloud):
    model = fit_model(cloud, "knn_classifier", "classification", X, "y", {"approx": True, "n_neighbors": 3}, ["k"])
    assert model.transform(cloud).where("prediction = y").count() > 0.97 * 3_000


def plain_stump(x, y, cuts):
    """The best of the drawn cut points by Gini impurity: feature, interval, shares of class 1."""
    best = None
    for j, inner in enumerate(cuts):
        cell = np.searchsorted(inner, x[:, j], side="right")
        for b in range(len(inner)):
            left = cell <= b
            if left.any() and (~left).any():
                parts = [y[left], y[~left]]
                impurity = sum(len(q) * (1 - q.mean() ** 2 - (1 - q.mean()) ** 2) for q in parts)
                if best is None or impurity < best[0] - 1e-9:
                    best = (impurity, left, parts[0].mean(), parts[1].mean())
    return np.where(best[1], best[2], best[3])


def test_a_tree_cuts_where_points_were_drawn(cloud, points):
    x, y = points
    params = {"n_estimators": 1, "max_depth": 1, "max_features": None, "bootstrap": False, "random_state": 3}
    model = fit_model(cloud, "extra_trees_classifier", "classification", X, "y", params)
    assert not any("searched" in n for n in model.notes)
    cuts = [s[1:-1] for s in model.spark_model.stages[0].getSplitsArray()]
    rng = np.random.default_rng(3)
    for j, inner in enumerate(cuts):
        assert inner == extra_trees.cut_points(x[:, j].min(), x[:, j].max(), rng)[1:-1]
    got = [r["probability"][1] for r in model.transform(cloud).orderBy("k").collect()]
    assert got == pytest.approx(list(plain_stump(x, y, [np.array(c) for c in cuts])))


def test_extra_trees_average_over_draws(cloud, tmp_path, spark):
    model = fit_model(cloud, "extra_trees_regressor", "regression", X, "z", {"n_estimators": 5, "max_depth": 6, "max_features": None})
    parts = model.spark_model.transform(cloud).select("k", *[f"_p{d}" for d in range(5)]).collect()
    want = {r["k"]: np.mean([r[f"_p{d}"] for d in range(5)]) for r in parts}
    got = {r["k"]: r["prediction"] for r in model.transform(cloud).collect()}
    assert got == pytest.approx(want)
    model.save(str(tmp_path / "m"))
    again = FittedModel.load(spark, str(tmp_path / "m")).transform(cloud)
    assert {r["k"]: r["prediction"] for r in again.collect()} == pytest.approx(got)
    many = fit_model(cloud, "extra_trees_classifier", "classification", X, "y", {"n_estimators": 20, "max_depth": 3})
    assert [s.getNumTrees for s in many.spark_model.stages[2::3]] == [2] * 4 + [1] * 12
    assert many.transform(cloud).where("prediction = y").count() > 0.9 * 3_000


def test_feature_subsets_change_a_single_tree(cloud):
    def used(value, seed=1):
        params = {"max_depth": 2, "max_features": value, "random_state": seed}
        model = fit_model(cloud, "decision_tree_classifier", "classification", X, "y", params)
        assert not any("max_features" in n for n in model.notes)
        return {r["k"]: r["probability"][1] for r in model.transform(cloud).collect()}

    everything = used(None)
    assert used(None, 2) == everything  # with all features, nothing is drawn
    assert any(used("log2", seed) != everything for seed in range(1, 6))


def test_notes_of_the_network(cloud):
    params = {"solver": "sgd", "learning_rate_init": 0.5, "max_iter": 2, "hidden_layer_sizes": "3"}
    model = fit_model(cloud, "mlp_classifier", "classification", X, "y", params)
    assert any("solver 'sgd'" in n and "learning_rate_init" in n for n in model.notes)


def test_fifty_rounds_of_boosting_keep_their_plan(cloud, monkeypatch):
    rows = cloud.select(*X, F.col("y").bitwiseXOR((F.col("k") % 9 == 0).cast("long")).cast("double").alias("_y"))
    sizes = []
    real = adaboost._fit_tree

    def watched(table, features, weight, learner):
        sizes.append(len(table.select(weight)._jdf.queryExecution().optimizedPlan().toString()))
        return real(table, features, weight, learner)

    monkeypatch.setattr(adaboost, "_fit_tree", watched)
    model = adaboost.fit_adaboost_classifier(rows, X, 2, 50, 1.0, 1)
    assert len(model["trees"]) == 50 and all(np.isfinite(model["weights"]))
    assert max(sizes[-8:]) < 1.5 * max(sizes[4:12])


def test_stored_weights_are_the_closed_ones(cloud, monkeypatch):
    rows = cloud.select(*X, F.col("z").alias("_y"))
    stored = adaboost.fit_adaboost_regressor(rows, X, 6, 1.0, 1)
    monkeypatch.setattr(adaboost, "KEPT_ROUNDS", 100)
    closed = adaboost.fit_adaboost_regressor(rows, X, 6, 1.0, 1)
    assert stored["weights"] == pytest.approx(closed["weights"]) and len(stored["trees"]) == len(closed["trees"])


@pytest.mark.parametrize(
    "name, params",
    [
        ("decision_tree_classifier", {"max_depth": 4, "min_samples_leaf": 300, "max_features": None}),
        ("gradient_boosting_classifier", {"n_estimators": 2, "max_depth": 3}),
        ("hist_gradient_boosting_classifier", {"max_iter": 2, "max_leaf_nodes": 8, "min_samples_leaf": 700}),
        ("random_forest_classifier", {"n_estimators": 3, "bootstrap": False, "max_depth": 4}),
    ],
)
def test_equal_rows_are_learned_as_one(spark, monkeypatch, name, params):
    rows = spark.range(24_000).select(
        (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 7).cast("int").alias("b"), (F.col("id") % 5).cast("int").alias("c")
    )
    df = rows.withColumn("y", ((F.col("a") * 3 + F.col("b") + F.col("c") * F.col("a")) % 4 > 1).cast("long")).cache()
    seen, merge = [], fitting._merge_equal
    monkeypatch.setattr(fitting, "_merge_equal", lambda *told: seen.append(merge(*told)) or seen[-1])
    merged = fit_model(df, name, "classification", ["a", "b", "c"], "y", params)
    assert seen[0].count() == 70 and seen[0].agg(F.sum("_w")).first()[0] == 24_000
    monkeypatch.setattr(fitting, "_merge_equal", lambda *told: None)
    plain = fit_model(df, name, "classification", ["a", "b", "c"], "y", params)
    cells = df.distinct()
    told = [[(r["prediction"], *[round(p, 9) for p in r["probability"]]) for r in m.transform(cells).orderBy("a", "b", "c").collect()] for m in (merged, plain)]
    assert told[0] == told[1] and len({t[0] for t in told[0]}) == 2


def test_equal_rows_of_support_vectors_are_light(spark, monkeypatch):
    rows = spark.range(24_000).select("id", *[(F.col("id") % n).cast("int").alias(x) for x, n in zip("abc", (2, 7, 5))])
    y = (F.col("a") * 3 + F.col("b") + F.col("c") > 6).cast("int").bitwiseXOR((F.col("id") % 11 == 0).cast("int"))
    df = rows.withColumn("y", y.cast("long")).drop("id").cache()
    seen, merge = [], fitting._merge_equal
    monkeypatch.setattr(fitting, "LIGHT", 8_000)
    monkeypatch.setattr(fitting, "_merge_equal", lambda *told: seen.append(merge(*told)) or seen[-1])
    light = fit_model(df, "svm_classifier", "classification", ["a", "b", "c"], "y").spark_model.stages[-1]
    told = seen[0].agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.max("_w").alias("most")).first()
    assert told["n"] <= 8_000 + 140 and told["w"] == pytest.approx(24_000) and told["most"] <= 3
    assert seen[0].groupBy("a", "b", "c", "_y").agg(F.round(F.sum("_w")).alias("n")).exceptAll(df.groupBy("a", "b", "c", "y").count()).isEmpty()
    monkeypatch.setattr(fitting, "LIGHT", 24_000)  # as few rows as that are left as they are
    plain = fit_model(df, "svm_classifier", "classification", ["a", "b", "c"], "y").spark_model.stages[-1]
    assert seen[1] is None
    assert list(light.coefficients) == pytest.approx(list(plain.coefficients), abs=1e-2)
    assert light.intercept == pytest.approx(plain.intercept, abs=1e-2)


def test_keys_do_not_stay_with_the_training_rows(spark, monkeypatch):
    seen, fit = [], models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda df, *told: seen.append(df) or fit(df, *told))
    for name in ("gradient_boosting_classifier", "hist_gradient_boosting_regressor"):
        told = REGISTERED[name].run(spark, "/root/testdata/sf0.001")
        assert {r["split"] for r in told.collect()} == {"train", "test"}
    assert [len(df.columns) for df in seen] == [5, 5] and not any(set(df.columns) & set(LINEITEM_KEY) for df in seen)


def test_rows_that_are_drawn_or_mostly_different_are_not_merged(cloud):
    drawn = fitting.ESTIMATORS["random_forest_classifier"]
    params = fitting.check_params("random_forest_classifier", "classification", {})
    assert not fitting._takes_weights(drawn(params, fitting.Facts(9, 2, 1, 0.0)))
    tree = fitting.ESTIMATORS["decision_tree_classifier"](fitting.check_params("decision_tree_classifier", "classification", {}), fitting.Facts(9, 2, 1, 0.0))
    different = cloud.sparkSession.range(30_000).select("id")
    assert fitting._merge_equal(different, tree, 30_000) is None


def test_training_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(session, "TRAINING_ROWS", 500)
    equal = spark.range(0, 10_000, 1, 2).select(F.lit(1).alias("x"))
    sizes = [r["n"] for r in session.spread_training(equal, 10_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 550


def test_equal_training_rows_are_bounded_with_fewer_parts_than_cores(spark, monkeypatch):
    monkeypatch.setattr(session, "TRAINING_ROWS", 30_000)
    equal = spark.range(0, 200_000, 1, 2).select((F.col("id") % 3).alias("x"), *[F.lit(i).alias(f"l{i}") for i in range(9)])
    sizes = [r["n"] for r in session.spread_training(equal, 200_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 30_000 and sum(sizes) == 200_000


@pytest.mark.parametrize("name", ["decision_tree", "random_forest", "hist_gradient_boosting"])
def test_cells_queries_learn_a_row_per_cell(spark, monkeypatch, name):
    seen, merge = [], fitting._merge_equal
    monkeypatch.setattr(fitting, "_merge_equal", lambda *told: seen.append(merge(*told)) or seen[-1])
    monkeypatch.setattr(fitting, "spread_training", None)  # no row is held
    told = REGISTERED[f"{name}_cells_classifier"].run(spark, "/root/testdata/sf0.01")
    assert told.count() == seen[0].agg(F.sum("_w")).first()[0] == 60_000
    assert seen[0].count() == 16 and seen[0].rdd.getNumPartitions() == 1
