import numpy as np
import pytest
from conftest import values

from tidemill.operators import features
from tidemill.plans.prepare import PreparePlan, fit_label_codes, fit_prepare


@pytest.fixture
def numbers(frame):
    return frame("k int, x double, c double", [(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0), (4, 9.0, 5.0)])


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust", "maxabs", "none"])
def test_scalers(numbers, kind):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    expected = {
        "standard": (x - x.mean()) / x.std(),
        "minmax": (x - 1) / 8,
        "robust": (x - q2) / (q3 - q1),
        "maxabs": x / 9,
        "none": x,
    }[kind]
    out = features.apply_scaler(numbers, features.fit_scaler(numbers, ["x", "c"], kind)).orderBy("k").collect()
    assert [r["x"] for r in out] == pytest.approx(list(expected))
    constant = {"standard": 0.0, "minmax": 0.0, "robust": 0.0, "maxabs": 1.0, "none": 5.0}[kind]
    assert [r["c"] for r in out] == [constant] * 4


def test_transformer(frame):
    df = frame("a double, s string, z int", [(1.0, "x", 1), (None, "y", 2), (3.0, None, 3), (4.0, "x", 4)])
    plan = features.fit_transformer(df, ["a"], ["s"], scaling="none", remainder="passthrough")
    plan = features.TransformPlan.from_json(plan.to_json())
    out = plan.apply(df)
    assert out.columns == ["a", "s_x", "s_y", "z"]
    assert values(out, "s_x", "s_y", "z") == [(0, 1, 2), (1, 0, 1), (1, 0, 3), (1, 0, 4)]
    fresh = frame("a double, s string, z int", [(None, "new", 9)])
    assert values(plan.apply(fresh)) == [(3.0, 0, 0, 9)]
    ordinal = features.fit_transformer(df, [], ["s"], categorical_encoding="ordinal")
    assert values(ordinal.apply(fresh)) == [(-1,)]
    for bad in ({"categorical_encoding": "nope"}, {"remainder": "nope"}, {"scaling": "nope"}):
        with pytest.raises(ValueError):
            features.fit_transformer(df, ["a"], ["s"], **bad)
    with pytest.raises(ValueError, match="At least one"):
        features.fit_transformer(df, [], [])


def test_dummies(frame):
    df = frame("s string, b boolean", [("y", True), ("x", False), ("z", None)])
    out = features.dummies(df, ["s", "b"])
    assert out.columns == ["s_y", "s_z", "b_True"]
    assert values(out) == [(0, 0, 0), (0, 1, 0), (1, 0, 1)]
    vec = features.one_hot_vector(df, ["s"]).transform(df)
    assert [list(r["s_vec"]) for r in vec.orderBy("s").collect()] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_selection(frame):
    rng = np.random.default_rng(3)
    y = np.arange(60) % 3
    x = np.column_stack([y + rng.normal(0, 0.3, 60), rng.normal(0, 1, 60), np.ones(60)])
    df = frame("y int, a double, b double, c double", [(int(y[i]), *map(float, x[i])) for i in range(60)])
    found = {r["column"]: r["score"] for r in features.anova_scores(df, ["a", "b"], "y").collect()}
    for j, c in enumerate("ab"):
        groups = [x[y == g, j] for g in range(3)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / 57
        assert found[c] == pytest.approx(between / within)
    assert features.select_k_best(df, ["b", "a"], "y", 1) == ["a"]
    assert features.select_k_best(df, ["a", "b"], "y", 2, "regression") == ["a", "b"]
    r2 = np.corrcoef(x[:, 0], y)[0, 1] ** 2
    score = features.regression_scores(df, ["a"], "y").first()["score"]
    assert score == pytest.approx(r2 / (1 - r2) * 58)
    assert features.variance_threshold(df, ["a", "b", "c"]) == ["a", "b"]
    with pytest.raises(ValueError, match="No feature"):
        features.variance_threshold(df, ["c"])
    with pytest.raises(ValueError):
        features.select_k_best(df, ["a"], "y", 2)


def test_polynomial(frame):
    df = frame("a int, b int", [(2, 3)])
    out = features.polynomial_features(df, ["a", "b"], 3, include_bias=True)
    assert out.columns == ["1", "a", "b", "a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]
    assert values(out) == [(1.0, 2.0, 3.0, 4.0, 6.0, 9.0, 8.0, 12.0, 18.0, 27.0)]


@pytest.fixture
def people(frame):
    rows = [
        (1, 10.0, "b", True, None, "no"),
        (2, None, "a", None, None, "yes"),
        (3, 30.0, None, True, None, "no"),
        (4, 20.0, "b", False, None, "yes"),
    ]
    return frame("k int, n double, s string, f boolean, e string, y string", rows)


def test_prepare(people, frame):
    plan = fit_prepare(people, "y", key=["k"])
    assert plan.features == ["n", "s_b", "f_True"]
    assert plan.classes == ["no", "yes"]
    out = plan.apply(people, ["k"])
    assert values(out) == [(1, 10.0, 1.0, 1.0, 0), (2, 20.0, 0.0, 1.0, 1), (3, 30.0, 1.0, 1.0, 0), (4, 20.0, 1.0, 0.0, 1)]
    again = PreparePlan.from_json(plan.to_json())
    assert values(again.apply(people, ["k"])) == values(out)
    fresh = frame("n double, s string, f boolean", [(None, "new", True)])
    assert values(plan.apply(fresh)) == [(20.0, 0.0, 1.0)]
    with pytest.raises(ValueError, match="Missing features"):
        plan.apply(fresh.drop("n"))


def test_prepare_faults(people, frame):
    with pytest.raises(KeyError, match="Target column"):
        fit_prepare(people, "nope")
    with pytest.raises(ValueError, match="task"):
        fit_prepare(people, "y", "nope")
    gap = frame("x int, y string", [(1, "a"), (2, None)])
    with pytest.raises(ValueError, match="missing values"):
        fit_prepare(gap, "y")
    kept = fit_prepare(gap, "y", keep_missing_label=True).apply(gap)
    assert values(kept, "label") == [(-1,), (0,)]
    dated = frame("d date, y int", [(None, 1)])
    with pytest.raises((TypeError, ValueError)):
        fit_prepare(dated, "y")


def test_label_orders(people):
    assert fit_label_codes(people.orderBy("k"), "s", ["k"]) == ["b", "a"]
    assert fit_label_codes(people, "s", ["k"], "alphabet") == ["a", "b"]
