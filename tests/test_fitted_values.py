"""What a fitted plan keeps for tables it has not seen."""

from tidemill.operators.features import fit_transformer
from tidemill.plans.prepare import fit_prepare


def test_imputer_keeps_a_fraction_for_later(frame):
    plan = fit_transformer(frame("a int", [(1,), (2,), (3,), (4,)]), ["a"], [], scaling="none")
    assert plan.fills == {"a": 2.5}


def test_text_where_a_number_was_is_filled(frame):
    plan = fit_prepare(frame("a double, y int", [(1.0, 0), (3.0, 1), (5.0, 1)]), "y")
    got = plan.apply(frame("a string", [("abc",), ("4",), (None,)])).collect()
    assert [r["a"] for r in got] == [3.0, 4.0, 3.0]
