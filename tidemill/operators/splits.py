"""Repeatable train / validation / test splits of exact size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col, free_name, require_columns
from tidemill.functions.ranking import HashOrder, TooManyGroups
from tidemill.operators import strata

PARTS = ("train", "validation", "test")


def split_sizes(rows: int, test_size: float, validation_size: float | None = None) -> list[int]:
    """Rows of train, validation and test. Held-out parts are rounded up, first both
    together, then the test share of them."""
    if not 0 < test_size < 1:
        raise ValueError(f"a test share of {test_size} leaves one part empty")
    if validation_size is None:
        test = math.ceil(rows * test_size)
        sizes = [rows - test, 0, test]
    else:
        if not 0 < validation_size < 1:
            raise ValueError(f"a validation share of {validation_size} leaves one part empty")
        if validation_size + test_size >= 1:
            raise ValueError("test and validation rows leave none to train on")
        held = math.ceil(rows * (validation_size + test_size))
        test = math.ceil(held * (test_size / (validation_size + test_size)))
        sizes = [rows - held, held - test, test]
    if sizes[0] < 1 or (validation_size is not None and sizes[1] < 1):
        raise ValueError(f"{rows} rows are too few for this split.")
    return sizes


def quotas(counts: Mapping[str | None, int], draws: int) -> dict[str | None, int]:
    """``draws`` rows over the classes in proportion, by largest remainder; equal
    remainders go to the smaller class value, a missing class comes last."""
    total = sum(counts.values())
    exact = {g: draws * n for g, n in counts.items()}
    out = {g: v // total for g, v in exact.items()}
    left = draws - sum(out.values())
    order = sorted(counts, key=lambda g: (-(exact[g] % total), g is None, g or ""))
    for g in order[:left]:
        out[g] += 1
    return out


def split(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    validation_size: float | None = None,
    random_state: int = 42,
    stratify: bool = False,
    key: Sequence[str] | None = None,
    name: str = "split",
) -> DataFrame:
    """Adds a column that holds ``train``, ``validation`` or ``test``."""
    require_columns(df, [target])
    order = HashOrder(df, key, random_state)
    part = free_name(df, "_part")
    if stratify:
        try:
            sizes = _class_sizes(order.totals(target), test_size, validation_size)
            dealt = order.deal(sizes, part, target)
        except TooManyGroups:
            dealt = _deal_strata(df, target, test_size, validation_size, random_state, key, part)
    else:
        dealt = order.deal({"": split_sizes(order.totals()[""], test_size, validation_size)}, part)
    label = F.element_at(F.array(*map(F.lit, PARTS)), F.col(part) + 1)
    return dealt.select(*[col(c) for c in df.columns], label.alias(name))


def _deal_strata(df, target, test_size, validation_size, random_state, key, part) -> DataFrame:
    """The same rules with the classes in a table."""
    counts = strata.count_strata(df, target)
    told = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), F.min("n").alias("least")).first()
    if told["least"] < 2:
        rare = [r["g"] for r in counts.where("n < 2").limit(10).collect()]
        raise ValueError(f"stratify needs at least 2 rows of every class, too few of: {rare}")
    sizes = split_sizes(told["rows"], test_size, validation_size)
    if min(sizes[0], sizes[1] + sizes[2]) < told["classes"]:
        raise ValueError("every part needs at least one row per class.")
    return strata.deal(df, target, strata.split_quotas(counts, sizes), key, random_state, part)


def _class_sizes(counts: dict, test_size: float, validation_size: float | None) -> dict:
    rare = [g for g, n in counts.items() if n < 2]
    if rare:
        raise ValueError(f"stratify needs at least 2 rows of every class, too few of: {rare[:10]}")
    train, validation, test = split_sizes(sum(counts.values()), test_size, validation_size)
    if min(train, validation + test) < len(counts):
        raise ValueError("every part needs at least one row per class.")
    first = quotas(counts, train)
    held = {g: counts[g] - first[g] for g in counts}
    second = quotas(held, validation) if validation else dict.fromkeys(counts, 0)
    return {g: [first[g], second[g], held[g] - second[g]] for g in counts}


def fold_sizes(rows: int, folds: int) -> list[int]:
    """Equal folds; the first ``rows % folds`` get one row more."""
    return [rows // folds + (1 if i < rows % folds else 0) for i in range(folds)]


def assign_folds(
    df: DataFrame,
    target: str,
    folds: int,
    stratify: bool,
    random_state: int = 42,
    key: Sequence[str] | None = None,
    name: str = "fold",
) -> DataFrame:
    """Adds the fold number of every row; with ``stratify`` each class is spread evenly."""
    require_columns(df, [target])
    if folds < 2:
        raise ValueError("cv must be >= 2.")
    order = HashOrder(df, key, random_state)
    if not stratify:
        return order.deal({"": fold_sizes(order.totals()[""], folds)}, name)
    try:
        counts = order.totals(target)
    except TooManyGroups:
        table = strata.count_strata(df, target)
        if table.agg(F.max("n")).first()[0] < folds:
            raise ValueError(f"cv={folds} is more than the rows of any class.") from None
        return strata.deal(df, target, strata.fold_ends(table, folds), key, random_state, name)
    if max(counts.values()) < folds:
        raise ValueError(f"cv={folds} is more than the rows of any class.")
    sizes, start = {}, 0
    for g in sorted(counts, key=lambda v: (v is None, v or "")):
        # the extra rows of each class continue where the previous class stopped
        extra = counts[g] % folds
        lucky = {(start + i) % folds for i in range(extra)}
        sizes[g] = [counts[g] // folds + (1 if i in lucky else 0) for i in range(folds)]
        start = (start + extra) % folds
    return order.deal(sizes, name, target)
