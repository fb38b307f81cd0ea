"""Features and label for a model, fitted on a table and applied to any batch."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, is_number, require_columns, type_of
from tidemill.functions.numbers import parse_number
from tidemill.operators.codes import fit_codes
from tidemill.operators.features import code_map, dummy_columns, fit_dummies
from tidemill.operators.missing import apply_fill, fit_auto_fill
from tidemill.operators.profile import MAX_VALUES
from tidemill.operators.rows import empty_columns
from tidemill.plans.sparse import SparsePlan, fit_tables

TASKS = ("classification", "regression")


@dataclass
class PreparePlan:
    target: str
    task: str
    inputs: list[str]
    fills: dict[str, Any]
    dummies: dict[str, list[Any]]
    classes: list[Any] | None  # text labels in code order; None for a numeric label
    features: list[str] = field(default_factory=list)
    label: str = "label"

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, the features in the fitted order, and the label if present.

        A category that was not seen gives zeros; columns that were not seen are left out.
        """
        missing = [c for c in self.inputs if c not in set(df.columns)]
        if missing:
            raise ValueError(f"Missing features: {missing}")
        # text where a number was: what does not parse is missing, and is filled
        texts = [
            c for c in self.inputs if c not in self.dummies and isinstance(type_of(df, c), T.StringType)
        ]
        filled = apply_fill(df.withColumns({c: parse_number(col(c)) for c in texts}), self.fills)
        columns = {}
        for c in self.inputs:
            if c not in self.dummies:
                columns[c] = col(c).cast("double")
        for c, values in self.dummies.items():
            columns.update(dummy_columns(c, values, type_of(filled, c), drop_first=True))
        out = [col(k) for k in keep]
        out += [columns[f].cast("double").alias(f) for f in self.features]
        if self.target in df.columns:
            out.append(self._label(df).alias(self.label))
        return filled.select(*out)

    def _label(self, df: DataFrame):
        y, kind = col(self.target), type_of(df, self.target)
        if self.classes is not None:
            code = code_map(self.classes, T.StringType(), y.cast("string"), F.lit(-1))
            return code.cast("bigint" if self.task == "classification" else "double")
        if isinstance(kind, T.StringType):
            y = parse_number(y)
        if self.task == "classification":
            return y.cast("bigint")
        return y.cast("double")

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> PreparePlan:
        return cls(**json.loads(text))


def label_codes(df: DataFrame, target: str, key: Sequence[str], order: str = "first") -> DataFrame:
    """``value, code``: 0, 1, 2 ... by first appearance in ``key`` order, or alphabetically."""
    return fit_codes(df, target, order, key).read(df.sparkSession)


def fit_label_codes(df: DataFrame, target: str, key: Sequence[str], order: str = "first") -> list[str]:
    if order not in ("first", "alphabet"):
        raise ValueError("order must be 'first' or 'alphabet'.")
    require_columns(df, [target, *key])
    place = F.struct(*[col(k) for k in key]) if key else col(target).cast("string")
    firsts = (
        df.where(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("value"))
        .agg(F.min(place).alias("place"))
    )
    ranked = firsts.orderBy("place" if order == "first" else "value").select("value")
    values = [r["value"] for r in ranked.limit(MAX_VALUES + 1).collect()]
    if len(values) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} classes in {target!r}")
    return values


def fit_prepare(
    df: DataFrame,
    target: str,
    task: str = "classification",
    key: Sequence[str] = (),
    drop: Sequence[str] = (),
    order: str = "first",
    keep_missing_label: bool = False,
    approx: bool = False,
    sparse: bool = False,
) -> PreparePlan | SparsePlan:
    """Learns fills, categories and label codes. ``key`` columns identify rows and are
    not features unless they are left out of ``key``; ``drop`` names columns to ignore.

    With ``sparse``, features are sparse vectors and categories and classes are written
    tables, so that their number has no limit.
    """
    if task not in TASKS:
        raise ValueError(f"task must be classification or regression, got {task!r}")
    if target not in df.columns:
        raise KeyError(f"Target column {target!r} is not one of {df.columns}")
    unused = {target, *key, *[c for c in drop if c in df.columns]}
    empty = set(empty_columns(df, keep=list(unused)))
    inputs = [c for c in df.columns if c not in unused and c not in empty]
    if not inputs:
        raise ValueError("no feature column is left")
    wrong = [
        c
        for c in inputs
        if not is_number(type_of(df, c)) and not isinstance(type_of(df, c), (T.StringType, T.BooleanType))
    ]
    if wrong:
        raise TypeError(f"turn these columns into numbers or text first, or drop them: {wrong}")
    table = df.select(*[col(c) for c in inputs])
    fills = fit_auto_fill(table, approx=approx, keep_all=True)
    categorical = [c for c in inputs if not is_number(type_of(df, c))]
    filled = apply_fill(table, fills)
    values = fit_dummies(filled, categorical) if categorical and not sparse else {}
    numeric_label = is_number(type_of(df, target))
    if numeric_label or not keep_missing_label:
        if not df.where(col(target).isNull()).isEmpty():
            raise ValueError(f"The target {target!r} has missing values.")
    if sparse:
        return SparsePlan(
            inputs, [c for c in inputs if c not in set(categorical)], fit_tables(filled, categorical), fills,
            target=target, task=task, classes=None if numeric_label else fit_codes(df, target, order, key),
        )
    classes = None if numeric_label else fit_label_codes(df, target, key, order)
    features = [c for c in inputs if c not in values]
    for c in categorical:
        features += [f"{c}_{v}" for v in values[c][1:]]
    return PreparePlan(target, task, inputs, fills, values, classes, features)
