"""Feature preparation that is fitted once and then applied as a projection."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations_with_replacement
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, is_number, require_columns, type_of
from tidemill.functions.order_stats import exact_quantiles
from tidemill.operators.missing import apply_fill, fit_fill
from tidemill.operators.profile import distinct_values

SCALERS = ("standard", "minmax", "robust", "maxabs", "none")
DUMMY_LIMIT = 2_000


def fit_scaler(
    df: DataFrame, columns: Sequence[str], kind: str, approx: bool = False
) -> dict[str, tuple[float, float]]:
    """``{column: (offset, scale)}`` for ``(x - offset) / scale``; a zero scale becomes 1."""
    if kind not in SCALERS:
        raise ValueError(f"scaling must be one of {SCALERS}")
    require_columns(df, columns)
    if kind == "none" or not columns:
        return {c: (0.0, 1.0) for c in columns}
    if kind == "robust":
        numbers = df.select(*[col(c).cast("double").alias(c) for c in columns])
        q = exact_quantiles(numbers, {c: [0.25, 0.5, 0.75] for c in columns}, approx)
        pairs = {c: (q[c][1], None if q[c][0] is None else q[c][2] - q[c][0]) for c in columns}
    else:
        statistics = {
            "standard": (F.avg, F.stddev_pop),
            "minmax": (F.min, lambda x: F.max(x) - F.min(x)),
            "maxabs": (lambda x: F.lit(0.0), lambda x: F.max(F.abs(x))),
        }[kind]
        row = df.agg(
            *[
                f(col(c).cast("double")).alias(f"{tag}{i}")
                for i, c in enumerate(columns)
                for tag, f in zip("os", statistics)
            ]
        ).first()
        pairs = {c: (row[f"o{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    return {c: (o or 0.0, s or 1.0) for c, (o, s) in pairs.items()}


def scaled(name: str, offset: float, scale: float) -> Column:
    return (col(name).cast("double") - F.lit(offset)) / F.lit(scale)


def apply_scaler(df: DataFrame, fitted: Mapping[str, Sequence[float]]) -> DataFrame:
    return df.select(
        *[scaled(c, *fitted[c]).alias(c) if c in fitted else col(c) for c in df.columns]
    )


def value_text(value: Any) -> str:
    """A category as it appears in a column name."""
    return str(value)


def dummy_columns(name: str, values: Sequence[Any], kind: T.DataType, drop_first: bool) -> dict[str, Column]:
    """``{c}_{v}`` 0/1 columns; a value outside ``values`` gives all zeros."""
    out = {}
    for v in values[1:] if drop_first else values:
        equal = col(name) == F.lit(v).cast(kind)
        out[f"{name}_{value_text(v)}"] = F.coalesce(equal.cast("int"), F.lit(0))
    return out


def fit_dummies(df: DataFrame, columns: Sequence[str], limit: int = DUMMY_LIMIT) -> dict[str, list]:
    """Sorted categories per column. One column per category is only sensible below a
    limit; ``one_hot_vector`` has none."""
    return distinct_values(df, columns, limit)


def dummies(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    require_columns(df, columns)
    values = fit_dummies(df, columns)
    kept = [col(c) for c in df.columns if c not in set(columns)]
    made = [
        v.alias(n)
        for c in columns
        for n, v in dummy_columns(c, values[c], type_of(df, c), drop_first).items()
    ]
    return df.select(*kept, *made)


def one_hot_vector(df: DataFrame, columns: Sequence[str]):
    """Sparse one-hot encoding for columns with many values: a fitted Spark ML model that
    adds ``{c}_vec``; unknown values give all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = [f"{c}_idx" for c in columns]
    stages = [
        StringIndexer(
            inputCols=list(columns), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(
            inputCols=index, outputCols=[f"{c}_vec" for c in columns], dropLast=True, handleInvalid="error"
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def code_map(values: Sequence[Any], kind: T.DataType, value: Column, unknown: Column) -> Column:
    """Position of a value in a list; one literal map, bounded by the list."""
    if not values:
        return unknown
    entries = []
    for i, v in enumerate(values):
        entries += [F.lit(v).cast(kind), F.lit(i)]
    return F.coalesce(F.try_element_at(F.create_map(*entries), value), unknown)


@dataclass
class TransformPlan:
    """What the column transformer has learned; JSON-able, applies to tables and streams."""

    numeric: list[str]
    categorical: list[str]
    fills: dict[str, Any]
    scales: dict[str, list[float]]
    encoding: str
    categories: dict[str, list[Any]]
    remainder: str
    passed: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        require_columns(df, [*self.numeric, *self.categorical, *self.passed, *keep])
        filled = apply_fill(df, self.fills)
        out = [col(k) for k in keep]
        out += [scaled(c, *self.scales[c]).alias(c) for c in self.numeric]
        for c in self.categorical:
            kind = type_of(filled, c)
            if self.encoding == "one_hot":
                made = dummy_columns(c, self.categories[c], kind, drop_first=False)
                out += [v.alias(n) for n, v in made.items()]
            else:
                out.append(code_map(self.categories[c], kind, col(c), F.lit(-1)).alias(c))
        out += [col(c) for c in self.passed if c not in set(keep)]
        return filled.select(*out)

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> TransformPlan:
        return cls(**json.loads(text))


def fit_transformer(
    df: DataFrame,
    numeric_columns: Sequence[str],
    categorical_columns: Sequence[str],
    numeric_imputation: str = "median",
    categorical_imputation: str = "most_frequent",
    categorical_encoding: str = "one_hot",
    scaling: str = "standard",
    remainder: str = "drop",
    approx: bool = False,
    sparse: bool = False,
):
    """A fitted :class:`TransformPlan`; with ``sparse`` a ``SparsePlan``, whose categories are
    written tables without a limit and whose output is one sparse vector."""
    numeric, categorical = list(numeric_columns), list(categorical_columns)
    if categorical_encoding not in ("one_hot", "ordinal"):
        raise ValueError(f"no categorical encoding {categorical_encoding!r}: one_hot or ordinal")
    if remainder not in ("drop", "passthrough"):
        raise ValueError("remainder must be 'drop' or 'passthrough'.")
    if not numeric and not categorical:
        raise ValueError("nothing to transform. At least one column has to be named")
    require_columns(df, [*numeric, *categorical])
    fills: dict[str, Any] = {}
    if numeric:
        fills.update(fit_fill(df, numeric, numeric_imputation, 0, approx, keep_all=True))
    if categorical:
        fills.update(fit_fill(df, categorical, categorical_imputation, "missing"))
    filled = apply_fill(df, fills)
    scales = fit_scaler(filled, numeric, scaling, approx)
    passed = [c for c in df.columns if c not in {*numeric, *categorical}] if remainder == "passthrough" else []
    if sparse:
        from tidemill.plans.sparse import SparsePlan, fit_tables

        return SparsePlan(
            [*numeric, *categorical], numeric, fit_tables(filled, categorical), fills,
            {c: list(s) for c, s in scales.items()}, drop_first=False, ordinal=categorical_encoding == "ordinal", passed=passed,
        )
    limit = DUMMY_LIMIT if categorical_encoding == "one_hot" else 10_000
    return TransformPlan(
        numeric=numeric,
        categorical=categorical,
        fills=fills,
        scales={c: list(s) for c, s in scales.items()},
        encoding=categorical_encoding,
        categories=distinct_values(filled, categorical, limit) if categorical else {},
        remainder=remainder,
        passed=passed,
    )


def variance_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, variance`` (population)."""
    require_columns(df, columns)
    wide = df.agg(*[F.var_pop(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    return _scores(wide, columns, "v", "variance")


def _scores(wide: DataFrame, columns: Sequence[str], prefix: str, name: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"{prefix}{i}").alias(name)) for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*cells)))


def variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    """The columns whose variance is above ``threshold``."""
    found = {r["column"]: r["variance"] for r in variance_scores(df, columns).collect()}
    kept = [c for c in columns if found[c] is not None and found[c] > threshold]
    if not kept:
        raise ValueError(f"No feature meets the variance threshold {threshold}.")
    return kept


def anova_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``column, score``: F of a one-way analysis of variance between the label's classes."""
    require_columns(df, [*columns, label])
    per_class = df.groupBy(col(label).alias("g")).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(col(c)).cast("double").alias("n"),
                F.avg(col(c).cast("double")).alias("m"),
                F.var_pop(col(c).cast("double")).alias("v"),
            ).alias(f"a{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = per_class.select(F.inline(F.array(*[F.col(f"a{i}") for i in range(len(columns))])))
    sums = rows.groupBy("column").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias(
            "between"
        ),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    return sums.select(
        "column",
        F.try_divide(
            F.col("between") / (F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))
        ).alias("score"),
    )


def regression_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``column, score``: F of the correlation with a numeric label."""
    require_columns(df, [*columns, label])
    y = col(label).cast("double")
    r2 = [F.pow(F.corr(col(c).cast("double"), y), 2) for c in columns]
    n = F.count(y)
    wide = df.agg(*[F.try_divide(r * (n - 2), 1 - r).alias(f"s{i}") for i, r in enumerate(r2)])
    return _scores(wide, columns, "s", "score")


def select_k_best(
    df: DataFrame, columns: Sequence[str], label: str, k: int, task: str = "classification"
) -> list[str]:
    """The ``k`` best columns, in table order; the earlier column wins a tie."""
    if not 0 < k <= len(columns):
        raise ValueError(f"k must be between 1 and {len(columns)}.")
    scores = (anova_scores if task == "classification" else regression_scores)(df, columns, label)
    found = {r["column"]: r["score"] for r in scores.collect()}
    order = sorted(columns, key=lambda c: -(found[c] if found[c] is not None else float("-inf")))
    best = set(order[:k])
    return [c for c in columns if c in best]


def polynomial_features(
    df: DataFrame,
    columns: Sequence[str],
    degree: int = 2,
    include_bias: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All products up to ``degree``, by degree and then by column order."""
    require_columns(df, [*columns, *keep])
    wrong = [c for c in columns if not is_number(type_of(df, c))]
    if wrong:
        raise TypeError(f"Polynomial features require numeric columns: {wrong}")
    out = [col(k) for k in keep]
    if include_bias:
        out.append(F.lit(1.0).alias("1"))
    for d in range(1, degree + 1):
        for picked in combinations_with_replacement(columns, d):
            product = col(picked[0]).cast("double")
            for c in picked[1:]:
                product = product * col(c).cast("double")
            powers = {c: picked.count(c) for c in picked}
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            out.append(product.alias(name))
    return df.select(*out)
