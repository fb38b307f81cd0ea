"""Gaussian naive Bayes: one grouped aggregate to fit, one projection to score."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col

MAX_CLASSES = 10_000


def fit_bayes(
    df: DataFrame, features: Sequence[str], label: str, var_smoothing: float = 1e-9
) -> dict[str, Any]:
    """Class shares, means and variances. Every variance is raised by a small part of
    the largest overall variance."""
    x = {f: col(f).cast("double") for f in features}
    stats = df.groupBy(col(label).alias("g")).agg(
        F.count("*").alias("n"),
        *[F.avg(x[f]).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(x[f]).alias(f"v{i}") for i, f in enumerate(features)],
    )
    rows = sorted(stats.limit(MAX_CLASSES + 1).collect(), key=lambda r: r["g"])
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    total = sum(r["n"] for r in rows)
    widest = 0.0
    for i in range(len(features)):
        # the overall variance follows from the class moments
        mean = sum(r["n"] * r[f"m{i}"] for r in rows) / total
        spread = sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rows) / total
        widest = max(widest, spread)
    extra = var_smoothing * widest
    return {
        "classes": [r["g"] for r in rows],
        "priors": [r["n"] / total for r in rows],
        "means": [[r[f"m{i}"] for i in range(len(features))] for r in rows],
        "variances": [[r[f"v{i}"] + extra for i in range(len(features))] for r in rows],
    }


def log_joint(features: Sequence[str], model: dict[str, Any]) -> Column:
    """Array of log prior + log density, one entry per class."""
    x = F.array(*[col(f).cast("double") for f in features])
    entries = []
    for prior, means, variances in zip(model["priors"], model["means"], model["variances"]):
        base = math.log(prior) - 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
        table = F.array(
            *[F.struct(F.lit(m).alias("m"), F.lit(v).alias("v")) for m, v in zip(means, variances)]
        )
        entries.append(F.struct(F.lit(base).alias("base"), table.alias("t")))

    def density(entry: Column) -> Column:
        pairs = F.zip_with(x, entry["t"], lambda a, t: (a - t["m"]) * (a - t["m"]) / t["v"])
        return entry["base"] - 0.5 * F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)

    return F.transform(F.array(*entries), density)


def score_bayes(df: DataFrame, features: Sequence[str], model: dict[str, Any]) -> DataFrame:
    """Adds ``_code`` (position of the best class) and ``probability``."""
    scored = df.withColumn("_joint", log_joint(features, model))
    top = F.array_max("_joint")
    odds = F.transform("_joint", lambda j: F.exp(j - top))
    total = F.aggregate(odds, F.lit(0.0), lambda s, o: s + o)
    return (
        scored.withColumn("_code", F.array_position("_joint", top).cast("int") - 1)
        .withColumn("probability", F.transform(odds, lambda o: o / total))
        .drop("_joint")
    )
