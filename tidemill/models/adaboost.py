"""Adaptive boosting over small trees.

Each fitted tree is turned into a column expression. The logarithm of a row's weight is a
stored column and what the rounds since then have added to it; every ``KEPT_ROUNDS`` rounds it is
written anew, so that the plan of a round is as large in round 50 as in round 5. Weights
are taken relative to the largest one, so that no number of rounds makes them overflow or vanish.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import Any

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.session import written

KEPT_ROUNDS = 4
_LINE = re.compile(r"^(\s*)(If|Else|Predict:)\s*(?:\(feature (\d+) (<=|>) (\S+)\)|(\S+))")


def read_tree(description: str) -> Any:
    """Nested ``[feature, threshold, left, right]`` or a leaf value, from the tree's text."""
    lines = [m for m in map(_LINE.match, description.splitlines()) if m]
    place = 0

    def node() -> Any:
        nonlocal place
        m = lines[place]
        place += 1
        if m.group(2) == "Predict:":
            return float(m.group(6))
        feature, threshold = int(m.group(3)), float(m.group(5))
        left = node()
        place += 1  # the matching "Else"
        return [feature, threshold, left, node()]

    return node()


def tree_value(tree: Any, features: Sequence[str]) -> Column:
    if not isinstance(tree, list):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    test = col(features[feature]).cast("double") <= F.lit(threshold)
    return F.when(test, tree_value(left, features)).otherwise(tree_value(right, features))


def _fit_tree(rows: DataFrame, features: Sequence[str], weight: Column, learner) -> Any:
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x").transform(
        rows.withColumn("_w", weight)
    )
    return read_tree(learner.fit(assembled.select("_x", "_y", "_w")).toDebugString)


class _Weights:
    """Rows with the logarithm of their weights: a stored part and what came since."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.stored, self.added, self.rounds = rows, F.lit(0.0), F.lit(0.0), 0
        self.top = 0.0  # no logarithm is above it

    @property
    def weight(self) -> Column:
        return F.exp(self.stored + self.added - F.lit(self.top))

    def add(self, amount: Column, most: float) -> None:
        """Adds ``amount`` to every row, ``most`` at most."""
        self.added, self.top, self.rounds = self.added + amount, self.top + most, self.rounds + 1
        if self.rounds % KEPT_ROUNDS == 0:
            raised = (self.stored + self.added).alias("_raised")
            self.rows = written(self.rows.select(*[col(c) for c in self.rows.columns if c != "_raised"], raised), "weights")
            self.stored, self.added = F.col("_raised"), F.lit(0.0)
            self.top = self.rows.agg(F.max("_raised")).first()[0]


def fit_adaboost_classifier(
    rows: DataFrame, features: Sequence[str], classes: int, rounds: int, rate: float, seed: int
) -> dict[str, Any]:
    """``rows`` holds the features and the class code ``_y``."""
    learner = DecisionTreeClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=1, seed=seed, maxBins=64
    )
    trees, alphas, weights = [], [], _Weights(rows)
    for _ in range(rounds):
        tree = _fit_tree(weights.rows, features, weights.weight, learner)
        missed = (tree_value(tree, features) != F.col("_y")).cast("double")
        sums = weights.rows.agg(F.sum(weights.weight * missed).alias("bad"), F.sum(weights.weight).alias("all")).first()
        error = sums["bad"] / sums["all"]
        if error <= 0:
            trees.append(tree)
            alphas.append(1.0)
            break
        if error >= 1 - 1 / classes:
            break
        alpha = rate * (math.log((1 - error) / error) + math.log(classes - 1))
        trees.append(tree)
        alphas.append(alpha)
        weights.add(F.lit(alpha) * missed, alpha)
    if not trees:
        raise ValueError("the first tree is no better than chance")
    return {"trees": trees, "weights": alphas}


def score_adaboost_classifier(
    df: DataFrame, features: Sequence[str], model: dict[str, Any], classes: int
) -> DataFrame:
    votes = [(tree_value(t, features), w) for t, w in zip(model["trees"], model["weights"])]
    totals = []
    for k in range(classes):
        total = F.lit(0.0)
        for value, weight in votes:
            total = total + F.when(value == F.lit(float(k)), F.lit(weight)).otherwise(F.lit(0.0))
        totals.append(total)
    scored = df.withColumn("_votes", F.array(*totals))
    others = max(classes - 1, 1)
    share = F.transform("_votes", lambda v: v / F.lit(sum(model["weights"])))
    decision = F.transform(share, lambda s: s - (1 - s) / F.lit(others))
    shares = F.transform(decision, lambda d: F.exp(d / F.lit(others)))
    total = F.aggregate(shares, F.lit(0.0), lambda s, v: s + v)
    return (
        scored.withColumn("_code", F.array_position("_votes", F.array_max("_votes")).cast("int") - 1)
        .withColumn("probability", F.transform(shares, lambda v: v / total))
        .drop("_votes")
    )


def fit_adaboost_regressor(
    rows: DataFrame, features: Sequence[str], rounds: int, rate: float, seed: int
) -> dict[str, Any]:
    learner = DecisionTreeRegressor(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=3, seed=seed, maxBins=64
    )
    trees, votes, weights = [], [], _Weights(rows)
    for _ in range(rounds):
        tree = _fit_tree(weights.rows, features, weights.weight, learner)
        miss = F.abs(tree_value(tree, features) - F.col("_y"))
        sums = weights.rows.agg(
            F.max(miss).alias("worst"), F.sum(weights.weight * miss).alias("bad"), F.sum(weights.weight).alias("all")
        ).first()
        if not sums["worst"]:
            trees.append(tree)
            votes.append(1.0)
            break
        loss = sums["bad"] / sums["all"] / sums["worst"]
        if loss >= 0.5:
            if not trees:
                trees.append(tree)
                votes.append(1.0)
            break
        beta = loss / (1 - loss)
        trees.append(tree)
        votes.append(rate * math.log(1 / beta))
        weights.add(F.lit(rate * math.log(beta)) * (1 - miss / F.lit(sums["worst"])), 0.0)
    return {"trees": trees, "weights": votes}


def score_adaboost_regressor(df: DataFrame, features: Sequence[str], model: dict[str, Any]) -> DataFrame:
    """The weighted median of the trees' values."""
    values = F.array_sort(
        F.array(
            *[
                F.struct(tree_value(t, features).alias("v"), F.lit(w).alias("w"))
                for t, w in zip(model["trees"], model["weights"])
            ]
        )
    )
    half = sum(model["weights"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
    median = F.aggregate(
        values,
        start,
        lambda acc, e: F.struct(
            (acc["sum"] + e["w"]).alias("sum"),
            F.coalesce(acc["v"], F.when(acc["sum"] + e["w"] >= half, e["v"])).alias("v"),
        ),
        lambda acc: acc["v"],
    )
    return df.withColumn("prediction", median)
