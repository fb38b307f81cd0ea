"""Extremely randomised trees: the cut points of every feature are drawn, not searched.

A draw takes ``CUTS`` points per feature, evenly at random between its least and largest
value, and turns the features into the numbers of the intervals. A tree over those can
cut nowhere else. Every tree has a draw of its own, up to ``DRAWS``; beyond that, trees share
draws evenly and differ by the features that their nodes may use.

Rows in the same intervals are counted (``cells``), if there are many rows and few intervals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.models import cells
from tidemill.models.estimators import Facts, alone, extra_forest

CUTS = 15
DRAWS = 16


def cut_points(low: float, high: float, rng: np.random.Generator) -> list[float]:
    """Ascending cut points with open ends; a feature that does not vary has one."""
    inner = np.unique(rng.uniform(low, high, CUTS)) if high > low else np.array([low])
    return [-math.inf, *map(float, inner), math.inf]


def fit_extra_trees(
    rows: DataFrame, features: Sequence[str], params: dict[str, Any], facts: Facts, seed: int
) -> PipelineModel:
    """``rows`` hold the features as doubles and ``_y``. The stages add ``_p0, _p1 ...``: each
    draw's mean prediction, or its probabilities."""
    ends = rows.agg(*[F.struct(F.min(col(f)).alias("a"), F.max(col(f)).alias("b")).alias(f"e{i}") for i, f in enumerate(features)]).first()
    rng = np.random.default_rng(seed % 2**63)
    draws = min(params["n_estimators"], DRAWS)
    if params["n_estimators"] > DRAWS:
        facts.notes.append(f"{params['n_estimators']} trees share {DRAWS} draws of cut points")
    stages = []
    for d in range(draws):
        trees = params["n_estimators"] // draws + (d < params["n_estimators"] % draws)
        names = [f"_i{d}_{i}" for i in range(len(features))]
        splits = [cut_points(ends[f"e{i}"]["a"], ends[f"e{i}"]["b"], rng) for i in range(len(features))]
        cutter = Bucketizer(inputCols=list(features), outputCols=names, splitsArray=splits, handleInvalid="keep")
        assembler = VectorAssembler(inputCols=names, outputCol=f"_v{d}")
        forest = extra_forest(params, facts, trees, int(rng.integers(2**31)))
        told = cells.columns_of(d, f"_v{d}", facts.classes)
        counted = None
        if facts.rows > cells.CELLS and (trees == 1 or not params["bootstrap"]):
            draw = (1.0, True, forest.getSeed()) if params["bootstrap"] else None
            counted = cells.count_cells(rows, cutter, facts.classes, [draw])
        if counted is None:
            model = forest.fit(assembler.transform(cutter.transform(rows)).select(f"_v{d}", "_y"), {forest.getParam(k): v for k, v in told.items()})
            stages += [cutter, assembler, alone(model, rows.sparkSession)]
        else:
            forest.setBootstrap(False)
            stages += [cutter, assembler, cells.fit_cells(counted, 0, forest, assembler, facts.classes, told)]
    facts.notes[:] = list(dict.fromkeys(facts.notes))
    return PipelineModel(stages)


def mean_prediction(model: PipelineModel, classes: int) -> Column:
    """Over all trees: the mean, or the mean probability of every class."""
    kinds = (C.RandomForestClassificationModel, R.RandomForestRegressionModel)
    forests = [s for s in model.stages if isinstance(s, kinds)]
    weights = [f.getNumTrees for f in forests]
    total = float(sum(weights))
    if not classes:
        return sum([F.col(f"_p{d}") * F.lit(w / total) for d, w in enumerate(weights)], F.lit(0.0))
    arrays = [vector_to_array(f"_p{d}") for d in range(len(weights))]
    shares = [
        sum([a[c] * F.lit(w / total) for a, w in zip(arrays, weights)], F.lit(0.0)) for c in range(classes)
    ]
    return F.array(*shares)
