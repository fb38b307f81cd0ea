"""Training rows as counted cells: features are cut into intervals, and rows that lie in the
same intervals become one row that weighs as many as are drawn of them.

A tree sees no more of its rows than that: of a class label the number of rows, of a numeric
label their number and mean, as a split's gain in variance depends on nothing else. Where rows
are drawn, every row is, each time for itself; only what was drawn is counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.models.estimators import BINS, Facts, alone
from tidemill.session import written

FINEST = 255  # of up to its square of rows, a tree looks at all for its cut points
CELLS = FINEST * FINEST
TREES = 16  # with a draw of their own; each is a model


def times_drawn(share: float, replace: bool, u: Column) -> Column:
    """How often a row with the uniform number ``u`` is drawn: as Spark's forests draw, a Poisson
    number if rows are put back, else 0 or 1."""
    if not replace:
        return (u < share).cast("double")
    steps, p, total, k = [], math.exp(-share), 0.0, 0
    while total + p > total:
        total, k = total + p, k + 1
        steps.append(F.when(u >= total, 1.0).otherwise(0.0))
        p *= share / k
    return sum(steps, F.lit(0.0))


def count_cells(
    rows: DataFrame, cutter: Bucketizer, classes: int, draws: Sequence[tuple[float, bool, int] | None]
) -> DataFrame | None:
    """Cells of ``rows``, which hold the features and ``_y``: the intervals' numbers and, for every
    draw (share, put back, seed; None takes all rows), the weight ``_w0`` and the label ``_y0`` (one
    ``_y`` for classes). None where there are more than ``CELLS``."""
    keys = [*cutter.getOutputCols(), *["_y"] * (classes > 0)]
    most = math.prod(len(s) for s in cutter.getSplitsArray()) * max(classes, 1)
    cut = cutter.transform(rows)
    if most > CELLS and cut.agg(F.approx_count_distinct(F.struct(*keys)).alias("n")).first()["n"] > 1.2 * CELLS:
        return None
    drawn = cut.select(*cutter.getOutputCols(), "_y", *[F.rand(d[2]).alias(f"_u{t}") for t, d in enumerate(draws) if d])
    weight = {f"_w{t}": times_drawn(d[0], d[1], F.col(f"_u{t}")) if d else F.lit(1.0) for t, d in enumerate(draws)}
    weighed = drawn.withColumns(weight)
    sums = [F.sum(f"_w{t}").alias(f"_w{t}") for t in range(len(draws))]
    if not classes:
        sums += [(F.try_divide(F.sum(F.col(f"_w{t}") * F.col("_y")), F.sum(f"_w{t}"))).alias(f"_y{t}") for t in range(len(draws))]
    cells = written(weighed.groupBy(*keys).agg(*sums), "cells")
    return cells.coalesce(rows.sparkSession.sparkContext.defaultParallelism) if cells.count() <= CELLS else None


def fit_cells(cells: DataFrame, t: int, forest, assembler: VectorAssembler, classes: int, told: dict[str, str]):
    """The forest over the cells as draw ``t`` weighs them."""
    label = F.col("_y" if classes else f"_y{t}").alias("_y")
    some = assembler.transform(cells.where(F.col(f"_w{t}") > 0))
    # trees want as many rows as a category has values; halves of a weight add up exactly
    parts = 2 ** max(0, math.ceil(math.log2(FINEST / max(some.count(), 1))))
    some = some.withColumn("_part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    settings = {forest.getParam(k): v for k, v in (told | {"weightCol": "_w"}).items()}
    rows = some.select(told["featuresCol"], label, (F.col(f"_w{t}") / parts).alias("_w"))
    return alone(forest.fit(rows, settings | {forest.maxBins: FINEST}), cells.sparkSession)


def columns_of(d: int, vector: str, classes: int) -> dict[str, str]:
    """A forest's columns, so that its mean or its probabilities are ``_p`` and its number."""
    told = {"featuresCol": vector, "labelCol": "_y", "predictionCol": f"_p{d}"}
    if classes:
        told |= {"predictionCol": f"_c{d}", "probabilityCol": f"_p{d}", "rawPredictionCol": f"_r{d}"}
    return told


def cut_evenly(rows: DataFrame, features: Sequence[str]) -> list[list[float]] | None:
    """Ascending cut points with open ends: between all values of a feature that has few, else
    between ``BINS`` parts of about as many rows. None where a value is missing."""
    facts = [F.approx_count_distinct(col(f)).alias(f"d{i}") for i, f in enumerate(features)]
    gaps = [F.count_if(col(f).isNull() | F.isnan(col(f))).alias(f"g{i}") for i, f in enumerate(features)]
    row = rows.agg(*facts, *gaps).first()
    if any(row[f"g{i}"] for i in range(len(features))):
        return None
    few = [row[f"d{i}"] <= BINS for i in range(len(features))]
    shares = [k / BINS for k in range(1, BINS)]
    told = rows.agg(*[(F.collect_set(col(f)) if few[i] else F.percentile_approx(col(f), shares)).alias(f"v{i}") for i, f in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        values = sorted(set(told[f"v{i}"]))
        inner = [(a + b) / 2 for a, b in zip(values, values[1:])] if few[i] else values
        out.append([-math.inf, *sorted(set(inner or values)), math.inf])
    return out


def fit_bags(rows: DataFrame, features: Sequence[str], forest, facts: Facts) -> PipelineModel | None:
    """The trees of ``forest``, a model each, over cells; None where rows are few or cells many."""
    trees = forest.getNumTrees()
    if facts.rows <= CELLS or trees > TREES:
        return None
    splits = cut_evenly(rows, features)
    if splits is None:
        return None
    names = [f"_i{i}" for i in range(len(features))]
    cutter = Bucketizer(inputCols=list(features), outputCols=names, splitsArray=splits, handleInvalid="error")
    share, replace, seed = forest.getSubsamplingRate(), forest.getBootstrap(), forest.getSeed()
    draws = [(share, replace, seed + t) if replace or share < 1 else None for t in range(trees)]
    cells = count_cells(rows, cutter, facts.classes, draws)
    if cells is None:
        return None
    # their numbers as numbers: trees would take them for categories
    cells = cells.select(*[(F.col(n) + 0.0 if n in names else F.col(n)).alias(n) for n in cells.columns])
    assembler, models = VectorAssembler(inputCols=names, outputCol="_v"), []
    for t in range(trees):
        one = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.subsamplingRate: 1.0, forest.seed: seed + t})
        models.append(fit_cells(cells, t, one, assembler, facts.classes, columns_of(t, "_v", facts.classes)))
    return PipelineModel([cutter, assembler, *models])
