"""Metrics as DataFrames, from grouped counts; optional ``by`` column for several tables at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.session import written

CUT_SCORES = 100_000


def _grouping(by: str | None) -> Column:
    return (F.lit("all") if by is None else col(by)).alias("by")


def pair_counts(df: DataFrame, actual: str, predicted: str, by: str | None = None) -> DataFrame:
    """``by, actual, predicted, n``: everything the class metrics need."""
    rows = df.select(_grouping(by), col(actual).alias("actual"), col(predicted).alias("predicted"))
    return rows.groupBy("by", "actual", "predicted").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``actual, predicted, n`` over every pair of labels seen on either side."""
    counts = pair_counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).agg(
        F.sort_array(F.collect_set("l")).alias("labels")
    )
    grid = labels.select("labels", F.explode("labels").alias("actual"))
    grid = grid.select("actual", F.explode("labels").alias("predicted"))
    zero = grid.withColumn("n", F.lit(0).cast("bigint"))
    both = counts.select("actual", "predicted", "n").unionByName(zero)
    return both.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str, by: str | None = None) -> DataFrame:
    """``by, accuracy, f1, precision, recall``, weighted by class support; 0 where undefined."""
    counts = pair_counts(df, actual, predicted, by)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    rows = counts.select(
        "by",
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("named"), hit.alias("tp")),
                F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("named"), zero.alias("tp")),
            )
        ),
    )
    per_class = rows.groupBy("by", "label").agg(
        F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("tp").alias("tp")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, named, support = F.col("tp"), F.col("named"), F.col("support")
    f1 = ratio(2 * tp, named + support)
    total = F.sum("support")
    return per_class.groupBy("by").agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(f1 * support) / total).alias("f1"),
        (F.sum(ratio(tp, named) * support) / total).alias("precision"),
        (F.sum(ratio(tp, support) * support) / total).alias("recall"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: str | None = None) -> DataFrame:
    """``by, mse, rmse, mae, r2``."""
    rows = df.select(
        _grouping(by), col(actual).cast("double").alias("y"), col(predicted).cast("double").alias("p")
    )
    e = F.col("y") - F.col("p")
    sums = rows.groupBy("by").agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("spread")
    )
    r2 = F.when(F.col("spread") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.col("mse") / F.col("spread")
    )
    return sums.select("by", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def roc_auc(
    df: DataFrame, actual: str, score: str, positive=1, by: str | None = None
) -> DataFrame:
    """``by, roc_auc``: share of (positive, negative) pairs in the right order, ties half.

    Rows are first merged per score. The scores are then dealt into ranges of about
    ``CUT_SCORES``, as many as it takes; running counts are taken inside a range, and the
    ranges' totals, one row each, are put together at the end. NULL when only one class is present.
    """
    rows = df.select(
        _grouping(by),
        col(score).cast("double").alias("s"),
        F.coalesce((col(actual) == F.lit(positive)), F.lit(False)).cast("bigint").alias("pos"),
    )
    return _auc(rows)


def _auc(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("s").isNotNull())
    merged = rows.groupBy("by", "s").agg(
        F.sum("pos").alias("pos"), (F.count("*") - F.sum("pos")).alias("neg")
    )
    different = rows.agg(F.approx_count_distinct(F.struct("by", "s")).alias("n")).first()["n"]
    cuts = -(-different // CUT_SCORES)
    if cuts > 1:
        # written, so that a range's number is the same wherever it is read
        ranged = merged.repartitionByRange(cuts, "by", "s").withColumn("cut", F.spark_partition_id())
        cut = written(ranged, "scores")
    else:
        cut = merged.withColumn("cut", F.lit(0))
    before = W.partitionBy("by", "cut").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    ranked = cut.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    inner = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    totals = ranked.groupBy("by", "cut").agg(
        inner.alias("inner"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # one row per range
    lower = F.sum("neg").over(W.partitionBy("by").orderBy("cut").rowsBetween(W.unboundedPreceding, -1))
    won = totals.withColumn("won", F.col("inner") + F.col("pos") * F.coalesce(lower, F.lit(0)).cast("double"))
    sums = won.groupBy("by").agg(
        F.sum("won").alias("won"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n")
    )
    return sums.select("by", F.try_divide("won", F.col("p") * F.col("n")).alias("roc_auc"))


def roc_auc_weighted(
    df: DataFrame, actual: str, probabilities: str, classes: Sequence, by: str | None = None
) -> DataFrame:
    """One class against the rest for every class, averaged by class support."""
    cells = [
        F.struct(
            F.lit(i).alias("class"),
            col(probabilities)[i].cast("double").alias("s"),
            F.coalesce((col(actual) == F.lit(c)), F.lit(False)).cast("bigint").alias("pos"),
        )
        for i, c in enumerate(classes)
    ]
    rows = df.select(_grouping(by).alias("outer"), F.inline(F.array(*cells)))
    keyed = rows.select(F.struct("outer", "class").alias("by"), "s", "pos")
    support = keyed.groupBy("by").agg(F.sum("pos").cast("double").alias("w"))
    joined = _auc(keyed).join(support, "by")
    valid = F.count_if(F.col("roc_auc").isNull()) == 0
    mean = F.sum(F.col("roc_auc") * F.col("w")) / F.sum("w")
    found = joined.groupBy(F.col("by.outer").alias("outer")).agg(F.when(valid, mean).alias("roc_auc"))
    return found.select(F.col("outer").alias("by"), "roc_auc")


def evaluate(
    df: DataFrame, task: str, actual: str, predicted: str, by: str | None = None
) -> DataFrame:
    """``split, metric, value`` for every value of ``by``; one grouped pass."""
    if task == "classification":
        wide = class_metrics(df, actual, predicted, by)
    elif task == "regression":
        wide = regression_metrics(df, actual, predicted, by)
    else:
        raise ValueError(f"Unknown task: {task!r}")
    names = [c for c in wide.columns if c != "by"]
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return wide.select(F.col("by").alias("split"), F.inline(F.array(*cells)))
