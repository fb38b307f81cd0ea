"""Stratified splits and folds for any number of strata.

The quotas of all strata are a table: whole parts by arithmetic, what is left over to the
largest remainders, which are numbered range by range. Rows then take their place in their
stratum's hash order and look their part up. Strata of more than ``LARGE`` rows are cut at
places instead (see ``ranking``), so that no stratum has to be ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.columns import col, free_name
from tidemill.functions.ranking import HashOrder, row_hash
from tidemill.operators.codes import number_in_order
from tidemill.session import written

LARGE = 1_000_000
WIDE = "decimal(38,0)"


def count_strata(df: DataFrame, target: str) -> DataFrame:
    """``g, n``: rows of every stratum, by the target as text."""
    return written(df.groupBy(col(target).cast("string").alias("g")).agg(F.count("*").alias("n")), "strata")


def with_quotas(counts: DataFrame, size: str, draws: int, name: str) -> DataFrame:
    """``draws`` rows over the strata in proportion to ``size``, by largest remainder; equal
    remainders go to the smaller value, a missing one comes last."""
    total = counts.agg(F.sum(size)).first()[0] or 0
    if draws == 0 or total == 0:
        return counts.withColumn(name, F.lit(0).cast("bigint"))
    exact = F.col(size).cast(WIDE) * F.lit(draws).cast("decimal(19,0)")
    whole = F.expr(f"CAST(CAST({size} AS DECIMAL(19,0)) * CAST({draws} AS DECIMAL(19,0)) AS {WIDE}) div {total}")
    rest = (exact - whole.cast(WIDE) * F.lit(total).cast("decimal(19,0)")).cast("bigint")
    base = counts.withColumns({"_whole": whole.cast("bigint"), "_rest": -rest, "_null": F.col("g").isNull()})
    left = draws - base.agg(F.sum("_whole")).first()[0]
    ranked = number_in_order(base, ["_rest", "_null", "g"], "_rank")
    quota = F.col("_whole") + (F.col("_rank") < left).cast("bigint")
    return ranked.withColumn(name, quota).drop("_whole", "_rest", "_null", "_rank")


def split_quotas(counts: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``g, n, ends``: for each stratum, where train and validation end in its order."""
    train, validation, _ = sizes
    first = with_quotas(counts, "n", train, "a").withColumn("held", F.col("n") - F.col("a"))
    both = with_quotas(first, "held", validation, "b")
    return both.select("g", "n", F.array(F.col("a"), F.col("a") + F.col("b")).alias("ends"))


def fold_ends(counts: DataFrame, folds: int) -> DataFrame:
    """``g, n, ends``: the extra rows of each stratum go on where the one before it stopped."""
    extra = F.col("n") % folds
    named = counts.withColumn("_null", F.col("g").isNull())
    placed = number_in_order(named, ["_null", "g"], "before", extra)
    start, base = F.col("before") % folds, F.floor(F.col("n") / folds)

    def end(f: int) -> Column:
        ahead = F.greatest(F.least(start + extra, F.lit(f + 1)) - start, F.lit(0))
        around = F.greatest(F.least(start + extra - folds, F.lit(f + 1)), F.lit(0))
        return (f + 1) * base + ahead + around

    return placed.select("g", "n", F.array(*[end(f).cast("bigint") for f in range(folds - 1)]).alias("ends"))


def deal(df: DataFrame, target: str, quotas: DataFrame, key: Sequence[str] | None, seed: int, part: str) -> DataFrame:
    """The rows of each stratum, in hash order, numbered by part: those before ``ends[0]`` get
    0, those before ``ends[1]`` 1, and so on."""
    quotas = written(quotas, "quotas")
    columns = df.columns
    g, n, ends, h = (free_name(df, c) for c in ("_g", "_n", "_ends", "_h"))
    told = quotas.select(F.col("g").alias(g), F.col("n").alias(n), F.col("ends").alias(ends))
    text = col(target).cast("string")
    large = told.where(F.col(n) > LARGE)
    few = large.collect()  # one row per LARGE rows of the table at most
    sought = df
    if few:
        sought = df.join(F.broadcast(large.select(g)), text.eqNullSafe(F.col(g)), "left_anti")
    order = Window.partitionBy(g).orderBy(h)
    placed = sought.join(told, text.eqNullSafe(F.col(g))).withColumn(h, row_hash(key or columns, seed))
    place = (F.row_number().over(order) - 1).cast("bigint")
    number = F.size(F.filter(F.col(ends), lambda e: e <= F.col(h)))
    dealt = placed.withColumn(h, place).withColumn(part, number).select(*[col(c) for c in columns], part)
    if few:
        hot = df.join(F.broadcast(large.select(g)), text.eqNullSafe(F.col(g)), "left_semi")
        sizes = {r[g]: [b - a for a, b in zip([0, *r[ends]], [*r[ends], r[n]])] for r in few}
        dealt = dealt.unionByName(HashOrder(hot, key, seed).deal(sizes, part, target))
    return dealt
