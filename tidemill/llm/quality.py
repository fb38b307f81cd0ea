"""Quality rules: robust multivariate outliers by the minimum covariance determinant.

Every document has a vector of transformed statistics. Per language and source, the half of
the documents that lie closest together (the share is a parameter) gives a mean and a
covariance that outliers cannot pull, found by concentration steps: measure all distances,
keep the closest share, estimate again. The steps begin from several starts, and the one
with the smallest determinant goes on. Documents far away by the robust Mahalanobis distance are
rejected. All steps are aggregates over a narrow table of statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import WORD, keep, let

FEATURES = ("x0", "x1", "x2", "x3", "x4")
DIMENSIONS = len(FEATURES)
BINS = 32  # per doubling of a distance
STARTS = 3
KEYS = ("level", "lang", "source", "start")


def chi_square(x: float, degrees: int) -> float:
    """Share of a chi-square distribution below ``x``."""
    k = 2 - degrees % 2
    share = math.erf(math.sqrt(x / 2)) if k == 1 else 1 - math.exp(-x / 2)
    while k < degrees:
        share -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
        k += 2
    return share


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return low


@dataclass(frozen=True)
class McdPlan:
    """``share`` of a group is the core. Distances beyond those of all but ``tail`` of a normal
    group are rejected. ``floor``: standard deviations that are added, so that a statistic that
    hardly varies rejects nobody for a trifle; they are set so that labelled clean texts stay.
    All ``STARTS`` make ``first_steps``, the best one ``steps`` more. Groups of fewer than
    ``min_group`` documents use their language's estimate, or that of all."""

    share: float = 0.55
    tail: float = 1e-5
    floor: tuple[float, ...] = (0.5, 0.5, 0.1, 0.15, 0.15)
    first_steps: int = 2
    steps: int = 3
    min_group: int = 100
    min_words: int = 50
    max_repeat_percent: int = 50

    @property
    def consistency(self) -> float:
        """By what the core's covariance falls short of that of its normal group."""
        edge = chi_square_quantile(self.share, DIMENSIONS)
        return self.share / chi_square(edge, DIMENSIONS + 2)

    @property
    def cutoff(self) -> float:
        return chi_square_quantile(1 - self.tail, DIMENSIONS)


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are compared by a 64-bit hash, within one text only. Most texts repeat none and
    are done after one pass; else windows are sorted by hash, and those beside an equal one
    are marked.
    """
    n = F.size(words)

    def count(hashes: Column) -> Column:
        # equal neighbours in sorted order are the repeated windows
        def marked(s: Column) -> Column:
            equal = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            hit = F.filter(s, lambda x, i: F.coalesce(equal(x, i), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(placed), marked))

    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n >= 4, let(windows, count)).otherwise(0)


def statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*columns, text.alias("_t"))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(WORD))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r")
        ),
    )
    rows = rows.select(
        *columns,
        counts.alias("_c"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
    )
    return rows.select(
        *columns,
        F.col("_c.n").cast("long").alias("n_words"),
        F.col("_c.c").cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("_c.r").cast("long").alias("n_repeat_words"),
        "n_lines",
    )


def features() -> dict[str, Column]:
    """The vector: length and word length, and roots of the shares of symbols, repeated lines
    and repeated words, which even out their long tails."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return {
        "x0": F.log(n),
        "x1": F.col("word_chars") / n,
        "x2": F.sqrt(F.col("n_symbols") / n),
        "x3": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "x4": F.sqrt(F.col("n_repeat_words") / n),
    }


def _inverse(flat: Column) -> Column:
    """Inverse of a positive definite matrix (an array, row by row) by elimination."""
    p = DIMENSIONS
    wide = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(p - 1)),
            lambda i: F.concat(
                F.slice(flat, i * p + 1, F.lit(p)),
                F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: (i == j).cast("double")),
            ),
        )
    )

    def eliminate(m: Column, k: Column) -> Column:
        def cell(value: Column, at: Column) -> Column:
            i, j = F.floor(at / (2 * p)), F.pmod(at, F.lit(2 * p))
            pivot, top = F.get(m, k * 2 * p + k), F.get(m, k * 2 * p + j)
            return F.when(i == k, value / pivot).otherwise(value - F.get(m, (i * 2 * p + k).cast("int")) * top / pivot)

        return F.transform(m, cell)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), wide, eliminate)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.slice(done, i * 2 * p + p + 1, F.lit(p))
        )
    )


def _determinant(flat: Column) -> Column:
    """Determinant of a positive definite matrix: the product of its pivots."""
    p = DIMENSIONS

    def step(state: Column, k: Column) -> Column:
        m = state["m"]
        pivot = F.get(m, k * p + k)

        def cell(value: Column, at: Column) -> Column:
            i, j = F.floor(at / p).cast("int"), F.pmod(at, F.lit(p))
            return F.when(i > k, value - F.get(m, i * p + k) * F.get(m, k * p + j) / pivot).otherwise(value)

        return F.struct(F.transform(m, cell).alias("m"), (state["d"] * pivot).alias("d"))

    start = F.struct(flat.alias("m"), F.lit(1.0).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, step, lambda s: s["d"])


def _first_distance() -> Column:
    """Distances that the starts begin with, from values over their median deviation: the sum
    of squares, the sum of absolute values, the largest one."""
    z2 = [(F.col(x) - F.get("mean", F.lit(i))) ** 2 * F.get("inverse", F.lit(i * DIMENSIONS + i)) for i, x in enumerate(FEATURES)]
    sums = [sum(z2, F.lit(0.0)), sum([F.sqrt(z) for z in z2], F.lit(0.0)), F.greatest(*z2)]
    return F.when(F.col("start") == 0, sums[0]).when(F.col("start") == 1, sums[1]).otherwise(sums[2])


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector to ``mean`` by ``inverse``."""
    gap = [F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        for j in range(DIMENSIONS):
            total = total + F.get("inverse", F.lit(i * DIMENSIONS + j)) * gap[i] * gap[j]
    return F.greatest(total, F.lit(0.0))


def _moments(rows: DataFrame, plan: McdPlan, factor: float) -> DataFrame:
    """Per group: number, mean, and the inverse of the covariance with the floor added."""
    xs = [F.col(x) for x in FEATURES]
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    # features are small numbers near their mean, so plain second moments are exact enough
    sums += [F.avg(xs[i] * xs[j]).alias(f"s{i}{j}") for i, j in pairs]
    made = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), *sums)
    cov = []
    for i in range(DIMENSIONS):
        for j in range(DIMENSIONS):
            a, b = min(i, j), max(i, j)
            extra = plan.floor[i] ** 2 if i == j else 0.0
            cov.append(factor * (F.col(f"s{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}")) + extra)
    made = made.select(
        *KEYS, "n", F.array(*[F.col(f"m{i}") for i in range(DIMENSIONS)]).alias("mean"), F.array(*cov).alias("cov")
    )
    return made.withColumns({"inverse": _inverse(F.col("cov")), "determinant": _determinant(F.col("cov"))}).drop("cov")


def _with(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows beside their group's estimate; Spark broadcasts the groups if they are few, and
    splits a hot group if they are not."""
    rest = [c for c in ("start", "mean", "inverse") if c in groups.columns]
    g = groups.select(*[F.col(c).alias(f"_{c}") for c in ("level", "lang", "source")], *rest)
    match = (F.col("level") == F.col("_level")) & F.col("lang").eqNullSafe(F.col("_lang"))
    match = match & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(g, match).drop("_level", "_lang", "_source")


def estimate(rows: DataFrame, plan: McdPlan) -> DataFrame:
    """``level, lang, source, n, mean, inverse``: the estimate of each language and source
    (level 2), each language (1) and of all (0), from ``rows`` with ``x0`` to ``x4``."""
    null = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), null.alias("source")),
        F.struct(F.lit(0).alias("level"), null.alias("lang"), null.alias("source")),
    )
    each = keep(rows.select(*FEATURES, F.inline(levels)), "vectors")
    # start: medians and median deviations, which take half of the rows being bad
    keys = ["level", "lang", "source"]
    centre = each.groupBy(*keys).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"c{i}") for i, x in enumerate(FEATURES)])
    centre = centre.select(
        *keys, F.array(*[F.col(f"c{i}") for i in range(DIMENSIONS)]).alias("mean"),
        F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)]).alias("inverse"),
    )
    off = _with(each, centre)
    wide = off.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        *[
            F.percentile_approx(F.abs(F.col(x) - F.get("mean", F.lit(i))), 0.5, 1000).alias(f"d{i}")
            for i, x in enumerate(FEATURES)
        ],
    )
    scale = [1.0 / ((1.4826 * F.col(f"d{i}")) ** 2 + plan.floor[i] ** 2) for i in range(DIMENSIONS)]
    starts = F.explode(F.array(*[F.lit(i) for i in range(STARTS)]))
    groups = keep(
        wide.select(
            *keys, "mean",
            F.array(*[scale[i] if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)]).alias("inverse"),
            starts.alias("start"),
        ),
        "groups",
    )
    groups = _concentrate(each, groups, _first_distance(), plan)
    for _ in range(plan.first_steps):
        groups = _concentrate(each, groups, _distance(), plan)
    best = F.min_by(F.struct("start", "mean", "inverse"), F.struct("determinant", "start"))
    groups = groups.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
    for _ in range(plan.steps):
        groups = _concentrate(each, groups, _distance(), plan)
    return groups


def _concentrate(each: DataFrame, groups: DataFrame, distance: Column, plan: McdPlan) -> DataFrame:
    """Estimates from the share of each group that lies closest by the estimate so far.

    The distance below which a share of the group lies is found on a fine scale by exact
    counts, so the core is the same under any partitioning.
    """
    near = _with(each, groups).withColumn("_d", distance)
    near = near.withColumn("_bin", F.ceil(F.log2(F.col("_d") + 2.0**-20) * BINS).cast("int"))
    counts = near.groupBy(*KEYS, "_bin").agg(F.count("*").alias("_n"))
    upto, whole = Window.partitionBy(*KEYS).orderBy("_bin"), Window.partitionBy(*KEYS)
    reached = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole)})
    cuts = reached.where(F.col("_upto") >= plan.share * F.col("_all")).groupBy(*KEYS).agg(F.min("_bin").alias("_cut"))
    cuts = cuts.select(*[F.col(c).alias(f"_{c}") for c in KEYS], "_cut")
    match = (F.col("level") == F.col("_level")) & (F.col("start") == F.col("_start"))
    match = match & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    core = near.join(cuts, match).where(F.col("_bin") <= F.col("_cut"))
    return keep(_moments(core, plan, plan.consistency), "groups")


def judge(docs: DataFrame, plan: McdPlan = McdPlan()) -> DataFrame:
    """Per row: ``doc_id, lang, source``, the statistics, ``base_failed, distance, kept``.

    ``base_failed``: too few words, or more than half of them in repeated windows. The
    covariances come from the documents that pass. A NULL text has no words and fails; NULL
    languages and sources are groups; repeated rows each count; no rows give none. Columns
    other than doc_id, text, lang and source are ignored.
    """
    stats = statistics(docs, ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < plan.min_words) | (
        100 * F.col("n_repeat_words") > plan.max_repeat_percent * F.col("n_words")
    )
    rows = keep(stats.withColumns({"base_failed": failed, **features()}), "statistics")
    groups = estimate(rows.where("NOT base_failed"), plan)
    # the finest estimate with enough documents behind it (the core is a share of them)
    enough = groups.where((F.col("level") == 0) | (F.col("n") >= plan.share * plan.min_group))
    top = F.struct("level", "mean", "inverse")
    fine, mid, base = (enough.where(F.col("level") == k) for k in (2, 1, 0))
    fine = fine.select(F.col("lang").alias("_l2"), F.col("source").alias("_s2"), top.alias("_g2"))
    mid = mid.select(F.col("lang").alias("_l1"), top.alias("_g1"))
    base = base.select(F.lit(True).alias("_on"), top.alias("_g0"))
    out = rows.join(fine, F.col("lang").eqNullSafe(F.col("_l2")) & F.col("source").eqNullSafe(F.col("_s2")), "left")
    out = out.join(mid, F.col("lang").eqNullSafe(F.col("_l1")), "left")
    out = out.join(F.broadcast(base), F.col("_on"), "left")  # one row
    out = out.withColumn("_g", F.coalesce("_g2", "_g1", "_g0"))
    out = out.withColumns({"mean": F.col("_g.mean"), "inverse": F.col("_g.inverse")})
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance",
        F.coalesce(~F.col("base_failed") & (F.col("distance") <= plan.cutoff), F.lit(False)).alias("kept"),
    )


def run(spark, sf: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf}/documents.parquet")).drop("lang", "source")
