"""Exact quantiles of any table size.

The built-in exact percentile keeps a value -> count map for the whole column in one
task, so it is used only below a row count that was measured first. Above it, a sketch
brackets each wanted rank, one aggregate counts the rows below and on the bracket's
edges, and only the rows strictly inside are looked at again. Every round divides what
is left by thousands, all columns share the scans, and what reaches the driver is
bounded. A value that fills a third of the table ends up as an edge, never as a group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col

IN_ONE_TASK = 100_000
ON_DRIVER = 100_000
SKETCH = 10_000
GAPS_PER_SCAN = 24


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    approx: bool = False,
    in_one_task: int = IN_ONE_TASK,
    on_driver: int = ON_DRIVER,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, NULLs left out; ``None`` for an empty column."""
    names = [name for name, probs in wanted.items() if len(probs)]
    if not names:
        return {name: [] for name in wanted}
    if approx:
        return _one_aggregate(
            df,
            {n: wanted[n] for n in names},
            lambda c, probs: F.percentile_approx(c, list(probs), SKETCH),
        )
    counts = df.agg(*[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    sizes = {n: counts[f"n{i}"] for i, n in enumerate(names)}
    result: dict[str, list[float | None]] = {name: [] for name in wanted}
    small = {n: wanted[n] for n in names if sizes[n] <= in_one_task}
    if small:
        result.update(_one_aggregate(df, small, _percentile))
    large = {n: sizes[n] for n in names if n not in small}
    if large:
        ranks = {n: sorted({r for p in wanted[n] for r in _ends(p, large[n])}) for n in large}
        found = ranked_values(df, ranks, large, on_driver)
        for n, size in large.items():
            result[n] = [_between(p * (size - 1), found[n]) for p in wanted[n]]
    return result


def _percentile(c: Column, probs: Sequence[float]) -> Column:
    return F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))


def _one_aggregate(df: DataFrame, wanted: Mapping[str, Sequence[float]], function) -> dict:
    row = df.agg(
        *[
            function(col(n).cast("double"), probs).alias(f"q{i}")
            for i, (n, probs) in enumerate(wanted.items())
        ]
    ).first()
    return {n: list(row[f"q{i}"] or [None] * len(p)) for i, (n, p) in enumerate(wanted.items())}


def _ends(prob: float, size: int) -> tuple[int, int]:
    return math.floor(prob * (size - 1)), math.ceil(prob * (size - 1))


def _between(place: float, values: Mapping[int, float]) -> float:
    low, high = math.floor(place), math.ceil(place)
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - place) * values[low] + (place - low) * values[high]


@dataclass
class _Gap:
    """The open interval (low, high) of a column that still hides some wanted ranks."""

    name: str
    low: float | None
    high: float | None
    before: int
    inside: int
    ranks: list[int]
    marks: list[float] = field(default_factory=list)

    def holds(self) -> Column:
        c = col(self.name).cast("double")
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c > F.lit(self.low))
        if self.high is not None:
            test = test & (c < F.lit(self.high))
        return test

    def probs(self) -> list[float]:
        reach, last = 2.0 / SKETCH, max(self.inside - 1, 1)
        out = {0.0, 1.0}
        for rank in self.ranks:
            share = (rank - self.before) / last
            out.update((max(share - reach, 0.0), min(share + reach, 1.0)))
        return sorted(out)


def ranked_values(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int],
    on_driver: int = ON_DRIVER,
) -> dict[str, dict[int, float]]:
    """The values at 0-based ``ranks`` of each column in ascending order, NULLs left out."""
    found: dict[str, dict[int, float]] = {n: {} for n in ranks}
    gaps = [_Gap(n, None, None, 0, sizes[n], list(r)) for n, r in ranks.items() if r]
    while gaps:
        read = [g for g in gaps if g.inside <= on_driver]
        for name in dict.fromkeys(g.name for g in read):
            _read_values(df, [g for g in read if g.name == name], found[name])
        wide = [g for g in gaps if g.inside > on_driver]
        gaps = []
        for start in range(0, len(wide), GAPS_PER_SCAN):
            gaps += _narrow(df, wide[start : start + GAPS_PER_SCAN], found)
    return found


def _read_values(df: DataFrame, gaps: list[_Gap], found: dict[int, float]) -> None:
    test = gaps[0].holds()
    for gap in gaps[1:]:
        test = test | gap.holds()
    values = df.where(test).select(col(gaps[0].name).cast("double").alias("v"))
    counted = sorted(
        (r["v"], r["n"]) for r in values.groupBy("v").agg(F.count("*").alias("n")).collect()
    )
    for gap in gaps:
        wanted, seen = list(gap.ranks), gap.before
        for value, n in counted:
            if (gap.low is None or value > gap.low) and (gap.high is None or value < gap.high):
                while wanted and wanted[0] < seen + n:
                    found[wanted.pop(0)] = value
                seen += n


def _narrow(df: DataFrame, gaps: list[_Gap], found: dict[str, dict[int, float]]) -> list[_Gap]:
    cell = [F.when(g.holds(), col(g.name).cast("double")) for g in gaps]
    row = df.agg(
        *[F.percentile_approx(cell[i], g.probs(), SKETCH).alias(f"m{i}") for i, g in enumerate(gaps)]
    ).first()
    for i, gap in enumerate(gaps):
        gap.marks = sorted(set(row[f"m{i}"]))
    tally = df.agg(
        *[
            test.alias(f"{kind}{i}_{j}")
            for i, g in enumerate(gaps)
            for j, m in enumerate(g.marks)
            for kind, test in (
                ("b", F.count_if(cell[i] < F.lit(m))),
                ("e", F.count_if(cell[i] == F.lit(m))),
            )
        ]
    ).first()
    following = []
    for i, gap in enumerate(gaps):
        below = [gap.before + tally[f"b{i}_{j}"] for j in range(len(gap.marks))]
        upto = [b + tally[f"e{i}_{j}"] for j, b in enumerate(below)]
        left = list(gap.ranks)
        for mark, start, stop in zip(gap.marks, below, upto):
            hit = [r for r in left if start <= r < stop]
            found[gap.name].update(dict.fromkeys(hit, mark))
            left = [r for r in left if r not in hit]
        starts = [(gap.low, gap.before), *zip(gap.marks, upto)]
        stops = [*zip(gap.marks, below), (gap.high, gap.before + gap.inside)]
        for (low, start), (high, stop) in zip(starts, stops):
            mine = [r for r in left if start <= r < stop]
            if mine:
                following.append(_Gap(gap.name, low, high, start, stop - start, mine))
    return following
