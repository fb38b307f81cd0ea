"""Dropping, renaming, filtering, de-duplicating, ordering and sampling rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import as_list, col, free_name, require_columns
from tidemill.functions.predicate import build_filter
from tidemill.functions.ranking import HashOrder, repeat_rows, row_hash


def drop_columns(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    columns = as_list(columns)
    require_columns(df, columns)
    return df.select(*[col(c) for c in df.columns if c not in set(columns)])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """All names change at once, so two columns can swap theirs."""
    require_columns(df, list(mapping))
    return df.select(*[col(c).alias(mapping.get(c, c)) for c in df.columns])


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    return df.where(build_filter(df, expression))


def drop_missing_rows(
    df: DataFrame, columns: Sequence[str] | None = None, how: str = "any"
) -> DataFrame:
    if how not in ("any", "all"):
        raise ValueError(f"invalid how option: {how}")
    names = df.columns if columns is None else as_list(columns)
    require_columns(df, names)
    if not names:
        return df
    test = None
    for name in names:
        present = col(name).isNotNull()
        test = present if test is None else (test & present if how == "any" else test | present)
    return df.where(test)


def drop_duplicates(
    df: DataFrame, subset: str | Sequence[str] | None = None, key: Sequence[str] | None = None
) -> DataFrame:
    """One row per distinct ``subset``: the first in ``key`` order (all columns without one).

    A grouped minimum rather than a window: each task first reduces its own rows, so a
    value that fills a third of the table is not sorted in one place.
    """
    if subset is None:
        return df.dropDuplicates()
    subset = as_list(subset)
    require_columns(df, subset)
    order = list(key) if key is not None else df.columns
    require_columns(df, order)
    rest = [c for c in df.columns if c not in set(subset)]
    if not rest:
        return df.select(*[col(c) for c in subset]).dropDuplicates().select(*[col(c) for c in df.columns])
    # the order columns come first; the rest only rides along
    lead = [c for c in order if c not in set(subset)]
    tail = [c for c in rest if c not in set(lead)]
    first = free_name(df, "_first")
    packed = F.struct(*[col(c).alias(f"f{i}") for i, c in enumerate([*lead, *tail])])
    kept = df.groupBy(*[col(c) for c in subset]).agg(F.min(packed).alias(first))
    place = {c: f"{first}.f{i}" for i, c in enumerate([*lead, *tail])}
    return kept.select(*[F.col(place[c]).alias(c) if c in place else col(c) for c in df.columns])


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns that hold no value at all."""
    gone = empty_columns(df, keep)
    return df.select(*[col(c) for c in df.columns if c not in set(gone)])


def empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    names = [c for c in df.columns if c not in set(keep)]
    if not names:
        return []
    row = df.agg(*[F.max(col(c).isNotNull()).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if not row[f"c{i}"]]


def shuffle(
    df: DataFrame, random_state: int = 42, key: Sequence[str] | None = None
) -> DataFrame:
    """A repeatable permutation: a range-partitioned sort by the row hash.

    Without a key, equal rows are told apart by a copy number, so that a row repeated
    very often is spread over the order (and over the tasks) instead of lying together.
    """
    order = free_name(df, "_order")
    if key is not None:
        require_columns(df, list(key))
        ranked = df.withColumn(order, row_hash(list(key), random_state))
        return ranked.orderBy(order, *[col(c) for c in key]).drop(order)
    count, copy = free_name(df, "_count"), free_name(df, "_number")
    merged = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias(count))
    numbered = repeat_rows(merged, F.col(count), copy)
    ranked = numbered.withColumn(order, row_hash([*df.columns, copy], random_state))
    return ranked.orderBy(order, copy).select(*[col(c) for c in df.columns])


def sample_rows(
    df: DataFrame,
    n: int | None = None,
    frac: float | None = None,
    random_state: int = 42,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Exactly ``n`` rows, or ``round(frac * rows)`` with halves to even."""
    if n is None and frac is None:
        raise ValueError("say how many rows to take: n, or frac of the table")
    if n is not None and frac is not None:
        raise ValueError("n and frac contradict each other; give one")
    if n is not None and n < 0 or frac is not None and frac < 0:
        raise ValueError("a sample cannot have fewer than no rows")
    if frac is not None and frac > 1:
        raise ValueError("frac above 1 needs sampling with replacement.")
    order = HashOrder(df, key, random_state)
    total = order.totals()[""]
    size = n if n is not None else round(frac * total)
    if size > total:
        raise ValueError(f"Cannot take {size} rows from a table of {total}.")
    if size == total:
        return df
    part = free_name(df, "_part")
    return order.deal({"": [size, total - size]}, part).where(F.col(part) == 0).drop(part)


def head(df: DataFrame, n: int = 20, key: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows in ``key`` order."""
    if n < 1:
        raise ValueError("head needs at least one row")
    names = list(key) if key is not None else df.columns
    require_columns(df, names)
    return df.orderBy(*[col(c) for c in names]).limit(n)


def stride_sample(
    df: DataFrame, points: int = 300, random_state: int = 42, key: Sequence[str] | None = None
) -> DataFrame:
    """Every k-th row of the repeatable random order, k = rows // points; all rows of a
    table that is not longer than ``points``."""
    order = HashOrder(df, key, random_state)
    total = order.totals()[""]
    if total <= points:
        return df
    return order.at(range(0, total, max(total // points, 1)))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
