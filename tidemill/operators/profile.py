"""Column profiles as DataFrames.

Numeric summaries of all columns come from one aggregate. Distinct counts, modes and
top values come from one grouped count over (column, value) pairs: rows are reduced
before the shuffle, and no task ever holds all values of a column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, is_number, require_columns, type_of
from tidemill.functions.numbers import percent
from tidemill.functions.order_stats import exact_quantiles

CLASSES_SHOWN = 32
MAX_VALUES = 10_000
# Columns taken as the target when none is named, in this order.
TARGET_NAMES = ["target", "label", "class", "y"]


def _family(kind: T.DataType) -> str | None:
    """The widest type in which values of ``kind`` can be counted together."""
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return kind.simpleString().split("(")[0].split(" ")[0]
    return kind.simpleString()


def value_counts(df: DataFrame, columns: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """``place, value, n`` of all non-missing values, one DataFrame per value type; with
    the columns of that type, to which ``place`` points."""
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(type_of(df, c)), []).append(c)
    out = []
    for family, names in families.items():
        cells = []
        for i, name in enumerate(names):
            value = col(name).cast(family) if family in ("bigint", "double", "string") else col(name)
            cells.append(F.struct(F.lit(i).alias("place"), value.alias("value")))
        if len(cells) > 1:
            pairs = df.select(F.inline(F.array(*cells)))
        else:  # nothing to unpivot: a plain projection
            pairs = df.select(F.lit(0).alias("place"), cells[0]["value"].alias("value"))
        counts = pairs.where(F.col("value").isNotNull()).groupBy("place", "value")
        out.append((names, counts.agg(F.count("*").alias("n"))))
    return out


def _per_place(counts: DataFrame, aggregates: list[Column]) -> DataFrame:
    """One row per column from an aggregate without grouping: each task reads its part of
    the counts once and sorts nothing."""
    wide = counts.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)])
    return wide.select(F.inline(F.array(*[F.col(f"a{i}") for i in range(len(aggregates))])))


def _best(place: int) -> Column:
    """Most frequent value of a column; the smallest one wins a tie."""
    ranked = F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))
    return F.min(F.when(F.col("place") == place, ranked))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    found: dict[str, Any] = {}
    for names, counts in value_counts(df, columns):
        row = counts.agg(*[_best(i).alias(f"b{i}") for i in range(len(names))]).first()
        found.update({c: row[f"b{i}"]["value"] if row[f"b{i}"] else None for i, c in enumerate(names)})
    return found


def distinct_values(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_VALUES
) -> dict[str, list[Any]]:
    """Sorted distinct values per column, refused beyond ``limit`` per column."""
    found: dict[str, list[Any]] = {c: [] for c in columns}
    for names, counts in value_counts(df, columns):
        rows = counts.select("place", "value").limit(limit * len(names) + 1).collect()
        for row in rows:
            found[names[row["place"]]].append(row["value"])
        wide = [c for c in names if len(found[c]) > limit]
        if wide or len(rows) > limit * len(names):
            raise ValueError(f"more than {limit} different values in {wide or names}")
    return {c: sorted(v) for c, v in found.items()}


def _long(df: DataFrame, per_column: dict[str, dict[str, Column]], schema: str) -> DataFrame:
    """One aggregate over all columns, reshaped to one row per column."""
    aggregates = [
        F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in parts.items()]).alias(f"a{i}")
        for i, (c, parts) in enumerate(per_column.items())
    ]
    wide = df.agg(*aggregates)
    cells = F.array(*[F.col(f"a{i}").cast(schema) for i in range(len(aggregates))])
    return wide.select(F.inline(cells))


def _counts_frame(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, dtype, position, total, non_null, unique`` of every column."""
    parts, kinds = {}, dict(df.dtypes)
    for i, c in enumerate(df.columns):
        entry = {
            "dtype": F.lit(kinds[c]),
            "position": F.lit(i),
            "total": F.count("*"),
            "non_null": F.count(col(c)),
        }
        if approx:
            entry["unique"] = F.approx_count_distinct(col(c))
        parts[c] = entry
    schema = "struct<column:string,dtype:string,position:int,total:bigint,non_null:bigint"
    frame = _long(df, parts, schema + (",unique:bigint>" if approx else ">"))
    if approx:
        return frame
    tops = _tops(df)
    return frame.join(tops, "column", "left")


def _tops(df: DataFrame) -> DataFrame:
    """``column, unique, top, freq``: one row per column."""
    parts = []
    for names, counts in value_counts(df, df.columns):
        rows = [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col("place") == i).alias("unique"),
                _best(i).alias("b"),
            )
            for i, c in enumerate(names)
        ]
        parts.append(
            _per_place(counts, rows).select(
                "column", "unique", F.col("b.value").cast("string").alias("top"), (-F.col("b.n")).alias("freq")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def info(df: DataFrame, approx: bool = False) -> DataFrame:
    missing = F.col("total") - F.col("non_null")
    return _counts_frame(df, approx).select(
        "column",
        "dtype",
        "non_null",
        missing.alias("missing"),
        percent(missing, F.col("total")).alias("missing_pct"),
        "unique",
    )


def missing_values(df: DataFrame) -> DataFrame:
    parts = {c: {"total": F.count("*"), "non_null": F.count(col(c))} for c in df.columns}
    frame = _long(df, parts, "struct<column:string,total:bigint,non_null:bigint>")
    missing = F.col("total") - F.col("non_null")
    return (
        frame.select(
            "column", missing.alias("missing"), percent(missing, F.col("total")).alias("missing_pct")
        )
        .where("missing > 0")
        .orderBy(F.desc("missing"), "column")
    )


def duplicates(df: DataFrame) -> DataFrame:
    """``rows, duplicates``: rows that repeat an earlier row."""
    merged = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")
    return merged.agg(total.alias("rows"), (total - F.count("*")).alias("duplicates"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """``value, count`` with missing counted, most frequent first."""
    require_columns(df, [column])
    counts = df.groupBy(col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last("value"))


def class_distribution(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """``value, pct``: share of each value, missing counted; optionally the ``top`` ones."""
    require_columns(df, [target])
    counts = df.groupBy(col(target).alias("value")).agg(F.count("*").alias("n"))
    shares = counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one row
    shares = shares.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    if top is not None:
        shares = shares.limit(top).withColumn("value", F.col("value").cast("string"))
    return shares.select("value", percent(F.col("n"), F.col("total")).alias("pct"))


def top_classes(df: DataFrame, target: str) -> DataFrame | None:
    """The most frequent classes; None for an absent column or an empty table."""
    if target not in df.columns or df.isEmpty():
        return None
    return class_distribution(df, target, CLASSES_SHOWN)


def _moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    parts = {}
    for c in names:
        x = col(c).cast("double")
        parts[c] = {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
    return _long(df, parts, "struct<column:string,mean:double,std:double,min:double,max:double>")


def describe(df: DataFrame, include: str = "all", approx: bool = False) -> DataFrame:
    """Count, distinct and top value for text; moments and quartiles for numbers.
    ``include`` is ``all``, ``number`` or ``other``."""
    if include not in ("all", "number", "other"):
        raise ValueError("include must be 'all', 'number' or 'other'.")
    if include != "all":
        wanted = [c for c in df.columns if is_number(type_of(df, c)) == (include == "number")]
        if not wanted:
            raise ValueError(f"no column of kind {include!r}")
        df = df.select(*[col(c) for c in wanted])
    numbers = [c for c in df.columns if is_number(type_of(df, c))]
    counts = _counts_frame(df)
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in numbers}, approx)
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(c, *quartiles[c]) for c in numbers], "column string, q25 double, q50 double, q75 double"
    )
    number = F.col("column").isin(numbers)
    joined = counts.join(_moments(df, numbers), "column", "left") if numbers else counts
    joined = joined.join(F.broadcast(table), "column", "left")
    blank = F.lit(None).cast("double")
    moment = {k: F.col(k) if numbers else blank for k in ("mean", "std", "min", "max")}
    return joined.select(
        "column",
        F.col("non_null").alias("count"),
        F.when(~number, F.col("unique")).alias("unique"),
        F.when(~number, F.col("top")).alias("top"),
        F.when(~number, F.col("freq")).alias("freq"),
        moment["mean"].alias("mean"),
        moment["std"].alias("std"),
        moment["min"].alias("min"),
        "q25",
        "q50",
        "q75",
        moment["max"].alias("max"),
    )


def column_stats(df: DataFrame) -> DataFrame:
    """Per column: type, missing, distinct; moments of numbers, top value of the rest."""
    numbers = [c for c in df.columns if is_number(type_of(df, c))]
    counts = _counts_frame(df)
    joined = counts.join(_moments(df, numbers), "column", "left") if numbers else counts
    blank = F.lit(None).cast("double")
    moment = {k: F.col(k) if numbers else blank for k in ("mean", "std", "min", "max")}
    number = F.col("column").isin(numbers)
    missing = F.col("total") - F.col("non_null")
    text = ~number & F.col("top").isNotNull()
    return joined.select(
        "column",
        "dtype",
        missing.alias("missing"),
        percent(missing, F.col("total")).alias("missing_pct"),
        "unique",
        moment["mean"].alias("mean"),
        F.when(number & (F.col("non_null") == 1), 0.0).otherwise(moment["std"]).alias("std"),
        moment["min"].alias("min"),
        moment["max"].alias("max"),
        F.when(text, F.col("top")).alias("top"),
        F.when(text, percent(F.col("freq"), F.col("total"))).alias("top_pct"),
    )


def guess_target(df: DataFrame, target: str | None = None, defaults: Sequence[str] = ()) -> str | None:
    """The named target if it exists; without a name, a default or a usual one."""
    if target is not None:
        return target if target in df.columns else None
    return next((c for c in [*defaults, *TARGET_NAMES] if c in df.columns), None)


def preview(
    df: DataFrame,
    n: int = 20,
    target: str | None = None,
    key: Sequence[str] | None = None,
    label: str = "",
) -> dict[str, Any]:
    """The report on one table. Only report-sized results reach the driver, and each
    part reads only the columns it needs; cache the table first if it is costly to make."""
    from tidemill.operators.rows import head

    chosen = guess_target(df, target)
    counted = duplicates(df).first()
    stats = {r["column"]: r.asDict() for r in column_stats(df).collect()}
    classes = top_classes(df, chosen) if chosen else None
    shares = None
    if classes is not None:
        shares = {str(r["value"]): r["pct"] for r in classes.collect()}
    return {
        "dataset": label,
        "rows": counted["rows"],
        "columns": df.columns,
        "dtypes": dict(df.dtypes),
        "missing": {c: stats[c]["missing"] for c in df.columns if stats[c]["missing"]},
        "preview": [r.asDict() for r in head(df, n, key).collect()],
        "duplicates": counted["duplicates"],
        "columns_stats": [stats[c] for c in df.columns],
        "class_distribution": shares,
        "target": chosen,
    }


def content_hash(df: DataFrame) -> DataFrame:
    """``rows, checksum, hash``: equal for equal tables in any row order.

    Each value enters as ``length:text``, so values cannot run into each other.
    """
    totals = df.agg(F.count("*").alias("rows"), _checksum(df).alias("checksum"))
    text = F.concat_ws("|", F.lit(_schema_text(df)), F.col("rows").cast("string"), "checksum")
    return totals.withColumn("hash", F.sha2(text, 256))


def _schema_text(df: DataFrame) -> str:
    return "|".join(f"{n}:{t}" for n, t in df.dtypes)


def _checksum(df: DataFrame) -> Column:
    def piece(name: str) -> Column:
        text = F.to_json(F.struct(col(name))) if _nested(type_of(df, name)) else col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    digest = F.md5(F.concat_ws("|", *[piece(c) for c in df.columns]))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.sum(number), F.lit(0)).cast("string")


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def summary(df: DataFrame) -> dict[str, Any]:
    """What a snapshot records about its table."""
    row = df.agg(
        F.count("*").alias("n"),
        _checksum(df).alias("checksum"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    ).first()
    missing = {c: row["n"] - row[f"c{i}"] for i, c in enumerate(df.columns)}
    text = "|".join((_schema_text(df), str(row["n"]), row["checksum"]))
    return {
        "rows": row["n"],
        "columns": len(df.columns),
        "column_names": df.columns,
        "dtypes": dict(df.dtypes),
        "missing": missing,
        "missing_total": sum(missing.values()),
        "duplicates": duplicates(df).first()["duplicates"],
        "hash": hashlib.sha256(text.encode()).hexdigest(),
    }


def feature_profile(df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Per feature: type, value of the first row in ``key`` order, mean, min and max."""
    require_columns(df, [*features, *key])
    order = F.struct(*[col(k) for k in key])
    kinds = dict(df.dtypes)
    parts = {}
    for c in features:
        number = is_number(type_of(df, c))
        x = col(c).cast("double") if number else F.lit(None).cast("double")
        parts[c] = {
            "dtype": F.lit(kinds[c]),
            "sample": F.min_by(col(c).cast("string"), order),
            "mean": F.avg(x),
            "min": F.min(x),
            "max": F.max(x),
        }
    return _long(
        df, parts, "struct<column:string,dtype:string,sample:string,mean:double,min:double,max:double>"
    )
