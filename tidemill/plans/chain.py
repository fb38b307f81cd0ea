"""Chains of named operations.

A chain is a list of ``{"operation": name, **arguments}``. All entries are checked
before the first job. Each operation is split into *fit* (aggregates that yield a few
literals) and *apply* (a lazy DataFrame step), so a whole chain stays one plan, and a
fitted chain can be stored and applied to another table or to a stream.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.columns import as_list, col, require_columns
from tidemill.operators import missing, outliers, rows, scalars
from tidemill.operators.profile import distinct_values, preview


@dataclass(frozen=True)
class Operation:
    """``fit(df, **arguments)`` gives literals, ``apply(df, literals, **arguments)`` a DataFrame."""

    signature: Callable
    fit: Callable[..., dict]
    apply: Callable[..., DataFrame]
    ordered: bool = False  # takes the table's key columns
    streams: bool = True
    selects: bool = False  # chooses or orders rows, and leaves their values alone


def _plain(function: Callable, **traits: bool) -> Operation:
    """An operation with nothing to fit."""
    return Operation(
        function, lambda df, **_: {}, lambda df, state, **args: function(df, **args), **traits
    )


def _fit_convert(df, column, dtype, formats=None):
    scalars.check_convert(df, column, dtype)
    if dtype != "category":
        return {}
    texts = df.select(col(column).cast("string").alias(column))
    return {"categories": distinct_values(texts, [column])[column]}


def _fit_bounds(df, columns, method="iqr", threshold=1.5, approx=False):
    bounds = outliers.outlier_bounds(df, columns, method, threshold, approx)
    return {"bounds": {c: list(b) for c, b in bounds.items()}}


def _fit_transform(df, columns, transformation):
    scalars.check_transform(df, columns, transformation)
    return {}


OPERATIONS: dict[str, Operation] = {
    "drop_columns": _plain(rows.drop_columns),
    "rename_columns": _plain(rows.rename_columns),
    "drop_duplicates": _plain(rows.drop_duplicates, ordered=True, streams=False, selects=True),
    "drop_missing_rows": _plain(rows.drop_missing_rows, selects=True),
    "fill_missing": Operation(
        missing.fill_missing,
        lambda df, **args: {"values": missing.fit_fill(df, **args)},
        lambda df, state, **_: missing.apply_fill(df, state["values"]),
    ),
    "convert_dtype": Operation(
        scalars.convert_dtype,
        _fit_convert,
        lambda df, state, column, dtype, formats=None: scalars.apply_convert(
            df, column, dtype, formats, state.get("categories")
        ),
    ),
    "parse_dates": _plain(scalars.parse_dates),
    "clean_numeric": _plain(scalars.clean_numeric),
    "filter_rows": _plain(rows.filter_rows, selects=True),
    "shuffle": _plain(rows.shuffle, ordered=True, streams=False, selects=True),
    "sample_rows": _plain(rows.sample_rows, ordered=True, streams=False, selects=True),
    "remove_outliers": Operation(
        outliers.remove_outliers,
        _fit_bounds,
        lambda df, state, **_: outliers.apply_remove(df, state["bounds"]),
        selects=True,
    ),
    "clip_outliers": Operation(
        outliers.clip_outliers,
        _fit_bounds,
        lambda df, state, **_: outliers.apply_clip(df, state["bounds"]),
    ),
    "create_date_features": _plain(scalars.create_date_features),
    "transform_numeric": Operation(
        scalars.transform_numeric,
        _fit_transform,
        lambda df, state, **args: scalars.apply_transform(df, **args),
    ),
}


def check_operations(operations: Any) -> list[dict[str, Any]]:
    """Every entry must be a mapping with a known name and fitting arguments."""
    if operations is None:
        return []
    if not isinstance(operations, (list, tuple)):
        raise ValueError(f"a chain is a list of steps, not {type(operations).__name__}")
    for place, raw in enumerate(operations):
        if not isinstance(raw, dict):
            raise ValueError(f"operations[{place}]: each operation must be an object.")
        name = raw.get("operation")
        if name not in OPERATIONS:
            raise ValueError(
                f"operations[{place}]: unknown operation {name!r}. Available: {sorted(OPERATIONS)}"
            )
        arguments = {k: v for k, v in raw.items() if k != "operation"}
        try:
            inspect.signature(OPERATIONS[name].signature).bind(None, **arguments)
        except TypeError as error:
            raise ValueError(f"operations[{place}]: {name}: {error}") from error
    return [dict(raw) for raw in operations]


@dataclass
class FittedChain:
    """Operations with their fitted literals."""

    steps: list[dict[str, Any]]  # operation, args, state

    def apply(self, df: DataFrame, select_rows: bool = True) -> DataFrame:
        """``select_rows=False`` skips the steps that only choose or order rows, so that
        every row of ``df`` comes out."""
        steps = [s for s in self.steps if select_rows or not OPERATIONS[s["operation"]].selects]
        if df.isStreaming:
            fixed = [s["operation"] for s in steps if not OPERATIONS[s["operation"]].streams]
            if fixed:
                raise ValueError(f"these operations need a whole table: {fixed}")
        for step in steps:
            df = OPERATIONS[step["operation"]].apply(df, step["state"], **step["args"])
        return df

    def to_json(self) -> str:
        return json.dumps(self.steps, default=str)

    @classmethod
    def from_json(cls, text: str) -> FittedChain:
        return cls(json.loads(text))


def fit_chain(
    df: DataFrame, operations: Sequence[dict[str, Any]], key: Sequence[str] | None = None
) -> tuple[FittedChain, list[DataFrame]]:
    """The fitted chain and the table after each step (the input first)."""
    checked = check_operations(operations)
    tables, steps = [df], []
    for raw in checked:
        operation = OPERATIONS[raw["operation"]]
        args = {k: v for k, v in raw.items() if k != "operation"}
        current = tables[-1]
        if operation.ordered and key is not None and "key" not in args:
            require_columns(current, key)
            args["key"] = list(key)
        state = operation.fit(current, **args)
        tables.append(operation.apply(current, state, **args))
        steps.append({"operation": raw["operation"], "args": args, "state": state})
    return FittedChain(steps), tables


def apply_operations(
    df: DataFrame, operations: Sequence[dict[str, Any]], key: Sequence[str] | None = None
) -> DataFrame:
    return fit_chain(df, operations, key)[1][-1]


def audit(
    df: DataFrame, operations: Sequence[dict[str, Any]], key: Sequence[str] | None = None
) -> DataFrame:
    """``step, operation, args, rows, cols, row_change, col_change`` after each step.

    Counting a step runs the plan up to it; ``audit_once`` counts all of them in one pass.
    """
    _, tables = fit_chain(df, operations, key)
    return audit_tables(tables, check_operations(operations))


def audit_tables(tables: Sequence[DataFrame], operations: Sequence[dict[str, Any]]) -> DataFrame:
    parts = []
    for step, table in enumerate(tables):
        raw = operations[step - 1] if step else {"operation": "load"}
        args = {k: v for k, v in raw.items() if k != "operation"}
        before = len(tables[step - 1].columns) if step else len(table.columns)
        parts.append(
            table.agg(F.count("*").alias("rows")).select(
                F.lit(step).alias("step"),
                F.lit(raw["operation"]).alias("operation"),
                F.lit(json.dumps(args, default=str, sort_keys=True)).alias("args"),
                "rows",
                F.lit(len(table.columns)).alias("cols"),
                F.lit(len(table.columns) - before).alias("col_change"),
            )
        )
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    # one row per step, so the only ordering over all of them is small; each step is counted once
    before = F.lag("rows").over(Window.orderBy("step"))
    changed = counted.withColumn("row_change", F.col("rows") - before).where("step > 0")
    return changed.select("step", "operation", "args", "rows", "cols", "row_change", "col_change")


def audit_once(df: DataFrame, chain: FittedChain) -> DataFrame:
    """The same of a fitted chain, by one pass over the table: the chain runs once, and every
    step's rows are counted as they pass by."""
    watched = [Observation(f"step-{i}-{uuid4().hex}") for i in range(len(chain.steps) + 1)]
    table, columns = df, [len(df.columns)]
    for i, seen in enumerate(watched):
        table = table.observe(seen, F.count(F.lit(1)).alias("rows"))
        if i < len(chain.steps):
            step = chain.steps[i]
            table = OPERATIONS[step["operation"]].apply(table, step["state"], **step["args"])
            columns.append(len(table.columns))
    table.write.format("noop").mode("overwrite").save()
    rows = [seen.get["rows"] for seen in watched]
    out = []
    for i, step in enumerate(chain.steps):
        args = {k: v for k, v in step["args"].items()}
        told = json.dumps(args, default=str, sort_keys=True)
        out.append((i + 1, step["operation"], told, rows[i + 1], columns[i + 1], rows[i + 1] - rows[i], columns[i + 1] - columns[i]))
    schema = "step int, operation string, args string, rows bigint, cols int, row_change bigint, col_change int"
    return df.sparkSession.createDataFrame(out, schema)


def preview_chain(
    df: DataFrame,
    operations: Sequence[dict[str, Any]],
    n: int = 20,
    target: str | None = None,
    key: Sequence[str] | None = None,
) -> dict[str, Any]:
    """A dry run: shape before and after and the report on the result; nothing is stored."""
    fitted, tables = fit_chain(df, operations, key)
    last = tables[-1]
    kept = key if key is not None and set(as_list(key)) <= set(last.columns) else None
    report = preview(last, n, target, kept)
    report["operations"] = [{"operation": s["operation"], **s["args"]} for s in fitted.steps]
    report["before_shape"] = rows.shape(df)
    report["after_shape"] = (report["rows"], len(last.columns))
    return report
