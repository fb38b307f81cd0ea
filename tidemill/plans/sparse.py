"""Features as sparse vectors, with categories in written tables instead of columns.

The dense plans give a column per category and carry the categories in the plan. Here a
category is a place in a vector: its code comes from a dictionary that is joined, so a
column may have any number of categories, and a row costs as much as it has values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, free_name, type_of
from tidemill.functions.numbers import parse_number
from tidemill.operators.codes import CodeTable, fit_codes
from tidemill.operators.missing import apply_fill

VECTOR = "features"


@dataclass
class SparsePlan:
    """Numbers first, in column order; then one block of places per categorical column.

    ``drop_first``: the first category has no place (all zeros), as in the dense plan of a model's
    features. ``ordinal``: a categorical column is one place that holds its code, -1 if unknown.
    """

    inputs: list[str]
    numeric: list[str]
    tables: dict[str, CodeTable]  # by categorical column
    fills: dict[str, Any]
    scales: dict[str, list[float]] = field(default_factory=dict)
    drop_first: bool = True
    ordinal: bool = False
    target: str | None = None
    task: str = "classification"
    classes: CodeTable | None = None  # of a text label
    label: str = "label"
    passed: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=lambda: [VECTOR])

    def width(self, column: str) -> int:
        return 1 if self.ordinal else max(self.tables[column].rows - self.drop_first, 0)

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(self.width(c) for c in self.tables)

    def _coded(self, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
        """``keep``, the label, the numbers, and for every categorical column its code, NULL
        where the row has no place in the column's block."""
        missing = [c for c in self.inputs if c not in set(df.columns)]
        if missing:
            raise ValueError(f"Missing features: {missing}")
        texts = [c for c in self.numeric if isinstance(type_of(df, c), T.StringType)]
        rows = apply_fill(df.withColumns({c: parse_number(col(c)) for c in texts}), self.fills)
        kept = [*keep, *[c for c in self.passed if c not in set(keep)]]
        numbers, codes = [], []
        for c in self.numeric:
            name = free_name(rows, f"_n{len(numbers)}")
            offset, scale = self.scales.get(c, (0.0, 1.0))
            rows = rows.withColumn(name, (col(c).cast("double") - F.lit(offset)) / F.lit(scale))
            numbers.append(name)
        for c, table in self.tables.items():
            name = free_name(rows, f"_c{len(codes)}")
            rows = table.encode(rows, col(c), name)
            codes.append(name)
        out = [col(k) for k in kept] + [F.col(n) for n in [*numbers, *codes]]
        if self.target is not None and self.target in df.columns:
            rows, label = self._label(rows)
            out.append(label.alias(self.label))
        return rows.select(*out), numbers, codes

    def _label(self, rows: DataFrame):
        whole = "bigint" if self.task == "classification" else "double"
        if self.classes is not None:
            name = free_name(rows, "_label")
            return self.classes.encode(rows, col(self.target), name), F.coalesce(name, F.lit(-1)).cast(whole)
        y = col(self.target)
        return rows, (parse_number(y) if isinstance(type_of(rows, self.target), T.StringType) else y).cast(whole)

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep``, ``features`` as (size, indices, values) without zeros, and the label."""
        rows, numbers, codes = self._coded(df, keep)
        cell = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
        cells = [cell(F.lit(i), F.coalesce(n, F.lit(0.0))) for i, n in enumerate(numbers)]
        at = len(numbers)
        for c, code in zip(self.tables, codes):
            if self.ordinal:
                cells.append(cell(F.lit(at), F.coalesce(code, F.lit(-1))))
            else:
                place = F.col(code) - int(self.drop_first)
                cells.append(F.when(place >= 0, cell(place + at, F.lit(1.0))))
            at += self.width(c)
        full = F.filter(F.array(*cells), lambda x: x.isNotNull() & (x["v"] != 0)) if cells else F.array()
        names = [c for c in rows.columns if c not in {*numbers, *codes}]
        vector = F.struct(
            F.lit(self.size).alias("size"), F.transform(full, lambda x: x["i"]).alias("indices"),
            F.transform(full, lambda x: x["v"]).alias("values"),
        )
        kept = [col(c) for c in names if c != self.label or self.target is None]
        return rows.select(*kept, vector.alias(VECTOR), *([col(self.label)] if self.label in names and self.target else []))

    def vectors(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The same as vectors of Spark ML, for its learners."""
        rows, numbers, codes = self._coded(df, keep)
        names = [c for c in rows.columns if c not in {*numbers, *codes}]
        parts, filled = list(numbers), [F.coalesce(n, F.lit(0.0)).alias(n) for n in numbers]
        for c, code in zip(self.tables, codes):
            n = self.width(c)
            if self.ordinal:
                filled.append(F.coalesce(code, F.lit(-1)).cast("double").alias(code))
                parts.append(code)
            elif n:
                # the encoder drops its last category: that is where rows without a place go
                place = F.col(code) - int(self.drop_first)
                nominal = {"ml_attr": {"type": "nominal", "num_vals": n + 1}}
                told = F.when(place >= 0, place).otherwise(n).cast("double")
                filled.append(told.alias(code, metadata=nominal))
                parts.append(f"{code}_v")
        rows = rows.select(*[col(c) for c in names], *filled)
        encoded = [p[:-2] for p in parts if p.endswith("_v") and p[:-2] in set(codes)]
        if encoded:
            encoder = OneHotEncoder(inputCols=encoded, outputCols=[f"{c}_v" for c in encoded], dropLast=True)
            rows = encoder.fit(rows).transform(rows)
        return VectorAssembler(inputCols=parts, outputCol=VECTOR).transform(rows).select(
            *[col(c) for c in names if c != self.label or self.target is None], VECTOR,
            *([col(self.label)] if self.label in names and self.target else []),
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> SparsePlan:
        facts = json.loads(text)
        facts["tables"] = {c: CodeTable(**t) for c, t in facts["tables"].items()}
        facts["classes"] = None if facts["classes"] is None else CodeTable(**facts["classes"])
        return cls(**facts)


def fit_tables(df: DataFrame, columns: Sequence[str]) -> dict[str, CodeTable]:
    return {c: fit_codes(df, c) for c in columns}
