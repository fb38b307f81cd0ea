"""Reading tables. Whatever the format, a missing value arrives as NULL and nothing else."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col
from tidemill.functions.numbers import NUMBER_PATTERN, WHOLE_PATTERN, nan_to_null, parse_number, strip

FORMATS = ("csv", "json", "parquet", "xml")

# Texts that mean "missing" in a delimited file. Case matters.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# Texts read as truth values.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


@dataclass(frozen=True)
class DatasetRef:
    """Where a table is. ``nan_free`` promises that its floats hold no NaN, which lets
    filters on them reach the Parquet reader."""

    path: str
    format: str | None = None
    split: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)
    nan_free: bool = False


def load(spark: SparkSession, ref: DatasetRef | str) -> DataFrame:
    ref = DatasetRef(ref) if isinstance(ref, str) else ref
    kind = _format_of(ref)
    try:
        if ref.split is not None:
            df = load_split(spark, ref.path, ref.split)
        elif kind == "csv":
            return _read_csv(spark, ref)
        elif kind == "json":
            options = dict(ref.options)
            if "multiLine" not in options:
                options["multiLine"] = not json_lines(spark, ref.path)
            df = spark.read.options(**options).json(ref.path)
        elif kind == "xml":
            options = {"rowTag": "row", **ref.options}
            df = spark.read.options(**options).format("xml").load(ref.path)
        else:
            df = spark.read.options(**ref.options).parquet(ref.path)
            if _split_names(df):
                df = load_split(spark, ref.path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Dataset not found: {ref.path}") from error
        raise
    return df if ref.nan_free else without_nan(df)


def _format_of(ref: DatasetRef) -> str:
    if ref.format is not None:
        kind = ref.format.lower()
    else:
        name = re.split(r"[\\/]", ref.path.rstrip("/"))[-1]
        kind = name.rsplit(".", 1)[1].lower() if "." in name else "parquet"
    if kind not in FORMATS:
        raise ValueError(f"Unsupported format {kind!r} of {ref.path!r}. Supported formats: {', '.join(FORMATS)}")
    return kind


def load_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One split of a Parquet folder with ``split=<name>`` parts: the named one, else
    ``train``, else the first by name. Only its files are read."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Dataset not found: {path}") from error
        raise
    if "split" not in df.columns:
        if split is None:
            return df
        raise ValueError(f"Split {split!r} not found. Available: none")
    names = _split_names(df)
    if not names:  # a column of the rows, not of the folders
        found = df.select(F.col("split").cast("string").alias("split")).where("split IS NOT NULL").distinct()
        names = sorted(r["split"] for r in found.collect())
    if not names:
        raise ValueError("the table has no named split")
    chosen = split if split is not None else ("train" if "train" in names else names[0])
    if chosen not in names:
        raise ValueError(f"Split {chosen!r} not found. Available: {', '.join(names)}")
    return df.where(F.col("split").cast("string") == chosen).drop("split")


def _split_names(df: DataFrame) -> list[str]:
    """Names of the ``split=<name>`` folders that a table lies in; no data is read."""
    if "split" not in df.columns:
        return []
    found = {unquote(m.group(1)) for f in df.inputFiles() for m in [re.search(r"/split=([^/]+)/", f)] if m}
    return sorted(found - {"__HIVE_DEFAULT_PARTITION__"})


def json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a whole JSON object: then every line is one,
    and files are split. An array, or an object over several lines, is read as a whole."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not head:
        return True
    try:
        return isinstance(json.loads(head[0]["value"]), dict)
    except ValueError:
        return False


def lines_are_rows(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether every line of a delimited file has its quotes in pairs. Then no quoted field
    goes on in the next line, so files may be split at line ends. Lines are looked at side by side."""
    odd = F.pmod(F.regexp_count("value", F.lit(re.escape(quote))), F.lit(2)) == 1
    return spark.read.text(path).where(odd).isEmpty()


def without_nan(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[nan_to_null(col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def _read_csv(spark: SparkSession, ref: DatasetRef) -> DataFrame:
    """Quoted fields may hold quotes and line breaks. Values are read as text, the
    missing tokens become NULL, and only then each column's type is decided. Unless told,
    files are read as a whole only where a quoted field has a line break."""
    options = {"header": True, "escape": '"', **ref.options}
    schema = options.pop("schema", None)
    if "multiLine" not in options:
        try:
            plain = options["escape"] == '"' and "lineSep" not in options
            options["multiLine"] = not (plain and lines_are_rows(spark, ref.path, options.get("quote", '"')))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"Dataset not found: {ref.path}") from error
            raise
    reader = spark.read.options(**{**options, "inferSchema": False})
    try:
        raw = reader.csv(ref.path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Dataset not found: {ref.path}") from error
        raise
    texts = raw.select(
        *[F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c) for c in raw.columns]
    )
    if schema is not None:
        kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        wanted = {f.name: f.dataType for f in kinds.fields}
        return texts.select(*[col(c).try_cast(wanted.get(c, T.StringType())).alias(c) for c in texts.columns])
    return infer_types(texts)


def infer_types(texts: DataFrame) -> DataFrame:
    """Text columns as boolean, bigint or double where every value allows it; one aggregate."""
    names = texts.columns
    if not names:
        return texts

    def every(test: Column) -> Column:
        return F.coalesce(F.bool_and(test), F.lit(False))  # missing values do not count

    tests = []
    for i, c in enumerate(names):
        fits = col(c).rlike(WHOLE_PATTERN) & strip(col(c)).try_cast("bigint").isNotNull()
        whole = F.when(col(c).isNotNull(), fits)
        tests += [
            every(col(c).isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
            every(whole).alias(f"w{i}"),
            every(col(c).rlike(NUMBER_PATTERN)).alias(f"n{i}"),
            F.count(col(c)).alias(f"c{i}"),
        ]
    seen = texts.agg(*tests).first()
    out = []
    for i, c in enumerate(names):
        value = col(c)
        if seen[f"b{i}"]:
            value = value.isin(TRUE_TOKENS)
            value = F.when(col(c).isNotNull(), value)
        elif seen[f"w{i}"]:
            value = strip(value).try_cast("bigint")
        elif seen[f"n{i}"] or seen[f"c{i}"] == 0:
            value = parse_number(value)
        out.append(value.alias(c))
    return texts.select(*out)


def concat_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks of one table, matched by column name."""
    if not chunks:
        raise ValueError("no chunks to concatenate")
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk, allowMissingColumns=True)
    return out
