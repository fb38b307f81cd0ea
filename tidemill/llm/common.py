"""What the operators of this package share: words, tables in the shared folder, sizes."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import shared_dir

# A word is a run without ASCII white space (Java and Python read the pattern alike).
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BUCKET = 50_000


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the driver and all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it is computed once, and a
    lost executor costs a read, not the work before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, although it is used often."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else: Unicode lower-casing would change other letters."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; a NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_bits(rows: int) -> int:
    """Bits of a hash so that a bucket holds ``ROWS_PER_BUCKET`` rows at most, and a hot group
    falls into many buckets even where rows are few."""
    return max(8, math.ceil(math.log2(max(rows, 1) / ROWS_PER_BUCKET + 1)))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to be none of ``df``'s."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
