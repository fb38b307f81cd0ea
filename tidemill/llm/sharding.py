"""A reproducible shuffle as arithmetic: global row numbers, permuted, give shard and slot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.ranking import repeat_rows
from tidemill.llm.common import bucket_bits, free_names, keep

ROUNDS = 8
WALK = 64


def _sides(n: Column) -> tuple[Column, Column]:
    """Sides of the smallest near-square grid with at least ``n`` cells."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    # the root of a large number is rounded: one more row never hurts
    return a, (F.floor((n + a - 1) / a) + F.when(n > (1 << 50), 1).otherwise(0)).cast("long")


def _mix(value: Column, step: Column, salt: Column, side: Column) -> Column:
    return F.pmod(F.xxhash64(value, step, salt), side)


def _encrypt(x: Column, a: Column, b: Column, salt: Column) -> Column:
    """Feistel rounds on a grid of a x b cells: each round shifts one half by a hash of the other."""
    start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))

    def one(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, F.pmod(s["l"] + _mix(s["r"], i, salt, a), a)).otherwise(s["l"])
        right = F.when(~even, F.pmod(s["r"] + _mix(s["l"], i, salt, b), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, start, one, lambda s: s["r"] * a + s["l"])


def _decrypt(x: Column, a: Column, b: Column, salt: Column) -> Column:
    start = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))

    def one(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left = F.when(even, F.pmod(s["l"] - _mix(s["r"], i, salt, a), a)).otherwise(s["l"])
        right = F.when(~even, F.pmod(s["r"] - _mix(s["l"], i, salt, b), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0))
    return F.aggregate(steps, start, one, lambda s: s["r"] * a + s["l"])


def _walk(step, x: Column, n: Column, salt: Column) -> Column:
    """Cycle walking: a cell beyond ``n`` is permuted again until it falls inside.

    The grid has at most about sqrt(n) such cells, so one step nearly always does, and
    below 4 000 rows ``WALK`` steps pass through all of them; above that, the chance that
    any row needs more is below 1e-100. A row that did would end the job with an error.
    """
    a, b = _sides(n)
    once = step(x, a, b, salt)
    again = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once, lambda y, _: F.when(y < n, y).otherwise(step(y, a, b, salt))
    )
    inside = F.when(once < n, once).otherwise(again)
    return F.when(inside < n, inside).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def permute(x: Column, n: Column, salt: Column) -> Column:
    """Where row number ``x`` of ``n`` goes: a permutation of 0 .. n-1 chosen by ``salt``."""
    return _walk(_encrypt, x.cast("long"), n.cast("long"), salt)


def unpermute(y: Column, n: Column, salt: Column) -> Column:
    """The row number that ``permute`` sends to ``y``."""
    return _walk(_decrypt, y.cast("long"), n.cast("long"), salt)


def number_rows(df: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """A column ``row_number`` from 0 without gaps, the same under any partitioning.

    Rows are numbered by a hash of all their columns. Equal rows are counted first and get
    their numbers as a range, so a row that repeats very often never meets in one task;
    hash buckets bound every other task. A column ``row_number`` of ``df`` is replaced.
    """
    columns = [c for c in df.columns if c.lower() != "row_number"]
    inner = [f"c{i}" for i in range(len(columns))]  # no name can clash with the ones used here
    names = [F.col(c) for c in inner]
    counted = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, inner)])
    counted = counted.groupBy(*names).agg(F.count("*").alias("_copies"))
    rows = keep(counted.withColumn("_h", F.xxhash64(F.lit(seed), *names)), "numbered")
    found = rows.agg(F.count("*").alias("d"), F.sum("_copies").alias("n")).first()
    bits, total = bucket_bits(found["d"]), int(found["n"] or 0)
    bucket = F.shiftrightunsigned("_h", 64 - bits).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    # one row per bucket, so the only ordering over all of them is small
    over_all = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_bucket")
        .agg(F.sum("_copies").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(over_all), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy("_bucket").orderBy("_h", *names).rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.col("_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0))
    numbered = rows.join(starts, "_bucket").withColumn("_first", first)
    each = repeat_rows(numbered, F.col("_copies"), "_copy_no")
    numbers = (F.col("_first") + F.col("_copy_no") - 1).alias("row_number")
    return each.select(*[n.alias(c) for n, c in zip(names, columns)], numbers), total


def assign_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Adds ``row_number``, ``shard`` and ``slot``: row counts of shards differ by one at most
    and slots run from 0 without a gap.

    The row number of any shard and slot is ``unpermute(slot * shards + shard, n, seed)``.
    NULLs take part as values, repeated rows each get a slot, an empty table stays empty.
    Columns of ``df`` with these three names are replaced.
    Pass a narrow table (keys, not texts): all its columns are hashed and compared.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = number_rows(df.drop("shard", "slot"), seed)
    (at,) = free_names(rows, "_at")
    placed = rows.withColumn(at, permute(F.col("row_number"), F.lit(max(n, 1)), F.lit(seed)))
    shard, slot = F.pmod(at, F.lit(shards)).cast("int"), F.floor(F.col(at) / shards).cast("long")
    return placed.withColumns({"shard": shard, "slot": slot}).drop(at)


def source_row(shard: int, slot: int, shards: int, n: int, seed: int = 0) -> Column:
    """The row number found at a shard and slot, as an expression."""
    if not 0 <= slot * shards + shard < n:
        raise ValueError("no such slot")
    return unpermute(F.lit(slot * shards + shard), F.lit(n), F.lit(seed))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Documents by id, size in bytes and checksum, with their shard and slot.

    ``size`` is the UTF-8 length of the text and 16 bytes of overhead; a NULL text has no
    bytes and checksum 0. Repeated rows each count. Other columns are ignored.
    """
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    return assign_shards(slim, shards, seed)


def run(spark, sf: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
