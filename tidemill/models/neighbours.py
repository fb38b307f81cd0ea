"""k nearest neighbours, exact or by hashing.

Below a measured size the training rows are sent to every task once and each batch of
query rows is compared with them by numpy. Above it, both tables are written once as blocks
of bounded size, packed into bytes, and every task reads the training blocks past its own
blocks of points and keeps the k best so far; a grouped merge keeps the k best of all. No
pair of rows is ever written out, neither table is copied by a shuffle, and no block grows
with the data, so that disk grows in proportion to the rows. This search runs at once; its
result is written, and the packed tables are deleted. For Euclidean distances, a
matrix product with a bound of its error leaves only pairs that may be near. Copies of a point
share a search; points are told apart by 128 bits of hashes, and results are joined by these.

``approx=True`` compares a row only with the training rows that share a bucket with it in one
of several tables of random projections. Rows that find fewer than k there are searched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col, is_number, type_of
from tidemill.session import remove, shared_path, small_batches, spread_small, written

BROADCAST_VALUES = 20_000_000
QUERY_BLOCK = 32_768
TRAIN_BLOCK = 32_768
BLOCK_BYTES = 1 << 20  # of the vectors of a packed block
COPIED = 200_000  # points with copies that are told to all tasks
BATCH_BYTES = 8 << 20  # of packed blocks that are sent to Python at a time
HELD = 4_000_000  # neighbours that a task keeps before it hands them on
CHUNK = 512
TILE = 4_096  # training rows that are compared at a time
TABLES = 8
PROJECTIONS = 3  # of a table
PROBES = 64  # rows that are searched exactly to set the width of buckets
WIDTH = 4.0  # of a bucket, in distances to the k-th neighbour


def feature_array(df: DataFrame, features: Sequence[str]):
    """One array of doubles, from number columns or from a single array column, whose floats stay floats."""
    if len(features) == 1 and not is_number(type_of(df, features[0])):
        if type_of(df, features[0]) in (T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)):
            return col(features[0])  # half the size, and doubles hold them exactly
        return F.transform(col(features[0]), lambda v: v.cast("double"))
    return F.array(*[col(f).cast("double") for f in features])


def train_table(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], k: int
) -> DataFrame:
    """``_tx, _ty, _tid``. Without a key, equal rows are merged and at most ``k`` copies
    kept: no more of them can ever be among the k nearest."""
    rows = df.select(
        feature_array(df, features).alias("_tx"), col(label).cast("double").alias("_ty"), *[col(c) for c in key]
    )
    if not key:
        merged = rows.groupBy("_tx", "_ty").agg(F.count("*").alias("n"))
        copies = F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k).cast("bigint")))
        spread = merged.select("_tx", "_ty", F.explode(copies).alias("copy"))
        return spread.select("_tx", "_ty", F.xxhash64("_tx", "_ty", "copy").alias("_tid"))
    if len(key) == 1 and isinstance(type_of(df, key[0]), T.IntegralType):
        identity = col(key[0]).cast("bigint")
    else:
        identity = F.xxhash64(*[col(c).cast("string") for c in key])
    return rows.select("_tx", "_ty", identity.alias("_tid"))


def _distances(q: np.ndarray, t: np.ndarray, p: int) -> np.ndarray:
    if p == 1:
        out = np.zeros((len(q), len(t)))
        for j in range(q.shape[1]):
            out += np.abs(q[:, j, None].astype(np.float64) - t[None, :, j])
        return out
    out = np.zeros((len(q), len(t)))
    for j in range(q.shape[1]):
        d = q[:, j, None].astype(np.float64) - t[None, :, j]
        out += d * d
    return np.sqrt(out)


class _Found:
    """The k nearest so far of the rows of a chunk: row, distance, id, label, in that order."""

    def __init__(self, rows: int, k: int):
        self.rows, self.k = rows, k
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
        self.worst = np.full(rows, np.inf)

    def add(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        best = [np.append(old, more) for old, more in zip(self.best, new)]
        order = np.lexsort((best[2], best[1], best[0]))
        row = best[0][order]
        order = order[np.arange(len(row)) - np.searchsorted(row, np.arange(self.rows))[row] < self.k]
        self.best = tuple(values[order] for values in best)
        ends = self.ends()
        full = np.diff(ends, prepend=0) == self.k
        self.worst[full] = self.best[1][ends[full] - 1]

    def ends(self) -> np.ndarray:
        return np.searchsorted(self.best[0], np.arange(self.rows), side="right")


def _search(found: list[_Found], q: np.ndarray, t: np.ndarray, y: np.ndarray, tid: np.ndarray, k: int, p: int) -> None:
    """Adds the rows of ``t`` to what was found for the chunks of ``q``."""
    near = _near_squares(q, t) if p == 2 else _near_plain(q, t, p)
    for start, chunk in zip(range(0, len(q), CHUNK), found):
        for rows, distances, places in near(start, chunk.rows, chunk.worst, k):
            chunk.add(rows, distances, tid[places], y[places])


def _chunks(rows: int, k: int) -> list[_Found]:
    return [_Found(min(CHUNK, rows - start), k) for start in range(0, rows, CHUNK)]


def _best(q: np.ndarray, t: np.ndarray, y: np.ndarray, tid: np.ndarray, k: int, p: int):
    """The k nearest rows of ``t`` for every row of ``q``, ties by row id."""
    found = _chunks(len(q), k)
    _search(found, q, t, y, tid, k, p)
    for chunk in found:
        ends = chunk.ends()
        told = list(zip(*(values.tolist() for values in chunk.best[1:])))
        yield from (told[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends))


def _near_plain(q: np.ndarray, t: np.ndarray, p: int):
    """Tile by tile, the pairs that are no farther than ``worst``: row, distance, row of ``t``."""

    def near(start: int, m: int, worst: np.ndarray, k: int):
        for lo in range(0, len(t), TILE):
            d = _distances(q[start : start + m], t[lo : lo + TILE], p)
            edge = worst
            if lo == 0 and d.shape[1] > k and np.isinf(worst).any():
                edge = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1])
            rows, columns = np.nonzero(~(d > edge[:, None]))
            yield rows, d[rows, columns], columns + lo

    return near


def _near_squares(q: np.ndarray, t: np.ndarray):
    """The same for Euclidean distances: one matrix product in single precision tells which pairs
    may be near enough, with a bound of its error, and only their distances are taken exactly."""
    middle = t.mean(axis=0, dtype=np.float64)
    scale = float(max((t.max(axis=0) - middle).max(), (middle - t.min(axis=0)).max())) or 1.0
    dims = t.shape[1]
    # one more number a row, so that the product is the square of t less twice the product of both
    a, b = np.ones((len(q), dims + 1), np.float32), np.empty((len(t), dims + 1), np.float32)
    a[:, :dims] = (q - middle) / scale
    for lo in range(0, len(t), TILE):
        b[lo : lo + TILE, :dims] = (t[lo : lo + TILE] - middle) / scale
    aa, bb = (np.einsum("ij,ij->i", v[:, :dims], v[:, :dims], dtype=np.float64) for v in (a, b))
    a[:, :dims] *= -2
    b[:, dims] = bb
    norm, most = np.sqrt(aa), float(np.sqrt(bb.max()))
    # rounding: of the products and sums, and of the numbers before they were centred
    raw = max(float(max(t.max(), -t.min())), float(np.abs(q).max()) if len(q) else 0.0)
    moved = 4 * np.finfo(np.float64).eps * raw / scale * np.sqrt(dims)
    slack = 4 * (dims + 8) * np.finfo(np.float32).eps * (norm + most) ** 2 + 4 * moved * (norm + most) + moved**2

    def near(start: int, m: int, worst: np.ndarray, k: int):
        mine = slice(start, start + m)
        for lo in range(0, len(t), TILE):
            told = a[mine] @ b[lo : lo + TILE].T
            edge = (worst / scale) ** 2 - aa[mine] + slack[mine]
            if lo == 0 and told.shape[1] > k and np.isinf(worst).any():
                edge = np.fmin(edge, np.partition(told, k - 1, axis=1)[:, k - 1] + 2 * slack[mine])
            # rounded up; what is not a number stays in
            with np.errstate(over="ignore"):
                edge = np.nextafter(edge.astype(np.float32), np.float32(np.inf))
            some = np.flatnonzero(~(told.min(axis=1) > edge))
            rows, columns = np.nonzero(~(told[some] > edge[some, None]))
            rows, columns = some[rows], columns + lo
            d = np.zeros(len(rows))
            for j in range(dims):
                one = q[rows + start, j].astype(np.float64) - t[columns, j]
                d += one * one
            yield rows, np.sqrt(d), columns

    return near


_BEST = T.ArrayType(
    T.StructType(
        [
            T.StructField("d", T.DoubleType()),
            T.StructField("id", T.LongType()),
            T.StructField("y", T.DoubleType()),
        ]
    )
)


def nearest(
    df: DataFrame,
    features: Sequence[str],
    train: DataFrame,
    k: int,
    p: int = 2,
    broadcast_values: int = BROADCAST_VALUES,
    *,
    approx: bool = False,
) -> DataFrame:
    """``df`` with ``_near``: its k nearest training rows as (distance, id, label).

    With ``approx``, a row may miss neighbours that no table puts into its buckets."""
    train = _few_copies(train, k)
    size = train.agg(F.count("*").alias("n"), F.max(F.size("_tx")).alias("d")).first()
    if size["n"] == 0:
        raise ValueError("the training table is empty")
    if size["n"] < k:
        raise ValueError(f"n_neighbors={k} is more than the {size['n']} training rows")
    queries = df.withColumn("_q", feature_array(df, features))
    if approx:
        doubles = [side.withColumn(c, F.col(c).cast("array<double>")) for side, c in ((queries, "_q"), (train, "_tx"))]
        return _with_hashes(spread_small(doubles[0]), doubles[1], k, p, size["n"], size["d"], broadcast_values)
    if size["n"] * size["d"] <= broadcast_values:
        return _with_points(queries, lambda points: _with_broadcast(points, train, k, p))
    return _with_points(queries, lambda points: _with_blocks(points, train, k, p), _few_moved)


def _hashed(df: DataFrame, vector: str) -> DataFrame:
    """``_h, _i``: 128 bits that are equal for equal points, so that no vector is a key."""
    return df.withColumns({"_h": F.xxhash64(vector), "_i": F.xxhash64(F.lit(7), vector)})


def _few_copies(train: DataFrame, k: int) -> DataFrame:
    """At most ``k`` training rows of a point, the smallest ids: no other can be among the k nearest.

    Hashes and ids alone are sorted; vectors stay where they lie."""
    hashed = _hashed(train, "_tx")
    order = W.partitionBy("_h", "_i").orderBy("_tid")
    first = hashed.select("_h", "_i", "_tid", F.row_number().over(order).alias("_r")).where(F.col("_r") <= k + 1)
    last = F.max(F.when(F.col("_r") == k, F.col("_tid"))).alias("_last")
    copied = first.groupBy("_h", "_i").agg(last, F.count("*").alias("_n")).where(F.col("_n") > k).drop("_n")
    copied = written(copied, "copies")
    if copied.isEmpty():
        return train
    kept = hashed.join(copied, ["_h", "_i"], "left").where(F.col("_last").isNull() | (F.col("_tid") <= F.col("_last")))
    return kept.select(*train.columns)


def _with_points(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Equal query points share one search."""
    queries = _hashed(queries, "_q")
    points = (merged or _merged_points)(queries.select("_h", "_i", "_q"))
    return queries.join(search(points).select("_h", "_i", "_near"), ["_h", "_i"]).drop("_h", "_i", "_q")


def _merged_points(points: DataFrame) -> DataFrame:
    return points.groupBy("_h", "_i").agg(F.first("_q").alias("_q"))


def _few_moved(points: DataFrame) -> DataFrame:
    """``_merged_points``, but a vector that has no copies stays where it lies, if few have any."""
    counts = points.groupBy("_h", "_i").agg(F.count("*").alias("_n"))
    copied = written(counts.where("_n > 1").select("_h", "_i"), "copied")
    n = copied.count()
    if n > COPIED:
        return _merged_points(points)
    if n == 0:
        return points
    told = F.broadcast(copied)
    alone = points.join(told, ["_h", "_i"], "left_anti")
    return alone.unionByName(_merged_points(points.join(told, ["_h", "_i"], "left_semi")))


def _with_broadcast(queries: DataFrame, train: DataFrame, k: int, p: int) -> DataFrame:
    table = train.toArrow()  # bounded by the caller's check
    points = table.column("_tx").combine_chunks()
    packed = queries.sparkSession.sparkContext.broadcast(
        (
            points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1),
            table.column("_ty").to_numpy(),
            table.column("_tid").to_numpy(),
        )
    )

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t, y, tid = packed.value
        for batch in batches:
            found = list(_best(np.stack(batch.to_numpy()), t, y, tid, k, p)) if len(batch) else []
            yield pd.Series([[{"d": d, "id": i, "y": v} for d, i, v in row] for row in found], dtype=object)

    annotations = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    search.__annotations__ = annotations
    return queries.withColumn("_near", F.pandas_udf(search, _BEST)("_q")).drop("_q")


def _with_blocks(points: DataFrame, train: DataFrame, k: int, p: int) -> DataFrame:
    """``_h, _i, _near`` of different points, every block of them against every block of ``train``."""
    spark = points.sparkSession
    paths = [shared_path(spark, name) for name in ("points", "train")]
    try:
        left = _packed(points, "_q", ["_h", "_i"], QUERY_BLOCK, paths[0])
        right = _packed(train, "_tx", ["_tid", "_ty"], TRAIN_BLOCK, paths[1])
        # a batch of blocks is in memory several times, in Spark and in Python
        with small_batches(spark, BATCH_BYTES):
            found = written(_met(left, right, _number(points, "_q"), _number(train, "_tx"), k, p), "found")
    finally:
        for path in paths:
            remove(spark, path)
    near = found.groupBy("_h", "_i").agg(F.flatten(F.collect_list("_near")).alias("_near"))
    return near.withColumn("_near", F.slice(F.array_sort("_near"), 1, k))


def _met(left: DataFrame, right: DataFrame, q_type: type, t_type: type, k: int, p: int) -> DataFrame:
    """The k nearest of every point among the blocks that a task has read; several tasks may tell of a point."""
    # a task reads one part of the points and all blocks of train; where parts are few, several tasks share them
    parts, cores = left.rdd.getNumPartitions(), left.sparkSession.sparkContext.defaultParallelism
    tasks = parts * min(right.rdd.getNumPartitions(), math.ceil(2 * cores / max(parts, 1)))
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl")).coalesce(max(tasks, 1))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bytes, bytes, list[_Found]]] = {}
        size = 0
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                part = {name: values[i].as_buffer() for name, values in column.items()}
                h, other = bytes(part["_h"]), bytes(part["_i"])
                rows, mark = len(h) // 8, h[:8] + other[:8]
                if mark not in held:
                    if size + rows * k > HELD:
                        yield from _told(held)
                        held, size = {}, 0
                    held[mark] = (h, other, _chunks(rows, k))
                    size += rows * k
                tid = np.frombuffer(part["_tid"], np.int64)
                q = np.frombuffer(part["_q"], q_type).reshape(rows, -1)
                t = np.frombuffer(part["_tx"], t_type).reshape(len(tid), -1)
                _search(held[mark][2], q, t, np.frombuffer(part["_ty"], np.float64), tid, k, p)
        yield from _told(held)

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("_h", "_i")), T.StructField("_near", _BEST)])
    return pairs.mapInArrow(meet, schema)


def _told(held: dict[bytes, tuple[bytes, bytes, list[_Found]]]) -> Iterator[pa.RecordBatch]:
    """What was found for the blocks of points."""
    for h, other, found in held.values():
        d, tid, y = (pa.array(np.concatenate([c.best[i] for c in found])) for i in (1, 2, 3))
        counts = np.concatenate([np.diff(c.ends(), prepend=0) for c in found])
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        near = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([d, tid, y], ["d", "id", "y"]))
        keys = [pa.array(np.frombuffer(v, np.int64)) for v in (h, other)]
        yield pa.RecordBatch.from_arrays([*keys, near], ["_h", "_i", "_near"])


def _number(df: DataFrame, vector: str) -> type:
    return np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64


def _packed(df: DataFrame, vector: str, others: Sequence[str], rows: int, path: str) -> DataFrame:
    """The table written as blocks of ``rows`` rows and ``BLOCK_BYTES`` at most; a block is one row,
    and each of its columns the bytes of the numbers of that column."""
    number = _number(df, vector)

    def cut(columns: list[np.ndarray], whole: bool) -> Iterator[list[np.ndarray]]:
        most = min(rows, max(BLOCK_BYTES // max(columns[0][:1].nbytes, 1), 1))
        for lo in range(0, len(columns[0]), most):
            if whole or lo + most <= len(columns[0]):
                yield [c[lo : lo + most] for c in columns]

    def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
        vectors = batch.column(0)
        sizes = vectors.value_lengths()
        if vectors.null_count or len(sizes.unique()) > 1:
            raise ValueError("the features are missing in a row, or not as many in every row")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(number, copy=False)
        rest = [batch.column(i + 1) for i in range(len(others))]
        # an id may be missing; it only breaks ties
        rest = [c.fill_null(np.iinfo(np.int64).min) if pa.types.is_integer(c.type) else c for c in rest]
        return [flat.reshape(len(vectors), -1), *[c.to_numpy(zero_copy_only=False) for c in rest]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            more = numbers(batch)
            held = [np.concatenate(pair) for pair in zip(held, more)] if held else more
            taken = 0
            for block in cut(held, False):
                taken += len(block[0])
                yield told(block)
            held = [c[taken:] for c in held]
        if held and len(held[0]):
            for block in cut(held, True):
                yield told(block)

    def told(block: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in block], [vector, *others])

    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in (vector, *others)])
    # small row groups: a reader holds one of them, and files are split between them
    small = {"parquet.block.row.count.limit": 2, "parquet.enable.dictionary": "false"}
    df.select(vector, *others).mapInArrow(pack, schema).write.options(**small).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _meet(left: DataFrame, right: DataFrame, key: list[str], k: int, p: int) -> DataFrame:
    """The k nearest of each ``_q`` among the ``_tx`` with the same key and bucket ``_b``."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out_q, out = [], []
        if len(a) and len(b):
            theirs = {bucket: part for bucket, part in b.groupby("_b", sort=False)}
            for bucket, mine in a.groupby("_b", sort=False):
                some = theirs.get(bucket)
                if some is None:
                    continue
                t, q = np.stack(some["_tx"].to_numpy()), np.stack(mine["_q"].to_numpy())
                found = _best(q, t, some["_ty"].to_numpy(), some["_tid"].to_numpy(), k, p)
                out += [[{"d": d, "id": i, "y": v} for d, i, v in row] for row in found]
                out_q += list(mine["_q"])
        return pd.DataFrame({"_q": pd.Series(out_q, dtype=object), "_near": pd.Series(out, dtype=object)})

    schema = T.StructType(
        [T.StructField("_q", T.ArrayType(T.DoubleType())), T.StructField("_near", _BEST)]
    )
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of all parts; they are cut to k before and after the shuffle."""
    entries = parts.select("_q", F.explode("_near").alias("e")).distinct()
    order = W.partitionBy("_q").orderBy("e.d", "e.id")
    kept = entries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return kept.groupBy("_q").agg(F.array_sort(F.collect_list("e")).alias("_near"))


def _with_hashes(
    queries: DataFrame, train: DataFrame, k: int, p: int, train_rows: int, size: int, broadcast_values: int
) -> DataFrame:
    points = written(queries.select("_q").distinct(), "points")
    n = points.count()
    probes = points.orderBy(F.xxhash64("_q", F.lit(3))).limit(PROBES)
    if train_rows * size <= broadcast_values:
        probed = _with_broadcast(probes.withColumn("_k", F.col("_q")), train, k, p)
    else:
        probed = _with_blocks(_hashed(probes, "_q"), train, k, p)
    far = probed.select(F.element_at("_near", -1)["d"].alias("d")).agg(F.percentile("d", 0.9).alias("d")).first()["d"]
    width = WIDTH * far if far else 1.0
    rng = np.random.default_rng(11)
    axes = rng.standard_cauchy((TABLES * PROJECTIONS, size)) if p == 1 else rng.normal(size=(TABLES * PROJECTIONS, size))
    shifts = rng.uniform(0, 1, TABLES * PROJECTIONS)

    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, size))
            cells = np.floor(x @ axes.T / width + shifts).astype(np.int64).reshape(len(x), TABLES, PROJECTIONS)
            with np.errstate(over="ignore"):
                mixed = np.broadcast_to(np.arange(TABLES, dtype=np.int64), (len(x), TABLES)) + 1
                for j in range(PROJECTIONS):
                    mixed = (mixed ^ cells[:, :, j]) * np.int64(0x5851F42D4C957F2D) + np.int64(0x14057B7EF767814F)
                    mixed = mixed ^ (mixed >> 31)
            yield pd.Series(list(mixed), dtype=object)

    hashed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    bucket = F.pandas_udf(hashed, T.ArrayType(T.LongType()))
    left = written(points.withColumn("_b", F.explode(bucket("_q"))), "hashed")
    right = written(train.withColumn("_b", F.explode(bucket("_tx"))), "hashed")
    # a bucket with many rows on either side is a grid of its own
    bins = max(math.ceil(TABLES * max(n / QUERY_BLOCK, train_rows / TRAIN_BLOCK)), 1)
    sizes = left.groupBy("_b").agg(F.count("*").alias("_n")).join(
        right.groupBy("_b").agg(F.count("*").alias("_m")), "_b"
    )
    hot = written(sizes.where(f"_n > {QUERY_BLOCK} OR _m > {TRAIN_BLOCK}"), "hot").select(
        "_b", F.ceil(F.col("_n") / QUERY_BLOCK).alias("_qs"), F.ceil(F.col("_m") / TRAIN_BLOCK).alias("_ts")
    )
    one = F.lit(1).cast("bigint")

    def dealt(side: DataFrame, mine: str, other: str, part: str, across: str, row: list[str]) -> DataFrame:
        known = side.join(hot, "_b", "left").withColumn(part, F.pmod(F.xxhash64(*row), F.coalesce(mine, one)))
        spread = known.withColumn(across, F.explode(F.sequence(one * 0, F.coalesce(other, one) - 1)))
        return spread.withColumn("_bin", F.pmod(F.xxhash64("_b"), F.lit(bins))).drop("_qs", "_ts")

    key = ["_bin", "_qb", "_tb"]
    found = _merged(_meet(dealt(left, "_qs", "_ts", "_qb", "_tb", ["_q"]), dealt(right, "_ts", "_qs", "_tb", "_qb", ["_tid", "_tx"]), key, k, p), k)
    found = written(found, "near")
    rest = written(points.join(found.where(F.size("_near") >= k), "_q", "left_anti"), "rest")
    near = found.where(F.size("_near") >= k)
    if not rest.isEmpty():
        kept = rest.withColumn("_p", F.col("_q"))
        searched = _with_points(kept, lambda some: _with_blocks(some, train, k, p), _few_moved)
        near = near.unionByName(searched.select(F.col("_p").alias("_q"), "_near"))
    return queries.join(near, "_q").drop("_q")


def vote(near: str, classes: Sequence[Any], weights: str):
    """Class shares among the neighbours, in class order; ``y`` holds class codes."""
    totals = []
    w = _weight_of(near, weights)
    for code in range(len(classes)):
        hits = F.filter(near, lambda e: e["y"] == F.lit(float(code)))
        totals.append(F.aggregate(hits, F.lit(0.0), lambda s, e: s + w(e)))
    return F.array(*totals)


def mean(near: str, weights: str):
    w = _weight_of(near, weights)
    top = F.aggregate(near, F.lit(0.0), lambda s, e: s + w(e) * e["y"])
    return top / F.aggregate(near, F.lit(0.0), lambda s, e: s + w(e))


def _weight_of(near: str, weights: str):
    """1, or 1/distance; an exact match outweighs everything else."""
    if weights == "uniform":
        return lambda e: F.lit(1.0)
    exact = F.exists(near, lambda e: e["d"] == 0)
    return lambda e: F.when(exact, (e["d"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), e["d"]))
