"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

The rows are dealt into lanes. In a lane they are ordered by length and cut into buckets of
similar length; a bucket keeps, for every coordinate, the list of its unit vectors' values
in sorted order. To reach a score, a row must point near the anchor: its value in each
coordinate lies in a range that follows from the anchor's value and the cosine still
needed. The anchor's largest coordinates are its focus: the rows inside all their ranges
are candidates, and only these are multiplied out, in whole numbers. Buckets too short to
reach the score end the search, and the score needed rises with what has been found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import keep

LANE_ROWS = 65_536  # rows, or anchors, that meet in one group at most (about)
LEAST_LANES = 8
BUCKET_ROWS = 2_048
FOCUS = 5
SEEDS = 48
SLACK = 1e-9  # ranges are widened by more than rounding can be off
EXACT = float(1 << 53)  # whole numbers up to here are exact in a double


class Bucket:
    """Vectors of similar length with a sorted list of values per coordinate."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
        self.rows, self.vectors, self.longest = rows, vectors, float(lengths[0])
        unit = vectors.astype(float) / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").astype(np.int32)
        self.values = np.ascontiguousarray(np.take_along_axis(unit, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def near(self, coordinate: int, value: float, count: int) -> np.ndarray:
        """Rows (of the bucket) whose value lies near the given one in the sorted list."""
        at = int(np.searchsorted(self.values[coordinate], value))
        lo = max(0, min(at - count // 2, len(self.rows) - count))
        return self.order[coordinate, lo : lo + count]

    def feasible(self, anchor: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose cosine to the anchor (a unit vector) can reach the one needed."""
        inside, reach = None, math.acos(cosine)
        for f in focus:
            turn = math.acos(min(1.0, max(-1.0, anchor[f])))
            low = -2.0 if turn + reach >= math.pi else math.cos(turn + reach) - SLACK
            high = 2.0 if turn - reach <= 0 else math.cos(turn - reach) + SLACK
            lo, hi = np.searchsorted(self.values[f], [low, high])
            some = self.order[f, lo:hi]
            if inside is None:
                inside = np.zeros(len(self.rows), np.uint8)
                inside[some] = 1
            else:
                inside[some] += 1
        return np.flatnonzero(inside == len(focus))


class Lane:
    """All rows of a lane, as buckets by falling length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, size: int = BUCKET_ROWS) -> None:
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.checked = ids, 0
        self.buckets = [
            Bucket(some, vectors[some], lengths[some]) for some in (order[i : i + size] for i in range(0, len(order), size))
        ]

    def strongest(self, anchor: np.ndarray, able: np.ndarray, ranges: list[tuple], k: int) -> list[tuple]:
        """Per range of scores ``(low, high)``, both ends inside: scores and rows of the ``k``
        highest among the ``able`` rows, equal scores by smaller id."""
        length = math.sqrt((anchor.astype(float) ** 2).sum())
        unit = anchor.astype(float) / max(length, 1e-300)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        best = [(np.zeros(0, object if anchor.dtype == object else np.int64), np.zeros(0, np.int64)) for _ in ranges]
        least = [low for low, _ in ranges]
        for bucket in self.buckets:
            allowed = able[bucket.rows]
            if len(focus):
                # a few likely rows say what score is surely reached
                some = bucket.near(int(focus[0]), unit[focus[0]], SEEDS)
                scores = _products(bucket.vectors[some[allowed[some]]], anchor)
                for j, (low, high) in enumerate(ranges):
                    fit = np.sort(scores[(scores >= low) & (scores <= high)])
                    if len(fit) >= k:
                        least[j] = max(least[j], fit[-k])
            need, most = min(least), length * bucket.longest
            if need > 0:
                if need > most * (1 + SLACK):
                    break  # the rest is shorter still
                rows = bucket.feasible(unit, focus, max(0.0, min(1.0, float(need) / most * (1 - SLACK))))
            else:
                rows = np.arange(len(bucket.rows))
            rows = rows[allowed[rows]]
            self.checked += len(rows)
            scores = _products(bucket.vectors[rows], anchor)
            for j, (low, high) in enumerate(ranges):
                fit = (scores >= max(low, least[j])) & (scores <= high)
                if fit.any():
                    s = np.concatenate([best[j][0], scores[fit]])
                    r = np.concatenate([best[j][1], bucket.rows[rows[fit]]])
                    top = np.lexsort((self.ids[r], -s))[:k]
                    best[j] = s[top], r[top]
                    if len(top) == k:
                        least[j] = max(least[j], s[top[-1]])
        return best


def _products(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    found = vectors @ anchor
    return found if found.dtype == object else found.astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of equal width; what a list lacks counts as zero."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    first = np.cumsum(sizes) - sizes
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[row, np.arange(len(values)) - np.repeat(first, sizes)] = values
    return out


def _exact(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as doubles, if no product can leave the whole numbers that a double holds
    exactly, else as Python's integers."""
    width = max([1, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (left, right))])
    a, b = _matrix(left, width), _matrix(right, width)
    largest = [float(np.abs(m.astype(float)).max(initial=0)) for m in (a, b)]
    fits = max(largest[0] ** 2, largest[0] * largest[1]) * width < EXACT
    return (a.astype(float), b.astype(float)) if fits else (a.astype(object), b.astype(object))


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    vectors, wanted = _exact(rows.column("q"), anchors.column("q"))
    ids = rows.column("vec_id").to_numpy()
    codes = pa.concat_tables([rows.select(["label"]), anchors.select(["label"])]).column("label").combine_chunks()
    codes = codes.dictionary_encode().indices.to_numpy()
    lane, found = Lane(ids, vectors), []
    own, theirs = codes[: len(ids)], codes[len(ids) :]
    for i, anchor_id in enumerate(anchors.column("anchor_id").to_numpy()):
        able = (own == theirs[i]) & (ids != anchor_id)
        scores, best = lane.strongest(wanted[i], able, [(-math.inf, math.inf)], k)[0]
        found += [(i, r, s) for r, s in zip(best, scores)]
    at = np.array([f[0] for f in found], np.int64)
    return pa.table(
        {
            "anchor_id": anchors.column("anchor_id").take(pa.array(at)),
            "anchor_key": anchors.column("anchor_key").take(pa.array(at)),
            "positive_id": pa.array(ids[np.array([f[1] for f in found], np.int64)]),
            "positive_score": pa.array([int(f[2]) for f in found], pa.int64()),
        }
    )


def _negatives(rows: pa.Table, anchors: pa.Table, k: int, share: int) -> pa.Table:
    vectors, wanted = _exact(rows.column("q"), anchors.column("q"))
    ids = rows.column("vec_id").to_numpy()
    codes = pa.concat_tables([rows.select(["label"]), anchors.select(["label"])]).column("label").combine_chunks()
    codes = codes.dictionary_encode().indices.to_numpy()
    lane, found = Lane(ids, vectors), []
    own, theirs = codes[: len(ids)], codes[len(ids) :]
    for i, tops in enumerate(anchors.column("scores").to_pylist()):
        ranges = [(-(-share * top // 100), top) for top in tops]
        for top, (scores, best) in zip(tops, lane.strongest(wanted[i], own != theirs[i], ranges, k)):
            found += [(i, r, s, top) for r, s in zip(best, scores)]
    at = pa.array(np.array([f[0] for f in found], np.int64))
    return pa.table(
        {
            "anchor_id": anchors.column("anchor_id").take(at),
            "anchor_key": anchors.column("anchor_key").take(at),
            "negative_id": pa.array(ids[np.array([f[1] for f in found], np.int64)]),
            "negative_score": pa.array([int(f[2]) for f in found], pa.int64()),
            "positive_score": pa.array([f[3] for f in found], pa.int64()),
        }
    )


def quantized(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, q``: vectors as whole numbers, ``floor(scale * x)``. Rows with a NULL
    vec_id, label or vector, or with a NULL or non-finite component, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    q = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), q.alias("q"))


def mine_hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` have ``vec_id, label, embedding``; ``anchors`` says which vec_ids are anchors. A
    score is the inner product of the vectors as :func:`quantized`. An anchor's positives
    are the highest scores among rows of its label with another vec_id; a positive's
    negatives the highest among rows of other labels between ``share`` percent of the
    positive's score and that score (none for a score below zero). Equal scores go by
    smaller vec_id. Repeated rows each take a rank; anchors that repeat in all three
    columns are one. Vectors of unlike sizes are filled up with zeros. Other columns are ignored; no
    rows give no rows. A product beyond 64 bits is an error.
    """
    base = keep(quantized(rows), "vectors")
    chosen = keep(
        base.where(anchors).distinct().select(
            F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "q").alias("anchor_key"), "label", "q"
        ),
        "anchors",
    )
    lanes = max(LEAST_LANES, -(-base.count() // LANE_ROWS))
    chunks = max(1, -(-chosen.count() // LANE_ROWS))
    # one row may be there many times: lanes are drawn by the place in the written table
    dealt = base.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "lane", F.pmod(F.xxhash64("_at"), F.lit(lanes))
    )
    dealt = dealt.drop("_at").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(side: DataFrame, work, schema: str) -> DataFrame:
        spread = side.withColumn("chunk", F.pmod(F.col("anchor_key"), F.lit(chunks)).cast("int"))
        spread = spread.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        return dealt.groupBy("lane", "chunk").cogroup(spread.groupBy("lane", "chunk")).applyInArrow(work, schema)

    key = ["anchor_id", "anchor_key"]
    near = meet(
        chosen, lambda a, b: _positives(a, b, positives),
        "anchor_id long, anchor_key long, positive_id long, positive_score long",
    )
    order = Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    best = keep(best, "positives")
    told = best.where("positive_score >= 0").groupBy(*key).agg(F.collect_set("positive_score").alias("scores"))
    hard = meet(
        chosen.join(told, key), lambda a, b: _negatives(a, b, negatives, share),
        "anchor_id long, anchor_key long, negative_id long, negative_score long, positive_score long",
    )
    pairs = best.join(hard, [*key, "positive_score"])
    order = Window.partitionBy(*key, "place").orderBy(F.desc("negative_score"), "negative_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def run(spark, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
