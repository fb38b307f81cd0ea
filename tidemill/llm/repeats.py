"""Repeated passages: bytes inside strings that start in more than one place are removed.

Every place where ``MATCH`` bytes remain is a suffix, and suffixes that begin with the
same ``MATCH`` bytes belong in one bucket; a suffix alone in its bucket is kept. Buckets are
refined step by step, and what is alone in a bucket leaves at once:

1. Initial buckets by q-gram. A suffix goes by the q-gram with the smallest hash in its
   first ``MATCH`` bytes and the distance to it, which depend on those bytes alone. Suffixes that
   follow each other mostly share that q-gram and stay together as a run, so that about one
   row in seventy bytes is shuffled. A run whose q-gram no other run has is unique.
2. Runs that are equal from their first suffix to the end of their last are settled together.
3. In q-gram buckets that hold unequal runs, one of each kind goes on, suffix by suffix, by
   pointers: suffixes are sorted by the bucket of their q-gram and the bucket of the q-gram
   at a later offset, which gives new bucket pointers for twice the length; the same is
   done with these pointers at a later offset, until the buckets agree on ``MATCH`` bytes.

Many q-gram buckets are refined together in one task. One with very many kinds of runs is
refined by grouping in Spark instead, so that no bucket has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import keep

MATCH = 200
GRAM = MATCH // 4  # pointers double twice: 50, 100, 200 bytes
PIECE = 1 << 18  # suffixes that are looked at together
BIN_RUNS = 8_192  # runs that one task refines
HEAVY = 2_000  # kinds of runs of a q-gram from which Spark groups its suffixes
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Roller:
    """Hashes of all substrings of a text: differences of its prefix sums."""

    def __init__(self, seed: int) -> None:
        with np.errstate(over="ignore"):
            self.values = _mix(np.arange(1, 257, dtype=U) + U(seed * 1_000))
            self.base = int(_mix(np.array([seed + 77], U))[0]) | 1
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (self.base, inverse)
            )

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, lo, hi) -> np.ndarray:
        """Hashes of the bytes from ``lo`` up to ``hi``."""
        return _mix((prefixes[hi] - prefixes[lo]) * self.down[lo])

    def grams(self, data: np.ndarray) -> np.ndarray:
        sums = self.prefixes(data)
        n = max(0, len(data) - GRAM + 1)
        return _mix((sums[GRAM:] - sums[:n]) * self.down[:n])


GRAMS, SPANS = Roller(1), Roller(2)


def runs_of(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of suffixes that share their q-gram: first suffix, how many, hash of the q-gram,
    hash of all bytes from the first suffix to the end of the last."""
    data, last = np.frombuffer(text, np.uint8), len(text) - MATCH + 1
    for begin in range(0, last, PIECE):
        part = data[begin : min(begin + PIECE, last) + MATCH - 1]
        grams = GRAMS.grams(part)
        least, at, width = grams, np.arange(len(grams), dtype=np.int32), 1
        while width < MATCH - GRAM + 1:
            step = min(width, MATCH - GRAM + 1 - width)
            later = least[step:] < least[:-step]
            at = np.where(later, at[step:], at[:-step])
            least = np.minimum(least[:-step], least[step:])
            width += step
        cut = np.flatnonzero(np.diff(at)) + 1
        lo = np.concatenate([[0], cut])
        count = np.diff(np.concatenate([lo, [len(at)]]))
        whole = SPANS.of(SPANS.prefixes(part), lo, lo + count - 1 + MATCH)
        shape = (at[lo] - lo).astype(U) << U(16) | count.astype(U)
        yield lo + begin, count, grams[at[lo]], _mix(whole ^ _mix(shape))


def _packed(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Suffixes from ``lo`` on in one number; a run has at most 151."""
    return lo.astype(np.int64) << 8 | count


def documents(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: rows are told apart by a hash of id and text; the text as bytes."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, doc_id.isNull(), text).alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def packed_texts(rows: DataFrame) -> DataFrame:
    """The same with texts compressed, to be shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstd.ZstdCompressor(level=1)
        for batch in batches:
            made = pa.array([press.compress(v.as_buffer()) for v in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["row", "doc_id", "text"])

    return rows.mapInArrow(work, "row long, doc_id long, text binary")


def suffix_runs(rows: DataFrame) -> DataFrame:
    """``gram, span, row, place`` of every run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_numpy(), batch.column(1)):
                for lo, count, gram, span in runs_of(text.as_buffer()):
                    arrays = [gram.view(np.int64), span.view(np.int64), np.full(len(lo), row), _packed(lo, count)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gram", "span", "row", "place"])

    long_enough = rows.where(F.octet_length("text") >= MATCH).select("row", "text")
    return long_enough.mapInArrow(_gathered(work), "gram long, span long, row long, place long")


def _gathered(work, rows: int = 1 << 16):
    """``work`` with its small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for made in work(batches):
            held.append(made)
            size += made.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def cut_out(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The bytes of each run in ``kinds`` (``row, gram, place, alone, heavy``) as ``data``."""
    lists = kinds.groupBy("row").agg(F.collect_list(F.struct("gram", "place", "alone", "heavy")).alias("runs"))
    joined = texts.join(lists, "row").select("row", "text", "runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstd.ZstdDecompressor()
        names = ["gram", "row", "place", "alone", "heavy", "data"]
        for batch in batches:
            for row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, fields = unpress.decompress(text.as_buffer()), runs.values
                places = fields.field("place").to_numpy()
                lo, count = places >> 8, places & 255
                data = pa.array([text[a : a + n - 1 + MATCH] for a, n in zip(lo, count)], pa.binary())
                kept = [fields.field(k) for k in ("gram", "place", "alone", "heavy")]
                yield pa.RecordBatch.from_arrays([kept[0], pa.array([row] * len(lo), pa.int64()), *kept[1:], data], names)

    schema = "gram long, row long, place long, alone boolean, heavy boolean, data binary"
    return joined.mapInArrow(_gathered(work, 1 << 13), schema)


def _suffixes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that stand one after the other: the text, the place in it and the place in
    all for each suffix."""
    count = np.maximum(sizes - MATCH + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, inside, inside + (np.cumsum(sizes) - sizes)[text]


def _buckets(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers by sorting on the keys, and how many each bucket holds."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    pointer = np.empty(len(order), np.int64)
    pointer[order] = np.cumsum(new)
    return pointer, np.bincount(pointer)


def refine(data: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in it of the suffixes that share ``MATCH`` bytes with another."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    text, inside, at = _suffixes(sizes)
    if not len(at):
        return text, inside
    grams = GRAMS.grams(flat)
    half = np.unique(np.concatenate([at, at + 2 * GRAM]))
    pointer, held = _buckets(grams[half + GRAM], grams[half])  # buckets of 100 bytes
    of = np.full(len(flat), -1, np.int64)
    of[half] = pointer
    first, second = of[at], of[at + 2 * GRAM]
    alive = np.flatnonzero((held[first] > 1) & (held[second] > 1))  # else alone already
    pointer, held = _buckets(second[alive], first[alive])  # buckets of 200 bytes
    shared = alive[held[pointer] > 1] if len(alive) else alive
    return text[shared], inside[shared]


def _intervals(text: np.ndarray, inside: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple:
    """Suffixes in a row as one place."""
    begins = np.ones(len(text), bool)
    begins[1:] = (text[1:] != text[:-1]) | (inside[1:] != inside[:-1] + 1)
    lo = np.flatnonzero(begins)
    count = np.diff(np.concatenate([lo, [len(text)]]))
    return row[text[lo]], _packed(first[text[lo]] + inside[lo], count)


def _refine_bin(runs: pa.Table) -> pa.Table:
    row, place = runs.column("row").to_numpy(), runs.column("place").to_numpy()
    order = np.lexsort((place, row))
    keep_it = np.ones(len(order), bool)  # rows of documents that repeat bring a run twice
    keep_it[1:] = (row[order[1:]] != row[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
    chosen = order[keep_it]
    data = runs.column("data").take(pa.array(chosen))
    sizes = pc.binary_length(data).to_numpy().astype(np.int64)
    row, place, alone = row[chosen], place[chosen], runs.column("alone").to_numpy()[chosen]
    text, inside = refine(data.to_pylist(), sizes)
    mine = alone[text]
    rows, places = _intervals(text[mine], inside[mine], row, place >> 8)
    return pa.table({"row": pa.array(rows, pa.int64()), "place": pa.array(places, pa.int64())})


def refine_by_grouping(runs: DataFrame) -> DataFrame:
    """The same refinement for q-grams with very many kinds of runs: ``row, place``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes = pc.binary_length(part.column("data")).to_numpy(zero_copy_only=False).astype(np.int64)
                grams = GRAMS.grams(np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8))
                text, inside, at = _suffixes(sizes)
                first = part.column("place").to_numpy() >> 8
                arrays = [part.column("row").to_numpy()[text], first[text] + inside]
                arrays += [grams[at + k * GRAM].view(np.int64) for k in range(4)]
                alone = part.column("alone").take(pa.array(text))
                names = ["row", "at", "b0", "b1", "b2", "b3", "alone"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), alone], names)

    schema = "row long, at long, b0 long, b1 long, b2 long, b3 long, alone boolean"
    rows = runs.where("heavy").drop("heavy").mapInArrow(work, schema)
    for keys in (["b0", "b1"], ["b0", "b2", "b3"]):
        # the pointer of a bucket is its first suffix; b0 carries it on
        here = F.struct("row", "at")
        held = rows.groupBy(*keys).agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where("lo <> hi")
        pointer = F.xxhash64("lo.row", "lo.at")
        rows = rows.join(held.select(*keys, pointer.alias("pointer")), keys).drop("b0").withColumnRenamed("pointer", "b0")
        rows = keep(rows, "buckets")
    return rows.where("alone").select("row", (F.shiftleft("at", 8) + 1).alias("place"))


def find_repeats(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``row, place`` of suffixes whose first ``MATCH`` bytes start elsewhere too; a place is
    ``first * 256 + how many``."""
    rows = documents(docs)
    runs = suffix_runs(rows)
    # written before it is joined, so that Spark can split a hot q-gram's side of the join
    grams = keep(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    repeated = keep(runs.join(grams, "gram"), "runs")
    spans = repeated.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("first"))
    spans = keep(spans, "spans")
    settled = repeated.join(spans.where("n > 1").select("gram", "span"), ["gram", "span"]).select("row", "place")
    mixed = spans.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    kinds = spans.join(keep(mixed, "mixed"), "gram").select(
        "gram", "first.row", "first.place", (F.col("n") == 1).alias("alone"), (F.col("kinds") > heavy).alias("heavy")
    )
    kinds = keep(kinds, "kinds")
    n, n_heavy = kinds.agg(F.count("*"), F.coalesce(F.sum(F.col("heavy").cast("long")), F.lit(0))).first()
    if n == 0:
        return settled
    cut = keep(cut_out(packed_texts(rows), kinds), "cut")
    bins = F.pmod(F.xxhash64("gram"), F.lit(-(-n // BIN_RUNS)))
    light = cut.where("NOT heavy").groupBy(bins.alias("bin")).applyInArrow(_refine_bin, "row long, place long")
    found = settled.unionByName(light)
    return found.unionByName(refine_by_grouping(cut)) if n_heavy else found


def remove_repeats(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, spans, kept``.

    ``spans`` are the maximal removed runs of bytes (``begin``, ``end`` behind the last), ``kept`` the
    remaining bytes, which need not be whole characters. A NULL or empty text has no bytes;
    texts below ``MATCH`` bytes stay whole. Rows that repeat are copies of each other, so each
    loses what is long enough. Columns other than doc_id and text are ignored; an empty
    table gives no rows.
    """
    marks = find_repeats(docs, heavy).groupBy("row").agg(F.collect_set("place").alias("places"))
    texts = packed_texts(documents(docs)).join(marks, "row", "left").select("doc_id", "text", "places")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstd.ZstdDecompressor()
        pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            ids, sizes, spans, kept, held = [], [], [], [], 0
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = unpress.decompress(text.as_buffer())
                places = np.sort(places.values.to_numpy()) if places.is_valid else np.zeros(0, np.int64)
                lo = places >> 8
                hi = lo + (places & 255) - 1 + MATCH
                reach = np.maximum.accumulate(hi) if len(hi) else hi
                cut = np.flatnonzero(lo[1:] > reach[:-1]) + 1
                begins, ends = lo[np.concatenate([[0], cut])] if len(lo) else lo, reach[np.concatenate([cut - 1, [-1]])] if len(lo) else hi
                edges = [0, *np.stack([begins, ends], 1).reshape(-1).tolist(), len(text)]
                ids.append(doc_id)
                sizes.append(len(text))
                spans.append([{"begin": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist())])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                held += len(text)
                if held > PIECE * 16:
                    yield made(ids, sizes, spans, kept, pair)
                    ids, sizes, spans, kept, held = [], [], [], [], 0
            yield made(ids, sizes, spans, kept, pair)

    def made(ids: list, sizes: list, spans: list, kept: list, pair: pa.DataType) -> pa.RecordBatch:
        arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "spans", "kept"])

    return texts.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")


def run(spark, sf: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (
  SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS m
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
hit AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
  FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
span AS (
  SELECT r, min(i) AS b, max(i) + 200 AS e
  FROM (SELECT r, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM hit)
  GROUP BY r, g),
gap AS (SELECT r, b, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY b) AS p FROM span),
cut AS (
  SELECT r, count(*) AS n, sum(e - b) AS removed, max(e) AS last,
         string_agg(substring(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY b) AS head
  FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(head || substring(h, 2 * last + 1, len(h)), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
