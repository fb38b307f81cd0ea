"""Mixing sources to target weights: a hypergeometric splitting tree deals out source blocks.

Each source's documents stand in one hash order as a stream of words, cut into blocks. A
source's target becomes a quota of blocks: whole passes over all its blocks and a part of
a last one, every pass in an order of its own. The quotas are split over the output shards
down a binary tree: at each node, the number of blocks of every source that go left is one
multivariate hypergeometric draw, so each shard gets its exact share of an exact total.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.ranking import repeat_rows
from tidemill.llm.common import WORD, bucket_bits, keep, word_count
from tidemill.llm.sharding import permute

MAX_SOURCES = 1_000_000
MAX_BLOCKS = 500_000_000  # numpy draws from fewer than a thousand million items
CHUNK = 65_536
CUT_BYTES = 1 << 22  # text that is cut at a time


@dataclass(frozen=True)
class MixPlan:
    """``share`` of all words is taken; ``weights`` repeat over the sources in code point
    order, NULL last; a source is taken ``max_passes`` times at most. Blocks have
    ``block_words`` words, fewer where a source would have less than ``min_blocks``, more
    where all passes would have more than ``MAX_BLOCKS`` (beyond some 2.5 * 10^11 words)."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    max_passes: float = 2.0
    shards: int = 40
    block_words: int = 1024
    min_blocks: int = 256
    seed: int = 0


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, max_passes: float) -> np.ndarray:
    """Words to take per source: by weight, but ``max_passes`` times a source at most, what
    is above going to the others by weight until none is above."""
    want, caps = share * float(sizes.sum()), max_passes * sizes
    free = sizes > 0
    out = np.zeros(len(sizes))
    while free.any():
        level = max(want - caps[~free & (sizes > 0)].sum(), 0.0) / weights[free].sum()
        over = free & (level * weights > caps)
        out[free] = level * weights[free]
        if not over.any():
            break
        out[over] = caps[over]
        free &= ~over
    return np.minimum(out, caps)


def split_quotas(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks from the root to one shard: blocks of each source it gets, and how many of the
    source's blocks go to the shards before it. Every node draws from a seed of its own, so
    all shards see the same tree."""
    low, high, mine = 0, shards, quota.astype(np.int64)
    before = np.zeros(len(quota), np.int64)
    total = int(mine.sum())
    edge = lambda s: s * total // shards  # noqa: E731  first draw of shard s
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(mine, edge(middle) - edge(low), method="marginals")
        if shard < middle:
            high, mine = middle, left
        else:
            low, before, mine = middle, before + left, mine - left
    return mine, before


def stream(docs: DataFrame, seed: int) -> DataFrame:
    """Size of every document and its place among its source's words."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    sized = docs.select("doc_id", "source", key.alias("h"), word_count(F.col("text")).alias("size"))
    # rows that repeat are counted first: they get their places as a range
    sized = keep(sized.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("_copies")), "sizes")
    bits = bucket_bits(sized.count())
    sized = sized.withColumn("_bucket", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    by_source = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("_copies")
    starts = sized.groupBy("source", "_bucket").agg(F.sum(words).alias("_n"))
    starts = starts.select(
        F.col("source").alias("_s"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(by_source), F.lit(0)).alias("_start"),
    )
    inside = (
        Window.partitionBy("source", "_bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    first = F.col("_start") + F.coalesce(F.sum(words).over(inside), F.lit(0))
    each = repeat_rows(placed.withColumn("_first", first), F.col("_copies"), "_copy_no")
    start = F.col("_first") + (F.col("_copy_no") - 1) * F.col("size")
    return keep(each.select("doc_id", "source", "h", "size", start.alias("start")), "stream")


def source_table(placed: DataFrame, plan: MixPlan) -> pd.DataFrame:
    """One row per source with its size, target, blocks and quota.

    Sources are a configured list, so their sums come to the driver; above ``MAX_SOURCES``
    this is refused.
    """
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sums.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out = pd.DataFrame([r.asDict() for r in rows], columns=["source", "source_size"])
    size = out["source_size"].fillna(0).to_numpy(np.int64)
    weights = np.resize(np.array(plan.weights, float), len(out))
    out["source_size"] = size
    out["target"] = targets(size, weights, plan.share, plan.max_passes)
    most_words = max(plan.block_words, math.ceil(plan.max_passes * float(size.sum()) / MAX_BLOCKS))
    out["block"] = np.clip(-(-size // plan.min_blocks), 1, most_words)
    out["blocks"] = -(-size // out["block"])
    passes = np.divide(out["target"], size, out=np.zeros(len(out)), where=size > 0)
    most = np.floor(plan.max_passes * out["blocks"])
    out["quota"] = np.minimum(np.rint(passes * out["blocks"]), most).astype(np.int64)
    out["number"] = np.arange(len(out))
    return out


def draws(placed: DataFrame, sources: pd.DataFrame, plan: MixPlan) -> DataFrame:
    """Every block drawn: shard, source number, pass and block."""
    spark = placed.sparkSession
    quota, shards, seed = sources["quota"].to_numpy(np.int64), plan.shards, plan.seed

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                n, before = split_quotas(quota, shards, int(shard), seed)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.int32(shard), "number": some, "n": n[some], "before": before[some]})

    tasks = min(shards, 4 * spark.sparkContext.defaultParallelism)
    dealt = spark.range(0, shards, 1, tasks).mapInPandas(deal, "shard int, number long, n long, before long")
    # a long run of draws becomes chunks first, so that no array grows with it
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))
    dealt = dealt.where("n > 0").withColumn("_c", chunk)
    upto = F.least(F.col("_c") + CHUNK, F.col("n")) - 1
    each = dealt.withColumn("draw", F.explode(F.sequence(F.col("before") + F.col("_c"), F.col("before") + upto)))
    known = spark.createDataFrame(
        [(int(r.number), int(r.blocks)) for r in sources.itertuples()], "number long, blocks long"
    )
    each = each.join(F.broadcast(known), "number")  # one row per source, bounded above
    turn = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    salt = F.xxhash64(F.lit(plan.seed), F.col("number"), turn)
    block = permute(F.pmod("draw", "blocks"), F.col("blocks"), salt)
    return each.select("shard", "number", turn.alias("turn"), block.alias("block"), "draw")


def mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces of documents, and all documents with their targets.

    Pieces: ``shard``, ``order_key`` (sort a shard by it to shuffle it), ``doc_id``,
    ``source``, ``h`` and ``start`` (which tell documents with equal ids apart), ``turn``,
    ``first_word``, ``n_words``. Documents: ``doc_id, source, h, size, start, source_size,
    target``. A NULL or blank text has no words and is never drawn; a NULL source is a
    source; repeated rows are documents of their own; no rows give no pieces. Columns other
    than doc_id, source and text are ignored.
    """
    spark = docs.sparkSession
    placed = stream(docs, plan.seed)
    sources = source_table(placed, plan)
    known = spark.createDataFrame(
        [
            (None if r.source is None else str(r.source), int(r.number), int(r.source_size), float(r.target), int(r.block))
            for r in sources.itertuples()
        ],
        "_s string, number long, source_size long, target double, _block long",
    )
    # one row per source, bounded by MAX_SOURCES
    placed = placed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    low = F.floor(F.col("start") / F.col("_block")).cast("long")
    high = F.floor((F.col("start") + F.col("size") - 1) / F.col("_block")).cast("long")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(low, high)))
    first = F.greatest(F.col("block") * F.col("_block") - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * F.col("_block") - F.col("start"), F.col("size"))
    pieces = cut.select(
        "number", "block", "doc_id", "source", "h", "start", first.alias("first_word"), (last - first).alias("n_words")
    )
    mixed = pieces.join(draws(placed, sources, plan), ["number", "block"])
    order = F.xxhash64(F.lit(plan.seed), F.col("shard"), F.col("number"), F.col("draw"), F.col("start"))
    out = mixed.select(
        "shard", order.alias("order_key"), "doc_id", "source", "h", "start", "turn", "first_word", "n_words"
    )
    return out, placed.drop("number", "_block")


def word_spans(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The text from the first to the last word of each span (first word, end)."""
    at = [m.span() for m in re.finditer(WORD, text)]
    return [text if (a, b) == (0, len(at)) else text[at[a][0] : at[b - 1][1]] for a, b in spans]


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix as rows like ``docs``: doc_id, text, lang (if there is one), source, n_chars.

    Neighbouring pieces of one pass are put together again, so a document that is drawn
    whole keeps its whole text; otherwise the text runs from its first to its last word. Rows
    stand shard after shard in the shuffled order of their first blocks: partitions are ranges
    of (shard, order). Other columns are left out.
    """
    pieces, _ = mix(docs, plan)
    # all pieces of one document: as many as it has blocks, twice
    spans = pieces.groupBy("doc_id", "h", "start").agg(
        F.sort_array(F.collect_list(F.struct("turn", "first_word", "n_words", "shard", "order_key"))).alias("_spans")
    )
    key = F.xxhash64(F.lit(plan.seed), F.col("doc_id"), F.col("source"), F.col("text"))
    names = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    texts = docs.select(*names, key.alias("h")).dropDuplicates(["doc_id", "h"])
    here = spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h")
    joined = texts.join(here, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    joined = joined.select(*names, "_spans")
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    made = [*names, "n_chars", "shard", "order_key"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_chars long, shard int, order_key long"

    def runs(spans: list[dict]) -> list[list[int]]:
        """First word, end, shard and order of pieces that follow each other in a pass."""
        out: list[list[int]] = []
        for s in spans:
            a, b = s["first_word"], s["first_word"] + s["n_words"]
            if out and out[-1][4] == s["turn"] and out[-1][1] == a:
                out[-1][1] = b
            else:
                out.append([a, b, s["shard"], s["order_key"], s["turn"]])
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text, n_chars, shard, order, held = [], [], [], [], [], 0
            for i in range(batch.num_rows):
                whole, found = batch.column(1)[i].as_py(), runs(batch.column(len(names))[i].as_py())
                for piece, (_, _, s, o, _) in zip(word_spans(whole, [(r[0], r[1]) for r in found]), found):
                    row.append(i)
                    text.append(piece)
                    n_chars.append(len(piece))
                    shard.append(s)
                    order.append(o)
                    held += len(piece)
                if held > CUT_BYTES or i == batch.num_rows - 1:
                    own = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(names))]
                    own[1] = pa.array(text, pa.string())
                    more = [pa.array(n_chars, pa.int64()), pa.array(shard, pa.int32()), pa.array(order, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own, *more], made)
                    row, text, n_chars, shard, order, held = [], [], [], [], [], 0

    rows = joined.mapInArrow(cut, schema)
    ordered = rows.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key", "doc_id", "n_chars")
    return ordered.drop("shard", "order_key")


def run(spark, sf: str) -> DataFrame:
    pieces, placed = mix(spark.read.parquet(f"{sf}/documents.parquet"))
    taken = pieces.groupBy("doc_id", "source", "h", "start").agg(F.sum("n_words").alias("_taken"))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "h", "start")], "_taken")
    # documents without words stand at the start of the next one, but are never drawn
    match = (F.col("h") == F.col("_h")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    match = match & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
    out = placed.join(taken, match, "left")
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"), "source"
    )
