"""Ranked lexical search with pipelined term partitions.

The terms of the items have owners: the rarest terms belong to the first owner, the most
frequent to the last. A bundle of items travels from owner to owner and carries a sparse
set of accumulators, one per item and document reached so far. At each owner it meets the
postings of that owner's terms by cogroup, adds their whole-number contributions, and goes
on. Documents are cut into shards, and a bundle makes its tour once per shard, so that all
bundles, shards and terms of an owner are worked on side by side.

Between owners the score of the last place that counts is known for each item from what
has been added so far. An accumulator that the terms still to come cannot lift to that
score is dropped, and a document that no rarer term reached gets one only if those terms
alone could reach it. Both bounds are exact, so the result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import ascii_lower, keep

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_DOCS = 8_192  # documents of a shard at most
SHARD_BYTES = 1 << 27
SLICE_BYTES = 1 << 22  # text that is split into terms at a time
BUNDLE_ITEMS = 256
OWNERS = 4
FILTER_TERMS = 200_000  # item terms that are handed to the tasks as a set; more are joined
BROADCAST_ROWS = 200_000


def _term_bytes() -> np.ndarray:
    """What each byte becomes: A-Z lower-cased, bytes that belong to no term a blank."""
    to = np.arange(256, dtype=np.uint8)
    upper = slice(ord("A"), ord("Z") + 1)
    to[:128] = ord(" ")
    for lo, hi in ((b"0", b"9"), (b"a", b"z")):
        to[lo[0] : hi[0] + 1] = np.arange(lo[0], hi[0] + 1)
    to[upper] = np.arange(ord("a"), ord("z") + 1)
    return to


TERM_BYTES = _term_bytes()


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts (no NULLs), one after the other, and the text each belongs to."""
    texts = pa.concat_arrays([texts])  # buffers without an offset
    _, offsets, data = texts.buffers()
    flat = TERM_BYTES[np.frombuffer(data or b"", np.uint8)]
    clean = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(flat)])
    split = pc.ascii_split_whitespace(clean)
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "")
    return words.filter(full), np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]


class Shard:
    """Documents and postings that a task has gathered for its next shard."""

    def __init__(self) -> None:
        self.doc_ids, self.sizes, self.bytes = [], [], 0
        self.parts: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: pa.Array, texts: pa.Array, wanted: pa.Array | None) -> None:
        words, doc = split_terms(texts)
        n = np.bincount(doc, minlength=len(texts))
        if wanted is not None:
            inside = pc.is_in(words, value_set=wanted)
            words, doc = words.filter(inside), doc[inside.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        both, tf = np.unique(code * len(texts) + doc, return_counts=True)
        self.parts.append((coded.dictionary.to_pylist(), both // max(len(texts), 1), both % max(len(texts), 1) + len(self.sizes), tf))
        self.doc_ids += doc_ids.to_pylist()
        self.sizes += n.tolist()
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row of the documents (its term is NULL), and one per term."""
        sizes = np.array(self.sizes, np.int64)
        names: dict[str, int] = {}
        codes, docs, counts = [], [], []
        for words, code, doc, tf in self.parts:
            place = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
            codes.append(place[code])
            docs.append(doc)
            counts.append(tf)
        code, doc, tf = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (codes, docs, counts))
        order = np.lexsort((doc, code))
        code, doc, tf = code[order], doc[order], tf[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])
        ends = pa.array(np.concatenate([[0], ends]).astype(np.int32))  # the first row has no postings
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (doc, tf, sizes[doc])]
        none = pa.nulls(len(names), pa.list_(pa.int64()))
        whole = [
            pa.concat_arrays([pa.array([x], pa.list_(pa.int64())), none]) for x in (self.doc_ids, self.sizes)
        ]
        terms = pa.array([None, *names], pa.string())
        names_of = ["shard", "term", "docs", "tf", "n", "doc_ids", "sizes"]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(terms), pa.int64()), terms, *lists, *whole], names_of)


def index_documents(docs: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Postings by shard: ``shard, term, docs, tf, n``, with a row without a term per shard
    that holds its ``doc_ids`` and ``sizes`` (numbers of terms). ``docs`` are places in the shard.

    A shard is what one task reads until it has enough documents or text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = (
        "shard long, term string, docs array<long>, tf array<long>, n array<long>, "
        "doc_ids array<long>, sizes array<long>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, shard = TaskContext.get().partitionId() << 32, 0, Shard()
        only = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                room = SHARD_DOCS - len(shard.sizes)
                before = size[lo - 1] if lo else 0
                hi = max(lo + 1, min(lo + room, int(np.searchsorted(size, before + SLICE_BYTES, "right"))))
                part = batch.slice(lo, hi - lo)
                shard.add(part.column(0), part.column(1), only)
                lo = hi
                if len(shard.sizes) >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                    yield shard.rows(base + made)
                    made, shard = made + 1, Shard()
        if shard.sizes:
            yield shard.rows(base + made)

    return slim.mapInArrow(work, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term``: the different terms of each different item."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)))
    rows = items.select("item_id", "text").distinct()
    return rows.select(
        F.xxhash64("item_id", "text", F.col("item_id").isNull()).alias("item"), "item_id", F.explode(words).alias("term")
    )


class Accumulators:
    """Scores of a bundle's items over the documents of a shard, while they are added to."""

    def __init__(self, items: int, docs: int, packed: bytes, scores: bytes) -> None:
        self.shape = items, docs
        self.sums, self.alive = np.zeros(items * docs, np.int64), np.zeros(items * docs, bool)
        places = np.frombuffer(packed, np.int32)
        self.sums[places] = np.frombuffer(scores, np.int64)
        self.alive[places] = True
        self.sums, self.alive = self.sums.reshape(self.shape), self.alive.reshape(self.shape)

    def add(self, items: np.ndarray, docs: np.ndarray, gain: np.ndarray, opens: np.ndarray) -> None:
        """``gain`` of the documents for all the items; only where ``opens`` does an item get
        accumulators for documents that it has not met."""
        self.sums[items[:, None], docs] += gain
        new = items[opens[items]]
        self.alive[new[:, None], docs] = True

    def packed(self, rest: np.ndarray, needed: np.ndarray) -> tuple[bytes, bytes]:
        """What can still reach the score needed with ``rest`` more."""
        stay = self.alive & (self.sums + rest[:, None] >= needed[:, None])
        places = np.flatnonzero(stay.reshape(-1))
        return places.astype(np.int32).tobytes(), self.sums.reshape(-1)[places].tobytes()


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 50 + 50 * n * documents // max(terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _visit(bundle: pa.Table, postings: pa.Table, documents: int, terms: int) -> pa.Table:
    """A bundle at an owner: the contributions of the owner's terms in one shard."""
    if bundle.num_rows == 0:
        return bundle.select(["bundle", "shard", "doc_ids", "places", "scores"])
    row = bundle.to_pylist()[0]
    needed, before, after = (np.array(row[k], np.int64) for k in ("needed", "before", "after"))
    acc = Accumulators(len(needed), len(row["doc_ids"]), row["places"], row["scores"])
    opens = before >= needed
    columns = [postings.column(k) for k in ("docs", "tf", "n", "members", "weight")]
    for docs, tf, n, members, weight in zip(*columns):
        docs, tf, n, members = (x.values.to_numpy(zero_copy_only=False) for x in (docs, tf, n, members))
        acc.add(members, docs, weight.as_py() * impact(tf, n, documents, terms), opens)
    places, scores = acc.packed(after, needed)
    made = {"bundle": [row["bundle"]], "shard": [row["shard"]], "doc_ids": [row["doc_ids"]], "places": [places], "scores": [scores]}
    return pa.table(made, schema=pa.schema([bundle.schema.field(k) for k in made]))


def _tops(rows: DataFrame, k: int) -> DataFrame:
    """``bundle, member, score, doc_id``: each item's ``k`` best of every shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = row["doc_ids"]
                places = np.frombuffer(row["places"], np.int32).astype(np.int64)
                scores = np.frombuffer(row["scores"], np.int64)
                places, scores = places[scores > 0], scores[scores > 0]
                member, doc = places // max(len(ids), 1), places % max(len(ids), 1)
                number = np.array([0 if x is None else x for x in ids], np.int64)
                null = np.array([x is None for x in ids], bool)
                order = np.lexsort((number[doc], null[doc], -scores, member))
                member, doc, scores = member[order], doc[order], scores[order]
                first = np.searchsorted(member, member)
                top = np.arange(len(member)) - first < k
                found = {
                    "bundle": pa.array([row["bundle"]] * int(top.sum()), pa.int64()),
                    "member": pa.array(member[top].astype(np.int64)),
                    "score": pa.array(scores[top]),
                    "doc_id": pa.array(number[doc[top]], mask=null[doc[top]]),
                }
                yield pa.RecordBatch.from_pydict(found)

    found = rows.mapInArrow(work, "bundle long, member long, score long, doc_id long")
    # what a task has found is cut to k per item before it is shuffled
    order = Window.partitionBy("bundle", "member").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def search(docs: DataFrame, items: DataFrame, k: int = 50, owners: int = OWNERS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item.

    Equal scores go by ascending doc_id, NULL last; scores of zero are left out. A NULL text
    has no terms; rows of ``docs`` that repeat are each ranked, rows of ``items`` that repeat
    are one item, and items without terms get no rows. Columns other than doc_id and text
    (item_id and text) are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    needs = keep(item_terms(items), "terms")
    wanted = needs.select("term").distinct()
    many = wanted.count()
    only = [r["term"] for r in wanted.collect()] if many <= FILTER_TERMS else None
    index = keep(index_documents(docs, only), "index")
    shards = index.where("term IS NULL")
    told = shards.select(F.explode("sizes").alias("n")).where("n > 0")
    documents, terms = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not many:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").select(
            F.col("item_id").cast(items.schema["item_id"].dataType), "rank", "doc_id", "score"
        )
    postings = index.where("term IS NOT NULL").drop("doc_ids", "sizes")

    # how often a term is there, what it weighs, and the most it can add to a document
    highest = F.expr(
        f"array_max(zip_with(tf, n, (t, s) -> (1000000000L * t) div (1000L * t + 20L * (50L + (50L * s * {documents}L) div {terms}L))))"
    )
    stats = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(highest).alias("highest"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    stats = keep(stats.join(_small(wanted, many), "term", "left_semi").withColumn("weight", weight.cast("long")), "stats")
    # owners share the postings evenly; terms of like frequency have the same owner
    steps = stats.groupBy(F.floor(F.log2("df")).alias("step")).agg(F.sum("df").alias("n")).orderBy("step").collect()
    total, upto, owner_of = sum(r["n"] for r in steps), 0, {}
    for r in steps:  # 63 at most
        owner_of[r["step"]] = min(owners - 1, owners * upto // max(total, 1))
        upto += r["n"]
    owner = F.coalesce(*[F.when(F.floor(F.log2("df")) == s, F.lit(o)) for s, o in owner_of.items()], F.lit(0))
    stats = stats.withColumn("owner", owner)

    # bundles: items numbered inside a hash bucket
    n_items = needs.agg(F.countDistinct("item")).first()[0]
    bundles = max(1, -(-n_items // BUNDLE_ITEMS))
    number = F.row_number().over(Window.partitionBy("bundle").orderBy("item")) - 1
    named = needs.select("item", "item_id").distinct().withColumn("bundle", F.pmod(F.col("item"), F.lit(bundles)))
    named = keep(named.withColumn("member", number.cast("long")), "items")
    pairs = needs.join(named.select("item", "bundle", "member"), "item").join(stats, "term")
    pairs = keep(pairs.select("bundle", "member", "term", "weight", "owner", (F.col("weight") * F.col("highest")).alias("most")), "pairs")
    users = pairs.groupBy("term", "bundle", "owner", "weight").agg(F.collect_list("member").alias("members"))
    users = keep(users, "users")
    n_users = users.count()

    # every bundle starts at every shard with no accumulators
    carried = shards.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))).alias("bundle"),
        F.col("shard").alias("shard"), F.col("doc_ids").alias("doc_ids"),  # own columns, apart from the postings'
        F.lit(b"").alias("places"), F.lit(b"").alias("scores"),
    )
    schema = "bundle long, shard long, doc_ids array<long>, places binary, scores binary"
    needed = None
    for o in range(owners):
        left = F.sum(F.when(F.col("owner") >= o, F.col("most")).otherwise(0))
        rest = F.sum(F.when(F.col("owner") > o, F.col("most")).otherwise(0))
        bounds = named.join(pairs.groupBy("bundle", "member").agg(left.alias("before"), rest.alias("after")), ["bundle", "member"], "left")
        if needed is not None:
            bounds = bounds.join(needed, ["bundle", "member"], "left")
        low = F.coalesce("needed", F.lit(1)) if needed is not None else F.lit(1)
        bounds = bounds.groupBy("bundle").agg(
            F.sort_array(
                F.collect_list(F.struct("member", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), low.cast("long").alias("needed")))
            ).alias("all")
        )
        bounds = bounds.select("bundle", F.col("all.needed").alias("needed"), F.col("all.before").alias("before"), F.col("all.after").alias("after"))
        visiting = carried.join(_small(bounds, bundles), "bundle")
        here = postings.join(_small(users.where(F.col("owner") == o), n_users), "term")
        here = here.select("bundle", "shard", "docs", "tf", "n", "members", "weight")
        met = visiting.groupBy("bundle", "shard").cogroup(here.groupBy("bundle", "shard"))
        carried = keep(met.applyInArrow(lambda a, b: _visit(a, b, documents, terms), schema), "bundles")
        if o < owners - 1:
            best = _tops(carried, k).where(F.col("rank") == k)
            needed = keep(best.select("bundle", "member", F.col("score").alias("needed")), "needed")
    found = _tops(carried, k).join(named, ["bundle", "member"])
    return found.select("item_id", "rank", "doc_id", "score")


def run(spark, sf: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
score AS (
  SELECT item_id, doc_id,
         CAST(sum(CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 50
"""
