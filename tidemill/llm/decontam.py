"""Benchmark decontamination: a prefix-filtered join of shingles, verified word by word.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Its
shingles of three words are ordered by how rarely documents have them. A document that
holds the window holds all its shingles, so the rarest one is a prefix long enough to find
it: only documents with that shingle are candidates, and its place in the window says
where the window would begin. The place and the window's length must lie inside the
document; then every shingle of the window, compared as text, must stand at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import ascii_lower, free_names, keep

WINDOW = 13
SHINGLE = 3
# A word: digits, a-z and everything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def _shingle(words: Column, i: Column, k: int) -> Column:
    """``k`` words from place ``i`` (from 0), joined by a blank, which no word contains."""
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per different window: ``window, length, k, shingles, items``.

    ``k`` is the shingle size, three or fewer where the window is shorter. Items without
    words have no window.
    """
    words = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.lit(size), F.size("_w"))
    each = words.withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)))
    each = each.select("item_id", F.slice("_w", F.col("_at"), length).alias("words"))
    found = each.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    n = F.size("words")
    k = F.least(n, F.lit(SHINGLE))
    shingles = F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")
    )
    return found.select(
        F.concat_ws(" ", "words").alias("window"), n.alias("length"), k.alias("k"), shingles.alias("shingles"), "items"
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if the counted rows allow it; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matched_shingles(docs: DataFrame, windows: DataFrame, rows: int) -> DataFrame:
    """Places of documents where a benchmark shingle stands: ``doc_id, digest, n_words, at,
    shingle``."""
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # 3 at most
    wanted = windows.select("k", F.explode("shingles").alias("shingle")).distinct()

    def places(words: Column, k: int) -> Column:
        upto = F.sequence(F.lit(0), F.size(words) - k)
        one = F.transform(
            upto,
            lambda i: F.struct(F.lit(k).alias("k"), i.alias("at"), _shingle(words, i, k).alias("shingle")),
        )
        return F.when(F.size(words) >= k, one)

    text = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), words_of(F.col("text")).alias("_w"))
    parts = [
        text.select("doc_id", "digest", F.size("_w").alias("n_words"), F.inline(places(F.col("_w"), k))) for k in sizes
    ]
    if not parts:
        return text.select(
            "doc_id", "digest", F.size("_w").alias("n_words"), F.lit(0).alias("at"), F.lit("").alias("shingle")
        ).limit(0)
    all_places = parts[0]
    for p in parts[1:]:
        all_places = all_places.unionByName(p)
    hit = all_places.join(_small(wanted, rows), ["k", "shingle"], "left_semi")
    return hit.select("doc_id", "digest", "n_words", "at", "shingle")


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Occurrences of windows: ``doc_id, digest, start`` (from 0), ``length, items``.

    Documents are told apart by doc_id and a digest of the text; rows that repeat both have
    the same occurrences and share one.
    """
    windows = keep(benchmark_windows(benchmark, size), "windows")
    rows = windows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    matched = keep(matched_shingles(docs, windows, rows).distinct(), "matched")
    counts = matched.groupBy("shingle").agg(F.count("*").alias("n"))
    # the rarest shingle of each window; one that no document has rules the window out
    each = windows.select("window", F.posexplode("shingles").alias("offset", "shingle"))
    rare = each.join(_small(counts, rows), "shingle", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rare")
    )
    prefixes = windows.join(rare.where("rare.n > 0"), "window").select(
        F.col("rare.shingle").alias("shingle"), F.col("rare.offset").alias("offset"), "length", "shingles", "items"
    )
    # the shingles that follow each matched place, as far as places are consecutive
    doc = Window.partitionBy("doc_id", "digest", "k").orderBy("at")
    reach = doc.rowsBetween(0, size - 1)
    sized = matched.withColumn("k", F.size(F.split("shingle", " ")))
    run = sized.select(
        "doc_id", "digest", "k", F.col("at").alias("start"),
        F.collect_list("shingle").over(reach).alias("_next"), F.collect_list("at").over(reach).alias("_ats"),
    )
    begin = F.col("at") - F.col("offset")
    candidates = matched.join(_small(prefixes, rows), "shingle").where(
        (begin >= 0) & (begin + F.col("length") <= F.col("n_words"))
    )
    candidates = candidates.select("doc_id", "digest", begin.alias("start"), "length", "shingles", "items").withColumn(
        "k", F.least("length", F.lit(SHINGLE))
    )
    names = ["digest", "start", "k"]
    here = run.withColumnRenamed("doc_id", "_id")
    checked = candidates.join(here, names).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    m = F.size("shingles")
    exact = (F.slice("_next", F.lit(1), m) == F.col("shingles")) & (F.get("_ats", m - 1) == F.col("start") + m - 1)
    return checked.where(exact).select("doc_id", "digest", "start", "length", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items, contaminated``, with
    ``digest`` to tell rows with equal ids apart.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if at
    least one in ``share`` words is hit. A NULL text has no words, and repeated rows each
    get a row. An empty table gives no rows, an empty benchmark no hits. Columns other than
    doc_id and text (item_id and text) are ignored.
    """
    found = find_windows(docs, benchmark, size)
    spans = found.groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct("start", "length")).alias("_spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    # spans are at most as many as the document's words, times the lengths of short items
    covered = F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    hits = spans.select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.sort_array("items").alias("items"),
    )
    n = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), n.alias("n_words"))
    match = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    hit = F.coalesce("n_hit", F.lit(0))
    out = rows.join(hits, match, "left").select(
        "doc_id", "digest", "n_words", hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.select("*", F.size("items").cast("long").alias("n_items"), bad.alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    doc, digest = free_names(docs, "_id", "_digest")
    bad = contamination(docs, benchmark).where("contaminated")
    bad = bad.select(F.col("doc_id").alias(doc), F.col("digest").alias(digest)).distinct()
    match = (F.md5(F.coalesce("text", F.lit(""))) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(doc))
    return docs.join(bad, match, "left_anti")


def run(spark, sf: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, place.n, item FROM place JOIN win USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
