"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary
text, one that adds a list of word beginnings that toxic text has and ordinary text lacks.
The list replaces a dictionary trained on toxic text, which finds far fewer (see README).

A text is cut into windows of eight words. A window that becomes shorter under the toxic
dictionary than under the ordinary one holds something that toxic text repeats. Nearly
all windows of clean text save nothing, because the dictionaries are alike but for the
toxic part: the ordinary dictionary has as many bytes that match nothing in its place.
The largest savings of a text become a score by a calibrated logistic curve.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import keep

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Fixed value: the repeat offsets that end the entropy tables of a trained dictionary.
REPEAT_OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


@dataclass(frozen=True)
class FitPlan:
    """Bounds of the sample that the dictionaries and the curve are fitted on, per class."""

    max_docs: int = 2_000
    max_bytes: int = 7_000_000
    window_words: int = 8
    ordinary_bytes: int = 16_384
    toxic_bytes: int = 2_048
    shortest: int = 5  # bytes of a stem, the blank before it included
    longest: int = 12
    min_texts: int = 3
    evidence: tuple[tuple[float, float], ...] = ((3.5, 2.5), (1.8, 5.0))  # log ratio and its z
    seed: int = 0


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: two dictionaries and a curve."""

    ordinary: bytes
    toxic: bytes
    window_words: int
    weights: tuple[float, ...]
    prior: float | None = None  # the score of every text, if a class had no rows


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def windows(words: list[bytes], n: int) -> list[bytes]:
    """Runs of ``n`` words with a blank on either side; a text without words has one blank."""
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(0, len(words), n)] or [b" "]


class Savings:
    """Bytes that the toxic dictionary saves on a window, against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        parameters = zstd.ZstdCompressionParameters.from_level(
            5, min_match=5, strategy=zstd.STRATEGY_LAZY, target_length=64, window_log=16,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        filler = b"\xff" * len(toxic)  # in no UTF-8 text
        self.pair = []
        for content in (ordinary + filler, ordinary + toxic):
            data = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            self.pair.append(zstd.ZstdCompressor(dict_data=data, compression_params=parameters))

    def of(self, parts: list[bytes]) -> np.ndarray:
        plain, toxic = (c.compress for c in self.pair)
        return np.fromiter((len(plain(p)) - len(toxic(p)) for p in parts), np.int32, len(parts))

    def features(self, text: bytes, n: int) -> tuple[float, ...]:
        """Largest saving, means of the three and ten largest, and logarithm of the windows."""
        saved = self.of(windows(words_of(text), n))
        top = np.sort(saved)[::-1].astype(float)
        return top[0], top[:3].sum() / 3, top[:10].sum() / 10, math.log(len(saved))


def families(docs: list[list[bytes]]) -> list[int]:
    """Copies and near copies share a number: a phrase that one text spreads counts once.

    Texts are joined if one of four smallest hashes of their five-word shingles agrees."""
    import xxhash

    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, words in enumerate(docs):
        if not words:
            continue
        shingles = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))]
        hashes = np.array(shingles, np.uint64)
        for j, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            with np.errstate(over="ignore"):
                least = int((hashes * np.uint64(odd)).min())
            root[find(i)] = find(seen.setdefault((j, least), i))
    return [find(i) for i in range(len(docs))]


def stems(toxic: list[list[bytes]], ordinary: list[list[bytes]], plan: FitPlan) -> list[bytes]:
    """Beginnings of words that toxic texts have far more often, the most frequent first."""

    def pooled(docs: list[list[bytes]]) -> list[set[bytes]]:
        words: dict[int, set[bytes]] = defaultdict(set)
        for family, some in zip(families(docs), docs):
            words[family].update(b" " + w + b" " for w in some)
        return list(words.values())

    # a longer beginning is counted only where the shorter one is frequent enough
    toxic_words, bad = pooled(toxic), Counter()
    for n in range(plan.shortest, plan.longest + 1):
        begins = lambda w: len(w) >= n and (n == plan.shortest or w[: n - 1] in bad)  # noqa: E731, B023
        counts = Counter(g for some in toxic_words for g in {w[:n] for w in some if begins(w)})
        bad.update({g: c for g, c in counts.items() if c >= plan.min_texts})
    sizes, good, n_bad, n_good = range(plan.shortest, plan.longest + 1), Counter(), len(toxic_words), 0
    for some in pooled(ordinary):
        good.update({w[:n] for w in some for n in sizes if w[:n] in bad and len(w) >= n})
        n_good += 1

    def telling(g: bytes) -> bool:
        a, b = bad[g] + 0.5, good[g] + 0.5
        ratio = math.log(a / (n_bad + 1)) - math.log(b / (n_good + 1))
        z = ratio / math.sqrt(1 / a + 1 / b)
        return bad[g] >= plan.min_texts and any(ratio >= r and z >= least for r, least in plan.evidence)

    chosen = {g for g in bad if telling(g)}
    longer: dict[bytes, list[bytes]] = defaultdict(list)
    for g in chosen:
        longer[g[:-1]].append(g)
    out = set()
    for g in chosen:
        if g[:-1] in chosen:
            continue
        while True:  # on to longer ones, as long as most texts go along
            after = max(longer[g], key=lambda x: (bad[x], x), default=None)
            if after is None or bad[after] < 0.7 * bad[g]:
                break
            g = after
        out.add(g)
    return sorted(out, key=lambda g: (-bad[g], g))


def ordinary_content(docs: list[list[bytes]], plan: FitPlan) -> bytes:
    """Content of a dictionary trained on windows of ordinary text, without its tables."""
    samples = [w for words in docs for w in windows(words, plan.window_words)]
    try:
        trained = zstd.train_dictionary(plan.ordinary_bytes, samples, k=32, d=6, level=3).as_bytes()
        return trained[trained.index(REPEAT_OFFSETS) + len(REPEAT_OFFSETS) :]
    except zstd.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[: plan.ordinary_bytes]


def toxic_content(found: list[bytes], plan: FitPlan) -> bytes:
    """The stems, the most frequent last: near matches cost the fewest bits."""
    out = b""
    for g in found:
        if len(out) + len(g) <= plan.toxic_bytes:
            out = g + out
    return out


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic curve by Newton steps with a small ridge; the classes weigh the same, and a
    shift puts the threshold with the fewest errors at one half."""
    design = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    ridge = np.diag([1e-6, *[1e-2] * x.shape[1]])
    w = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge @ w
        curve = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge
        w = w + np.linalg.solve(curve, slope)
    z = design @ w
    edges = np.unique(z)
    cuts = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else np.zeros(1)
    order = np.sort(z[y == 1]), np.sort(z[y == 0])
    missed = np.searchsorted(order[0], cuts) / 1.0
    false = len(order[1]) - np.searchsorted(order[1], cuts)
    best = cuts[np.argmin(missed + false)]
    w[0] -= best
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, plan: FitPlan = FitPlan()) -> ToxicityModel:
    """Fits on a sample of labelled rows, bounded by ``plan``: the rows with the smallest
    hash of their id. Labels other than 0 and 1 and NULL texts are left out; if a class is missing,
    every text gets the share of toxic labels (0 without labels)."""
    truth = labels.where("toxic IN (0, 1)").select("doc_id", "toxic").distinct()
    truth = truth.withColumn("_h", F.xxhash64(F.lit(plan.seed), "doc_id"))
    counts = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().collect()}
    if not {0, 1} <= counts.keys():
        return ToxicityModel(b"", b"", plan.window_words, (), 1.0 if 1 in counts else 0.0)
    # hashes below a share of their range: about as many rows as the bound, on any layout
    unit = F.shiftrightunsigned("_h", 11).cast("double") / float(1 << 53)
    part = F.when(F.col("toxic") == 1, plan.max_docs / counts[1]).otherwise(plan.max_docs / counts[0])
    chosen = F.broadcast(truth.where(unit < part))  # bounded by max_docs
    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).where("text IS NOT NULL")
    rows = keep(texts.join(chosen, "doc_id"), "labelled")
    sums = {r["toxic"]: r["b"] for r in rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    fits = [F.when(F.col("toxic") == k, plan.max_bytes / max(sums.get(k, 0), 1)).otherwise(0.0) for k in (0, 1)]
    inside = unit / part < fits[0] + fits[1]
    sample = rows.where(inside).select("toxic", "_h", "text").toArrow()
    order = np.argsort(sample.column("_h").to_numpy(), kind="stable")
    toxic, text = sample.column("toxic").to_numpy()[order], sample.column("text").take(pa.array(order)).to_pylist()
    split = [words_of(t) for t in text]
    bad = [w for w, t in zip(split, toxic) if t == 1]
    good = [w for w, t in zip(split, toxic) if t == 0]
    if not bad or not good:
        return ToxicityModel(b"", b"", plan.window_words, (), float(len(bad) > 0))
    ordinary = ordinary_content(good, plan)
    found = toxic_content(stems(bad, good, plan), plan)
    savings = Savings(ordinary, found)
    x = np.array([savings.features(t, plan.window_words) for t in text])
    weights = calibrate(x, (toxic == 1).astype(float))
    return ToxicityModel(ordinary, found, plan.window_words, weights)


def score(docs: DataFrame, model: ToxicityModel, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of the documents, ``score`` between 0 and 1, and ``predicted``.

    The whole text is read; a NULL or blank text has one empty window and gets the score of
    no saving. Every row gets a row. Names other than those asked for do not matter.
    """
    names = columns if text in columns else [*columns, text]  # a text goes to Python once
    slim, at = docs.select(*names), names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(columns)])
    raw = lambda v: v.as_buffer().to_pybytes() if v.is_valid else b""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = None if model.prior is not None else Savings(model.ordinary, model.toxic)
        for batch in batches:
            if savings is None:
                points = np.full(batch.num_rows, model.prior)
            else:
                x = [savings.features(raw(v), model.window_words) for v in batch.column(at)]
                z = model.weights[0] + np.array(x).reshape(-1, len(model.weights) - 1) @ np.array(model.weights[1:])
                points = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            made = pa.array(points)
            told = pc.cast(pc.greater_equal(made, 0.5), pa.int32())
            arrays = [batch.column(i) for i in range(len(columns))] + [made, told]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "score", "predicted"])

    return slim.mapInArrow(work, f"{schema}, score double, predicted int")


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, plan: FitPlan = FitPlan()) -> ToxicityModel:
    return fit(docs, labels.where(~held_out(F.col("doc_id"))), plan)


def remove_toxic(docs: DataFrame, labels: DataFrame, plan: FitPlan = FitPlan()) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns."""
    numbered = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}  # no name can clash
    rows = docs.select(*[c.alias(k) for k, c in numbered.items()])
    scored = score(rows, fit_on_labels(docs, labels, plan), list(numbered), f"c{docs.columns.index('text')}")
    return scored.where("predicted = 0").select(*[F.col(k).alias(c) for k, c in zip(numbered, docs.columns)])


def run(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_on_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
