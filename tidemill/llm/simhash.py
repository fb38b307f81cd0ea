"""SimHash near-duplicates, found at anchor points of a covering code.

Two 64-bit fingerprints that differ in at most four bits differ in at most two bits of
their lower half or in at most one of their upper half. Each half is covered by a code:
the perfect Golay code on 23 bits (every value is within three bits of exactly one
codeword), some bits as they are, and the rest left out. A fingerprint lives at the anchor
that covers it and visits every anchor within covering radius plus threshold, so of any
two close fingerprints one visits the other's home. Each anchor compares its residents
with its visitors and passes on a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import free_names, keep
from tidemill.llm.components import components

SHINGLE = 4
THRESHOLD = 4
SEED = 42
TEXT_BYTES = 1 << 21
# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
# Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
HALVES = ((0, 2), (32, 1))  # first bit of a half and the distance that may fall into it
RESIDENTS = 4_096  # in one cell of a hot anchor
VISITORS = 65_536
ROWS_PER_GROUP = 50_000  # cells that one call compares, when no cell has more


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of one byte buffer at a time; the buffer ends in 8 spare bytes."""
    with np.errstate(over="ignore"):
        wide = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
        half = np.ndarray(len(buffer) - 3, "<u4", buffer, strides=(1,))
        seed64, at, left = np.uint64(seed), start.astype(np.int64), length.astype(np.int64)
        out = np.full(len(at), seed64 + P5)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), v) for v in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            pos, stripes = at[long].copy(), left[long] // 32
            live = np.arange(len(long))
            for turn in range(int(stripes.max())):
                live = live[stripes[live] > turn]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], wide[pos[live] + 8 * k])
                pos[live] += 32
            both = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                both = (both ^ _round(np.zeros_like(a), a)) * P1 + P4
            out[long] = both
            at[long] = pos
        end = start + length
        out += left.astype(np.uint64)
        for _ in range(3):
            some = np.flatnonzero(end - at >= 8)
            if not len(some):
                break
            mixed = out[some] ^ _round(np.zeros(len(some), np.uint64), wide[at[some]])
            out[some] = _rot(mixed, 27) * P1 + P4
            at[some] += 8
        some = np.flatnonzero(end - at >= 4)
        out[some] = _rot(out[some] ^ (half[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
        at[some] += 4
        for _ in range(3):
            some = np.flatnonzero(end > at)
            if not len(some):
                break
            out[some] = _rot(out[some] ^ (buffer[at[some]].astype(np.uint64) * P5), 11) * P1
            at[some] += 1
        out ^= out >> np.uint64(33)
        out *= P2
        out ^= out >> np.uint64(29)
        out *= P3
        return out ^ (out >> np.uint64(32))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table


# For each byte, its bits as the eight bytes of one word: sums of up to 255 stay apart.
SPREAD = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()
)
CLEAN = _lower()


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Fingerprint of every UTF-8 text: the majority of each bit over its shingles' hashes."""
    # a blank before and after every text keeps words of neighbours apart
    raw = CLEAN[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    blank = raw == 32
    stay = ~blank
    stay[1:] |= ~blank[:-1]  # one blank after each word
    size = np.array([len(t) + 1 for t in texts], np.int64)
    kept = np.concatenate([[0], np.cumsum(stay)])
    text_end = kept[np.cumsum(size) + 1]
    buffer = np.concatenate([raw[stay], np.zeros(8, np.uint8)])
    ends = np.flatnonzero(buffer[: kept[-1]] == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    upto = np.searchsorted(ends, text_end - 1, side="right")  # words up to each text's end
    words = np.diff(np.concatenate([[0], upto]))
    first = upto - words
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    total = int(shingles.sum())
    out = np.zeros(len(texts), np.uint64)
    if not total:
        return out
    base = np.cumsum(shingles) - shingles
    inside = np.arange(total) - np.repeat(base, shingles)
    begin = np.repeat(first, shingles) + inside
    last = begin + np.repeat(np.minimum(words, SHINGLE), shingles) - 1
    hashes = xxh64(buffer, starts[begin], ends[last] - starts[begin])
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    some = np.flatnonzero(shingles)
    chunk = np.flatnonzero(inside % 255 == 0)  # a chunk starts at a text or after 255
    of_text = np.searchsorted(chunk, base[some])
    counts = np.zeros((len(some), 64), np.int64)
    for j in range(8):
        sums = np.add.reduceat(SPREAD[lanes[:, j]], chunk).view(np.uint8).reshape(-1, 8)
        counts[:, 8 * j : 8 * j + 8] = np.add.reduceat(sums.astype(np.int64), of_text, axis=0)
    bits = (2 * counts > shingles[some, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_column(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents and ``fp``, the fingerprint of ``text`` as a long."""
    slim = docs.select(*columns, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_raw"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(columns))
            group = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False)) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
            found = [fingerprints(raw.slice(a, b - a).to_pylist()) for a, b in zip(cuts, cuts[1:]) if b > a]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            arrays = [batch.column(i) for i in range(len(columns))] + [pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "fp"])

    return slim.mapInArrow(work, f"{schema}, fp long")


def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, the error vectors of weight five or less: vectors in order of
    syndrome and weight, their weights, and where each syndrome begins."""
    from itertools import combinations

    vectors = np.array([sum(1 << i for i in c) for w in range(6) for c in combinations(range(23), w)])
    weight = np.bitwise_count(vectors)
    syndrome = syndromes(vectors)
    order = np.lexsort((vectors, weight, syndrome))
    begin = np.searchsorted(syndrome[order], np.arange(2049))
    return vectors[order], weight[order], begin


def syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit polynomial by the generator."""
    rest = values.astype(np.int64).copy()
    for i in range(22, 10, -1):
        rest ^= np.where((rest >> i) & 1, GOLAY << (i - 11), 0)
    return rest


def anchors(
    fp: np.ndarray, raw_bits: int, table: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the fingerprint, anchor, and whether the anchor is its home; ``table``: cosets()."""
    vectors, weight, begin = table
    rows, keys, homes = [], [], []
    for half, (shift, distance) in enumerate(HALVES):
        part = (fp >> np.uint64(shift)).astype(np.uint32).astype(np.int64)
        code, plain = part & 0x7FFFFF, (part >> 23) & ((1 << raw_bits) - 1)
        syndrome = syndromes(code)
        flips = [0, *(1 << i for i in range(raw_bits))]
        if distance > 1:
            flips += [(1 << i) | (1 << j) for i in range(raw_bits) for j in range(i)]
        for flip in flips:
            reach = 3 + distance - flip.bit_count()
            n = np.array([np.searchsorted(weight[begin[s] : begin[s + 1]], reach, "right") for s in range(2048)])
            count = n[syndrome]
            row = np.repeat(np.arange(len(fp)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = begin[syndrome[row]] + nth
            word = code[row] ^ vectors[at]
            rows.append(row)
            keys.append((half << 40) | ((plain[row] ^ flip) << 23) | word)
            homes.append((nth == 0) & (flip == 0))  # the lightest vector leads home
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def link_cell(residents: np.ndarray, visitors: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between residents and visitors of an anchor."""
    everyone = np.unique(np.concatenate([residents, visitors]))
    label = np.arange(len(everyone))
    out = []
    step = max(1, 4_000_000 // len(everyone))
    for lo in range(0, len(residents), step):
        some = residents[lo : lo + step]
        near = np.bitwise_count(some[:, None] ^ everyone[None, :]) <= threshold
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            roots = np.unique(label[near[i]])
            if len(roots) > 1:
                out += [(int(everyone[r]), int(everyone[roots[0]])) for r in roots[1:]]
                label[np.isin(label, roots[1:])] = roots[0]
    return out


def link_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints of ``distinct`` (column ``fp``) which are
    joined by chains of fingerprints at most ``threshold`` bits apart."""
    if threshold != THRESHOLD:
        raise ValueError("the covering of the two halves is made for four bits")
    n = distinct.count()
    raw_bits = min(9, max(0, round(math.log2(max(n, 1) / 32)) - 12))

    table = cosets()

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 10_000):
                part = fp[lo : lo + 10_000]
                row, key, home = anchors(part, raw_bits, table)
                data = {"anchor": pa.array(key), "fp": pa.array(part.view(np.int64)[row]), "home": pa.array(home)}
                yield pa.RecordBatch.from_pydict(data)

    spread = distinct.select("fp").repartition("fp")
    rows = keep(spread.mapInArrow(replicate, "anchor long, fp long, home boolean"), "anchors")
    # visitors matter where somebody lives; anchors with many become a grid of cells
    sizes = rows.groupBy("anchor").agg(F.count_if("home").alias("_r"), F.count("*").alias("_v"))
    grid = sizes.where("_r > 0 AND _v > 1").select(
        "anchor", F.ceil(F.col("_r") / RESIDENTS).alias("_cr"), F.ceil(F.col("_v") / VISITORS).alias("_cv")
    )
    rows = rows.join(grid, "anchor")
    mine = F.xxhash64(F.col("fp"))
    from_zero = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    living = rows.where("home").select(
        "anchor", "fp", "home", F.pmod(mine, F.col("_cr")).alias("i"), from_zero("_cv").alias("j")
    )
    visiting = rows.select(
        "anchor", "fp", F.lit(False).alias("home"), from_zero("_cr").alias("i"), F.pmod(mine, F.col("_cv")).alias("j")
    )
    tasks = max(1, n * 40 // ROWS_PER_GROUP)
    group = F.pmod(F.xxhash64("anchor", "i", "j"), F.lit(tasks)).alias("_group")
    cells = living.unionByName(visiting).select("anchor", "i", "j", "fp", "home", group)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "i", "j"], kind="stable")
        place = rows[["anchor", "i", "j"]].to_numpy()
        edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        fp, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        found = []
        for part, lives in zip(np.split(fp, edges), np.split(home, edges)):
            found += link_cell(part[lives], part[~lives], threshold)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cells.groupBy("_group").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id that chains of close fingerprints reach.

    A NULL or blank text has fingerprint zero and is linked like any other; a NULL doc_id is
    no candidate for the smallest (a component of nothing else gets NULL). Repeated rows
    each get a row. No rows give no rows. Columns other than doc_id and text are ignored.
    """
    marked = keep(fingerprint_column(docs, ["doc_id"]), "fingerprints")
    return marked.join(label_fingerprints(marked), "fp").select("doc_id", "fp", "component_id")


def label_fingerprints(marked: DataFrame) -> DataFrame:
    """``fp, component_id`` for the fingerprints in ``marked`` (``doc_id, fp``)."""
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")), "distinct")
    found = components(keep(link_fingerprints(distinct), "links"))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left")
    rooted = rooted.select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return keep(rooted.join(least, "root").select("fp", "component_id"), "labels")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Keeps one row of every group of near-duplicates, with all its columns: the one with
    the smallest doc_id (NULLs last), then the smallest hash of the text."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    marked = keep(fingerprint_column(keyed, ["doc_id", "_h"]), "fingerprints")
    labels = label_fingerprints(marked.withColumn("doc_id", _order(F.col("doc_id"), F.col("_h"))))
    # the component is named after the order key of the row that stays
    chosen = marked.withColumn("_key", _order(F.col("doc_id"), F.col("_h"))).join(labels, "fp")
    chosen = chosen.where(F.col("_key") == F.col("component_id")).select(_name("doc_id"), "_h").distinct()
    name, h = free_names(docs, "_name", "_h")
    chosen = chosen.withColumnsRenamed({"_name": name, "_h": h})
    rows = docs.withColumns({name: _name("doc_id"), h: F.xxhash64("text")})
    kept = rows.join(chosen, [name, h]).dropDuplicates([name, h])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _name(doc_id: str):
    """A text for the id that is never NULL, so that rows are joined by plain equality."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("_name")


def _order(doc_id, text_hash):
    """One value that sorts by doc_id, NULL last, then by the hash."""
    return F.struct(doc_id.isNull().alias("n"), doc_id.alias("d"), text_hash.alias("h"))


def run(spark, sf: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
