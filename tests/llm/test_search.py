"""Ranked search, repeated passages and hard negatives against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import frames, odd_documents
from tidemill.llm import negatives, repeats, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain_search(docs, items, k):
    split = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in split if c)
    length = sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, c in split:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * n_docs) // length
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda f: f[:3])
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def benchmark_rows():
    rng = random.Random(2)
    texts = [d[1] for d in odd_documents() if d[1] and len(d[1]) > 100]
    items = [(i, " ".join(rng.sample(rng.choice(texts).split(), 9)).upper()) for i in range(20)]
    return items + [(3, "same id, other text x y"), (None, "one first row"), (30, None), (31, " . "), (0, items[0][1])]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_equals_scoring_everything(spark, benchmark_rows, k):
    docs, empty = frames(spark)
    items = spark.createDataFrame([(*b, 1) for b in benchmark_rows], "item_id long, text string, rank int")
    want = plain_search([d[:2] for d in odd_documents()], benchmark_rows, k)
    assert rows(search.search(docs, items, k)) == want
    assert search.search(empty, items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_with_many_shards_bundles_and_joined_terms(spark, benchmark_rows, monkeypatch):
    want = plain_search([d[:2] for d in odd_documents()], benchmark_rows, 5)
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    for name, value in (("SHARD_DOCS", 7), ("BUNDLE_ITEMS", 4), ("FILTER_TERMS", 0), ("BROADCAST_ROWS", 0), ("SLICE_BYTES", 900)):
        monkeypatch.setattr(search, name, value)
    assert rows(search.search(frames(spark)[0], items, 5, owners=3)) == want


def test_accumulators_are_dropped_and_not_opened_only_when_they_cannot_matter():
    acc = search.Accumulators(2, 3, b"", b"")
    acc.add(np.array([0, 1]), np.array([0, 2]), np.array([5, 9]), np.array([True, False]))
    places, scores = acc.packed(np.array([1, 0]), np.array([7, 1]))
    assert np.frombuffer(places, np.int32).tolist() == [2] and np.frombuffer(scores, np.int64).tolist() == [9]
    again = search.Accumulators(2, 3, places, scores)
    assert again.sums.tolist() == [[0, 0, 9], [0, 0, 0]] and again.alive.sum() == 1


def plain_repeats(docs, n=200):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[p : p + n] for _, b in texts for p in range(len(b) - n + 1))
    out = []
    for d, b in texts:
        marked = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                marked[p : p + n] = b"x" * n
        kept = bytes(c for c, m in zip(b, marked) if not m)
        spans = [(m.start(), m.end()) for m in re.finditer(b"x+", bytes(marked))]
        out.append((d, len(b), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_repeats(df, heavy=repeats.HEAVY):
    kept = repeats.remove_repeats(df, heavy).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], hashlib.sha256(r.kept).hexdigest()) for r in kept), key=repr
    )


def repeating_documents():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(70))
    docs = [d[:2] for d in odd_documents()]
    for i in range(40):  # a passage in many surroundings, cut at its ends
        a, b = rng.randint(0, 60), rng.randint(len(passage) - 60, len(passage))
        docs.append((300 + i, " ".join(word() for _ in range(30)) + passage[a:b] + " ".join(word() for _ in range(30))))
    docs += [(400, "ab" * 300), (401, "a" * 199), (402, "a" * 201), (403, "x" * 200), (404, "y" * 200), (405, "y" * 200)]
    docs += [(410, passage[:200]), (411, passage[:199]), (412, passage + passage)]
    return docs


@pytest.mark.parametrize("heavy", [repeats.HEAVY, 1])
def test_repeats_equal_looking_at_every_suffix(spark, heavy):
    docs = repeating_documents()
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, row string, place int")
    assert found_repeats(df, heavy) == plain_repeats(docs)
    assert found_repeats(df.limit(0), heavy) == []


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    docs = repeating_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_repeats(df) == plain_repeats(docs)


def test_hashes_of_substrings():
    data = np.frombuffer(bytes(random.Random(1).choices(range(256), k=500)) * 2, np.uint8)
    sums = repeats.SPANS.prefixes(data)
    lo = np.arange(400)
    assert (repeats.SPANS.of(sums, lo, lo + 60) == repeats.SPANS.of(sums, lo + 500, lo + 560)).all()
    assert len(set(repeats.SPANS.of(sums, lo, lo + 60).tolist())) == 400


def plain_negatives(table, anchor, positives=5, negative_count=5):
    clean = []
    for i, label, v in table:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, label, [math.floor(256 * x) for x in v]))
    out, seen = [], set()
    for i, label, v in clean:
        if not anchor(i) or repr((i, label, v)) in seen:
            continue
        seen.add(repr((i, label, v)))
        scored = [(sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in clean]
        near = sorted((-s, j) for s, j, same in scored if same and j != i)[:positives]
        for s, j in near:
            fit = sorted((-t, n) for t, n, same in scored if not same and 80 * -s <= 100 * t <= 100 * -s)[:negative_count]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(seed=4, n=260, d=6):
    rng = random.Random(seed)
    out = [(i, rng.randint(0, 3), [rng.gauss(0, 1) * (1 + 3 * (i % 3)) for _ in range(d)]) for i in range(n)]
    out += [out[20], out[20], out[35], (400, 1, [0.0] * d), (410, 2, [0.0] * d), (7, 1, list(out[7][2]))]
    out += [(None, 1, [1.0] * d), (500, None, [1.0] * d), (510, 1, None), (520, 1, [1.0, None]), (530, 1, [float("nan")] * d)]
    return out + [(540, 1, [float("inf")] * d), (550, 1, []), (560, 2, [1.0, 2.0]), (570, 9, [1.0] * d)]


SCHEMA = "vec_id long, label int, embedding array<double>, score string, lane int"


@pytest.mark.parametrize("bucket", [16, negatives.BUCKET_ROWS])
def test_negatives_equal_multiplying_everything(spark, monkeypatch, bucket):
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(negatives, "LANE_ROWS", 40 if bucket == 16 else 65_536)
    df = spark.createDataFrame([(*v, "s", 0) for v in vectors()], SCHEMA)
    found = negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert rows(found) == plain_negatives(vectors(), lambda i: i % 10 == 0)
    assert negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine_hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_large_components_stay_exact(spark):
    from pyspark.sql import functions as F

    big = [(i, i % 2, [(i + 1) * 1e6 + 0.5, -3e5 * i]) for i in range(12)]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    assert rows(negatives.mine_hard_negatives(df, F.col("vec_id") == 4)) == plain_negatives(big, lambda i: i == 4)


def test_coordinate_lists_spare_products():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 100
    points = np.floor(centres[rng.integers(0, 12, 4_000)] + rng.normal(size=(4_000, 16)) * 5)
    lane = negatives.Lane(np.arange(4_000), points)
    able, top = np.ones(4_000, bool), defaultdict(list)
    for i in range(20):
        scores, found = lane.strongest(points[i], able, [(-math.inf, math.inf)], 5)[0]
        exact = (points @ points[i]).astype(np.int64)
        top[i] = np.lexsort((np.arange(4_000), -exact))[:5]
        assert found.tolist() == top[i].tolist() and (scores == exact[top[i]]).all()
    assert lane.checked < 0.3 * 20 * 4_000
