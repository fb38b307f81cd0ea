"""Mixing, token files and shards, against plain statements of what they must give."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import frames, table
from tidemill.llm import mixing, sharding, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


# --- shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1000, 4097])
def test_permutation_and_its_inverse(spark, n):
    rows = spark.range(n).select("id", sharding.permute(F.col("id"), F.lit(n), F.lit(3)).alias("p"))
    rows = rows.withColumn("back", sharding.unpermute(F.col("p"), F.lit(n), F.lit(3))).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def test_shards_are_even_gapless_and_repeatable(spark):
    docs, empty = frames(spark)
    got = sharding.shard_documents(docs, 7).collect()
    raw = [(r["text"] or "").encode() for r in docs.collect()]
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len(b) + 16, zlib.crc32(b)) for b in raw)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shard_documents(docs.repartition(5), 7).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sharding.shard_documents(empty, 7).count() == 0


def test_row_of_a_slot_is_computable(spark):
    got = sharding.assign_shards(spark.range(100).select("id"), 7, seed=4).collect()
    r = got[17]
    found = spark.range(1).select(sharding.source_row(r["shard"], r["slot"], 7, 100, 4)).first()[0]
    assert found == r["row_number"]
    with pytest.raises(ValueError):
        sharding.source_row(0, 15, 7, 100)


def test_repeated_rows_share_no_slot(spark):
    many = spark.range(3000).select(F.lit(1).alias("x"))
    got = sharding.assign_shards(many, 7).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 3000


# --- token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
def test_pack_round_trip(values):
    x = np.array(values, np.uint64)
    words, offsets = tokens.pack(x)
    assert (tokens.unpack(words, offsets, len(x)) == x).all()
    assert offsets[-1] == len(words)


def test_pack_many_blocks_and_density():
    x = np.random.default_rng(0).integers(0, 1 << 15, 300_000).astype(np.uint64)
    words, offsets = tokens.pack(x)
    assert (tokens.unpack(words, offsets, len(x)) == x).all()
    assert len(words) < len(x) / 3.8  # four ids of 15 bits to a word, but for block ends
    assert len(tokens.pack(np.zeros(256, np.uint64))[0]) == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB 'sé\n\t\x0b\x85\xa0İΣ中1<|endoftext|>́"), max_size=40), max_size=6))
def test_words_give_the_ids_of_the_whole_text(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    ids, lengths = tokens.text_ids(tokens.WordIds.of_worker(path), pa.array(texts, pa.string()), 2)
    expected = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert list(lengths) == [len(e) for e in expected]
    assert list(ids) == [i for e in expected for i in e]


def test_words_that_differ_in_case_and_signs_are_coded_once(monkeypatch):
    coder = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    coded, seen = coder.coded, []
    monkeypatch.setattr(coder, "coded", lambda words: seen.extend(words) or coded(words))
    text = "Zu\u00e4rnt zu\u00e4rnt. ZU\u00c4RNT!! zu\u00e4rnt, (zu\u00e4rnt)"
    ids, _ = tokens.text_ids(coder, pa.array([text, "zu\u00e4rnt!! zu\u00e4rnt"]), 2)
    assert list(ids) == [i for t in (text, "zu\u00e4rnt!! zu\u00e4rnt") for i in coder.tokenizer.encode(t, add_special_tokens=False).ids + [2]]
    assert seen.count("zu\u00e4rnt") == 1 and len(seen) == len(set(seen)) <= 6


def test_stems_and_signs_give_the_ids_of_every_letter_and_sign():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = tokens.WordIds(path)
    letters = [chr(c) for c in range(0x24F + 2) if chr(c).isalpha()] + ["J\u030c", "A\u0130", "\u03a3", "\uac00\u11a8"]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()] + ["", "...", "'s", "|>", "<|endoftext|>", ".'re", "\u0301!"]
    words = [f"s{x}T{y}" for x in letters for y in signs] + [f"{x}{y}s" for x in letters for y in signs]
    ids, lengths = tokens.text_ids(coder, pa.array(words), 2)
    plain = [one.ids + [2] for one in coder.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert coder.parted and list(lengths) == list(map(len, plain)) and list(ids) == [i for p in plain for i in p]
    other = tokens.WordIds.__new__(tokens.WordIds)
    other.tokenizer = type(coder.tokenizer).from_str(coder.tokenizer.to_str().replace('"type":"Lowercase"', '"type":"NFKC"'))
    assert not other._parted()


def test_ids_are_put_in_place_in_little_memory():
    import tracemalloc

    coder = tokens.WordIds.of_worker(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["", "one two three " * 100, None, "four " * 70_000] + ["five six " * 200] * 700, pa.string())
    tokens.text_ids(coder, texts.slice(0, 4).fill_null(""), 2)
    tracemalloc.start()
    ids, lengths = tokens.text_ids(coder, texts.fill_null(""), 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths[0] == lengths[2] == 1 and len(ids) == lengths.sum() and (ids[np.cumsum(lengths) - 1] == 2).all()
    plain = [tokens.text_ids(coder, pa.array([t or ""]), 2)[0] for t in texts.slice(0, 5).to_pylist()]
    assert list(ids[: sum(map(len, plain))]) == list(np.concatenate(plain))
    assert most < 36 * len(ids)


def test_files_hold_every_document_in_order(spark):
    from tokenizers import Tokenizer

    docs, empty = frames(spark)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(tokens.tokenize(docs).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)

    def coded(text):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    expected = sorted(((r["doc_id"], *coded(r["text"])) for r in docs.collect()), key=repr)
    assert table(tokens.tokenize(docs), "doc_id", "n_tokens", "ids_crc32") == expected
    assert tokens.tokenize(empty).count() == 0


# --- mixing


def fill(sizes, weights, share, most):
    """Targets by the rule as it is told: share out, stop at the cap, share the excess again."""
    target = [0.0] * len(sizes)
    left, free = share * sum(sizes), {i for i, s in enumerate(sizes) if s}
    while left > 1e-9 and free:
        total = sum(weights[i] for i in free)
        step = {i: left * weights[i] / total for i in free}
        left = 0.0
        for i, x in step.items():
            target[i] += x
            if target[i] > most * sizes[i]:
                left += target[i] - most * sizes[i]
                target[i] = most * sizes[i]
        free = {i for i in free if target[i] < most * sizes[i] - 1e-9}
    return target


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = np.resize([3.0, 1.0, 2.0], len(sizes))
    got = mixing.targets(np.array(sizes), weights, 1.5, 2.0)
    assert np.allclose(got, fill(sizes, weights, 1.5, 2.0), atol=1e-6)


def test_tree_splits_exact_quotas():
    quota = np.array([1000, 3, 0, 250, 77])
    parts = [mixing.split_quotas(quota, 13, s, 5) for s in range(13)]
    assert (sum(n for n, _ in parts) == quota).all()
    sizes = [int(n.sum()) for n, _ in parts]
    assert max(sizes) - min(sizes) <= 1
    before = np.zeros(5, int)
    for n, b in parts:
        assert (b == before).all()
        before = before + n


def test_mix_meets_targets_and_repeats(spark):
    docs, empty = frames(spark)
    plan = mixing.MixPlan(shards=5, min_blocks=64)
    pieces, placed = mixing.mix(docs, plan)
    rows = placed.collect()
    assert len(rows) == docs.count()
    words = {}
    for r in docs.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(mixing.WORD, r["text"] or ""))
    assert {r["source"]: r["source_size"] for r in rows} == words
    taken = {r["source"]: r["n"] for r in pieces.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    for r in rows:
        block = max(1, -(-r["source_size"] // 64))
        assert abs(taken.get(r["source"], 0) - r["target"]) <= block
    size = {(r["source"], r["start"], r["doc_id"]): r["size"] for r in rows if r["size"]}
    for r in pieces.groupBy("source", "start", "doc_id").agg(F.sum("n_words").alias("n")).collect():
        assert r["n"] <= 2 * size[(r["source"], r["start"], r["doc_id"])]
    names = ("shard", "order_key", "doc_id", "first_word", "n_words")
    again, _ = mixing.mix(docs.repartition(6), plan)
    assert table(again, *names) == table(pieces, *names)
    assert mixing.mix(empty, plan)[0].count() == 0


def test_mixed_documents_are_parts_of_their_texts(spark):
    docs, empty = frames(spark)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    got = mixing.mixed_documents(docs).collect()
    assert got and all(any(r["text"] in t for t in texts[r["doc_id"]]) for r in got)
    pieces, _ = mixing.mix(docs)
    total = pieces.agg(F.sum("n_words")).first()[0]
    assert sum(len(re.findall(mixing.WORD, r["text"])) for r in got) == total
    assert mixing.mixed_documents(empty).count() == 0
