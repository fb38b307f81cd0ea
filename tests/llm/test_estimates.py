"""Robust estimates against numpy, URL trees on held-out hosts, the order of a mix, user columns, and the whole pipeline."""

import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frames, odd_documents
from tidemill.llm import chat, decontam, mixing, quality, sharding, simhash, tokens, urls

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
SCHEMA = "doc_id long, text string, lang string, source string"


def mixed_source(share, n=300):
    """Clean texts, and junk of one kind that passes the base rules."""
    rng = np.random.default_rng(int(100 * share))
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    bad = int(n * share)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(120, 400))), "en", "s") for i in range(n - bad)]
    return rows + [(1000 + i, "###$$$ ".join(rng.choice(vocabulary, rng.integers(120, 400))), "en", "s") for i in range(bad)]


@pytest.mark.parametrize("share", [0.2, 0.4])
def test_much_junk_of_one_kind_is_rejected(spark, share):
    rows = mixed_source(share)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[r[0]] == (r[0] < 1000) for r in rows)


def plain_mcd(x, plan, trials=60):
    """Random starts, concentration steps and the smallest determinant, as the book has it."""
    rng, floor, h = np.random.default_rng(0), np.diag(np.square(plan.floor)), int(np.ceil(plan.share * len(x)))
    best = None
    for _ in range(trials):
        core = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(12):
            mean, cov = core.mean(0), np.cov(core.T, bias=True) * plan.consistency + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            core = x[np.argsort(d, kind="stable")[:h]]
        if best is None or np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), d)
    return best[1]


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_verdicts_are_those_of_a_plain_estimate(spark, share):
    rows = mixed_source(share, 240)
    plan = quality.McdPlan()
    stats = quality.statistics(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).withColumns(quality.features())
    x = stats.orderBy("doc_id").select(*quality.FEATURES).toPandas().to_numpy()
    want = plain_mcd(x, plan)
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").toPandas()
    assert (got["kept"].to_numpy() == (want <= plan.cutoff)).all()
    near = want < plan.cutoff
    assert np.corrcoef(got["distance"].to_numpy()[near], want[near])[0, 1] > 0.95


def test_chi_square_and_determinant(spark):
    # tabulated values of the distribution
    assert quality.chi_square_quantile(0.5, 5) == pytest.approx(4.35146, abs=1e-4)
    assert quality.chi_square_quantile(0.999, 5) == pytest.approx(20.515, abs=1e-3)
    assert quality.chi_square(7.0, 7) == pytest.approx(0.5711, abs=1e-3)
    a = np.random.default_rng(2).normal(size=(5, 9))
    m = a @ a.T
    df = spark.createDataFrame([([float(v) for v in m.ravel()],)], "m array<double>")
    assert df.select(quality._determinant(F.col("m"))).first()[0] == pytest.approx(np.linalg.det(m))


def test_trees_judge_hosts_that_they_have_not_seen(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    rows = []
    for i in range(1_500):
        bad = i % 5 == 0
        tail = "/".join(word(3) + "".join(rng.choice(list("0123456789"), 7)) for _ in range(3)) if bad else word(9)
        rows.append((i, f"http://{word(6)}.{'net' if i % 2 else 'com'}/{'bad' if bad else 'good'}/{tail}"))
    rules = tuple(urls.UrlRule(s, p, v) for s in ("net", "com") for p, v in (("/bad/", "block"), ("/good/", "allow")))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r["label"]: (r["n"], r["right"]) for r in urls.held_out_accuracy(pages, rules).collect()}
    assert all(right > 0.95 * n for n, right in found.values()) and found[1.0][0] > 30


def test_suffixes_do_not_inherit_their_rules(spark):
    """All labelled URLs of a suffix are blocked; others of it that look like allowed ones are not."""
    rows = [(i, f"http://h{i}.net/fr/x{'9' * (i % 9 + 5)}/y/z") for i in range(300)]
    rows += [(1000 + i, f"http://h{i}.com/ab") for i in range(300)] + [(5000 + i, f"http://g{i}.net/ab") for i in range(50)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 5000")
    assert {r["verdict"] for r in got.collect()} == {"allow"}


# --- mixing


def test_blocks_grow_with_the_words(monkeypatch):
    sums = [("a", 4 * 10**13), ("b", 10**12), (None, 7)]

    class Placed:
        def groupBy(self, _):
            return self

        agg = orderBy = limit = lambda self, *_: self

        def collect(self):
            from pyspark.sql import Row

            return [Row(source=s, source_size=n) for s, n in sums]

    monkeypatch.setattr(mixing.F, "sum", lambda c: F.lit(0))
    monkeypatch.setattr(mixing.F, "col", lambda c: F.lit(0))
    out = mixing.source_table(Placed(), mixing.MixPlan())
    monkeypatch.undo()
    assert out["quota"].sum() < 10**9
    n, before = mixing.split_quotas(out["quota"].to_numpy(), 40, 39, 0)
    assert (n + before == out["quota"].to_numpy()).all()  # numpy draws from it


def test_documents_of_a_mix_stand_in_its_order(spark, tmp_path):
    docs, _ = frames(spark)
    plan = mixing.MixPlan(shards=5, min_blocks=64)
    pieces, _ = mixing.mix(docs, plan)
    mixing.mixed_documents(docs, plan).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    files = stored.select("doc_id", "text", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).toPandas()
    order = files.sort_values(["f", "i"], kind="stable")
    first = {}
    for r in pieces.collect():
        place = (r["shard"], r["order_key"])
        first.setdefault(r["doc_id"], set()).add(place)
    # each row can be given a place of its document so that places ascend
    at = (-1, 0)
    for doc in [None if pd.isna(d) else int(d) for d in order["doc_id"]]:
        later = [p for p in first[doc] if p >= at]
        assert later, (doc, at)
        at = min(later)
    assert "lang" not in mixing.mixed_documents(docs.drop("lang"), plan).columns


def test_rows_that_repeat_are_counted_before_they_are_placed(spark):
    docs = spark.range(3_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")
    )
    placed = mixing.stream(docs, 0)
    starts = sorted(r["start"] for r in placed.collect())
    assert starts == [3 * i for i in range(3_000)]


# --- the user's columns

INNER = ["digest", "_digest", "_id", "_h", "_name", "_at", "row_number", "shard", "slot", "_copies", "_bucket", "_first", "fp", "home", "h", "c0"]


def with_inner_names(docs):
    return docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")).alias(n) for n in INNER])


def test_columns_with_names_used_inside_come_back(spark):
    docs = with_inner_names(frames(spark)[0])
    told = lambda df: all(r[n] == (None if r["doc_id"] is None else f"{n}:{r['doc_id']}") for r in df.collect() for n in INNER)
    bench = spark.createDataFrame([(1, odd_documents()[3][1])], "item_id long, text string")
    clean = decontam.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and told(clean) and clean.count() < docs.count()
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and told(kept)
    slim = docs.select("doc_id", *INNER)
    placed = sharding.assign_shards(slim, 4)
    given = [n for n in INNER if n not in ("row_number", "shard", "slot")]
    for r in placed.collect():
        assert all(r[n] == (None if r["doc_id"] is None else f"{n}:{r['doc_id']}") for n in given)
        assert 0 <= r["shard"] < 4


def test_marks_of_a_template_are_always_escaped(spark):
    template = chat.ChatTemplate(before="<U>{role}<T>", after="<E>", control=())
    rows = [(1, 0, "user", "a <E> b \\ <T>"), (1, 1, "assistant", "<U>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(turns, template), template).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r[2], r[3]) for r in rows]
    assert chat.format_conversations(turns, template).first()["formatted"].count("<E>") == 2
    for wrong in ({"before": "x"}, {"after": ""}, {"after": "\n"}, {"control": ("y",)}):
        with pytest.raises(ValueError, match="template"):
            chat.ChatTemplate(**wrong)


# --- the pipeline


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_fingerprint(text):
    import xxhash

    words = plain_words(text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_survivors(docs):
    """The smallest id of every chain of fingerprints four bits or less apart."""
    prints = {d: plain_fingerprint(t) for d, t in docs}
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


def plain_contaminated(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit = set()
    for item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(13, len(w))
        spans = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in spans:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_the_pipeline_against_plain_stages(spark, tmp_path, monkeypatch):
    """run() on a table with a file of each stage kept: toxicity is a classifier and is taken as it
    decides; what follows is worked out apart from the operators."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    stages = {}
    real = corpus_pipeline.keep
    monkeypatch.setattr(corpus_pipeline, "keep", lambda df, name: stages.setdefault(name, real(df, name)))
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, df in stages.items()}
    assert set(texts["toxicity"]) <= set(docs) and len(texts["toxicity"]) > 0.8 * len(docs)
    left = plain_survivors(texts["toxicity"])
    assert sorted(texts["near_duplicates"]) == sorted(t for t in texts["toxicity"] if t[0] in left)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [t for t in texts["near_duplicates"] if not plain_contaminated(t[1], items)]
    assert sorted(texts["decontamination"]) == sorted(clean) and len(clean) < len(texts["near_duplicates"])
    whole = dict(clean)
    size = {d: len(plain_words(t)) for d, t in clean}
    taken = Counter()
    for d, t in texts["mixing"]:
        assert t in whole[d]
        taken[d] += len(plain_words(t))
    assert all(taken[d] <= 2 * size[d] for d in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))

    def coded(text):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((d, *coded(t)) for d, t in texts["mixing"])


def test_words_that_hold_the_mark(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain, coder = Tokenizer.from_file(path), tokens.WordIds(path)
    assert coder.mark is not None
    words = ["a", "b" + tokens.MARK, tokens.MARK, "c'd", "é"]
    ids, ends = coder.coded(words)
    assert [list(ids[a:b]) for a, b in zip([0, *ends], ends)] == [plain.encode(w, add_special_tokens=False).ids for w in words]
