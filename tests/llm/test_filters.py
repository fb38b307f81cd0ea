"""Copies, toxicity, quality, contamination, licences and URLs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frames, table
from tidemill.llm import components, decontam, licenses, quality, simhash, toxicity, urls

DATA = "/root/testdata/sf0.001"


# --- copies


def plain_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    """Root of each node: the smallest that chains of links reach."""
    root = {}
    for start in sorted(nodes):
        if start in root:
            continue
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in root:
                root[n] = start
                todo += [m for m in nodes if m not in root and linked(n, m)]
    return root


def test_fingerprints(spark):
    docs, _ = frames(spark)
    texts = [r["text"] for r in docs.collect()] + ["a b c", "A B C D", "w" * 300 + " x y z"]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def test_golay_code_is_perfect():
    vectors, weight, begin = simhash.cosets()
    leaders = [weight[begin[s] : begin[s + 1]] for s in range(2048)]
    assert all(w[0] <= 3 and (len(w) == 1 or w[1] > 3) for w in leaders)


@pytest.mark.parametrize("raw_bits", [0, 3, 9])
def test_close_fingerprints_meet_at_a_home(raw_bits):
    rng = np.random.default_rng(raw_bits)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a.copy()
    for i in range(200):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    row, key, home = simhash.anchors(np.concatenate([a, b]), raw_bits, simhash.cosets())
    homes, visits = {}, {}
    for r, k, h in zip(row, key, home):
        visits.setdefault(r, set()).add(k)
        if h:
            homes.setdefault(r, set()).add(k)
    assert all(len(h) == 2 for h in homes.values())
    assert all(homes[i] & visits[i + 200] and homes[i + 200] & visits[i] for i in range(200))


@pytest.mark.parametrize("hot", [False, True])
def test_links_against_all_pairs(spark, monkeypatch, hot):
    if hot:  # many cells even on a small table
        monkeypatch.setattr(simhash, "RESIDENTS", 3)
        monkeypatch.setattr(simhash, "VISITORS", 7)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = set(centre.tolist())
    for c in centre:
        for _ in range(12):
            x = int(c)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    found = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r["node"]: r["root"] for r in components.components(found).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    expected = brute_components(set(signed), near)
    assert {x: got.get(x, x) for x in signed} == expected


def test_near_duplicates_and_deduplicate(spark):
    docs, empty = frames(spark)
    rows = docs.collect()
    prints = {(r["doc_id"], r["text"]): plain_fingerprint(r["text"]) for r in rows}
    root = brute_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _), f in prints.items():
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    expected = sorted(((r["doc_id"], least.get(root[prints[(r["doc_id"], r["text"])]])) for r in rows), key=repr)
    assert table(simhash.near_duplicates(docs), "doc_id", "component_id") == expected
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    stay = [root[prints[(r["doc_id"], r["text"])]] for r in kept.collect()]
    assert sorted(stay) == sorted(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_components_of_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (7, 8), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(chain, "a long, b long"))
    assert table(got, "node", "root") == sorted([(i, 0) for i in range(61)] + [(200, 200), (201, 200)], key=repr)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.run(spark, sf)
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in held} == {0}
    right = sum(r["predicted"] == r["toxic"] for r in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in held)


def test_toxicity_finds_toxic_rows_and_spares_clean_ones(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.run(spark, sf).where("held_out").join(labels, "doc_id").collect()
    told = {k: [r["predicted"] for r in held if r["toxic"] == k] for k in (0, 1)}
    assert len(told[1]) > 50 and sum(told[1]) >= 0.6 * len(told[1])
    assert sum(told[0]) <= 0.05 * len(told[0])


def test_all_ordinary_windows_reach_the_trainer(monkeypatch):
    seen = []

    def train(size, samples, **options):
        seen.extend(samples)
        raise toxicity.zstd.ZstdError("only counted")

    monkeypatch.setattr(toxicity.zstd, "train_dictionary", train)
    toxicity.ordinary_content([[b"w"] * 8 * 70_000], toxicity.FitPlan())
    assert len(seen) == 70_000


def test_toxicity_without_a_class_and_odd_rows(spark):
    docs, empty = frames(spark)
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert model.prior == 0.0
    assert {r["predicted"] for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {0}
    some = spark.createDataFrame([(i, int(i < 6)) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.fit(docs, some)
    assert toxicity.score(docs, model, ["doc_id", "lang"]).count() == docs.count()
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    kept = toxicity.remove_toxic(docs, some)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_copies_are_one_family():
    text = [str(i).encode() for i in range(200)]
    other = [b"x" + w for w in text]
    found = toxicity.families([text, text[:-1] + [b"new"], other, other])
    assert found[0] == found[1] != found[2] == found[3]


# --- quality


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_statistics(spark):
    texts = ["a b c a b c", "a a a a", "a b c", "x\n\nx\n y\ny \nx", "## <b> | $5", None, "", " \n ", "a b c d " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.statistics(docs, ["doc_id"]).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def test_outliers_are_rejected_and_others_kept(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary, 200)), "en", "s") for i in range(150)]
    rows += [(1000 + i, "###$$$ ".join(rng.choice(vocabulary, 200)), "en", "s") for i in range(8)]
    rows += [(2000, "too few words", "en", "s"), (2001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(got[i]["kept"] for i in range(150))
    assert not any(got[1000 + i]["kept"] or got[1000 + i]["base_failed"] for i in range(8))
    assert got[2000]["base_failed"] and got[2001]["base_failed"] and not got[2000]["kept"]


def test_inverse(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 9))
    m = a @ a.T
    df = spark.createDataFrame([([float(x) for x in m.ravel()],)], "m array<double>")
    got = np.array(df.select(quality._inverse(F.col("m"))).first()[0]).reshape(5, 5)
    assert np.allclose(got, np.linalg.inv(m))


def test_quality_of_odd_and_empty_tables(spark):
    docs, empty = frames(spark)
    assert quality.judge(docs).count() == docs.count()
    assert quality.judge(empty).count() == 0


# --- contamination


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, said in items:
        w = plain_words(said)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination_against_brute_force(spark):
    long = [f"w{i}" for i in range(40)]
    items = [
        (1, " ".join(long)), (2, " ".join(long[5:25])), (3, "The, of; AND"), (4, "solo"), (5, None), (6, "..."),
        (10, "a a a a a a a a a a a a a a a"), (11, "two words"), (12, " ".join(long)),
    ]
    texts = [
        " ".join(long), "x " + " ".join(long[3:17]) + " y", " ".join(long[:12]), "the of and", "THE OF of and", "solo solo",
        "a " * 14, "a " * 12, " ".join(long[10:23] + long[30:40]), None, "", "two  words two", "Two-words é " * 30,
        " ".join(long[:20]) + " pad" * 900, "w1 w2 w3 " * 20,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text"), (None, "solo"), (5, "solo solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, benchmark)
    expected = sorted(((d, *brute_contamination(t, items)) for d, t in rows), key=repr)
    found = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()]
    assert sorted(found, key=repr) == expected
    kept = decontam.remove_contaminated(docs, benchmark)
    assert table(kept, "doc_id", "text") == sorted((r for r in rows if not brute_contamination(r[1], items)[3]), key=repr)


def test_contamination_of_odd_and_empty_tables(spark):
    docs, empty = frames(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs, none).count() == docs.count()
    assert decontam.contamination(empty, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontam.contamination(docs, bench).collect()}
    assert got == {r["doc_id"]: brute_contamination(r["text"], items) for r in docs.collect()}


# --- licences


def test_licences_and_inheritance(spark):
    rows = [
        (1, "top/LICENSE", "Released under the MIT License."),
        (2, "top/a/b/c.txt", "plain text without any notice"),
        (3, "top/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "other/x", "long text here\n" * 20 + "Licensed under CC BY-NC 4.0."),
        (5, "other/y", "nothing"), (6, None, None), (7, "top/d", "A license is a thing one may like or not, says who."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, place string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["directory"]) for r in licenses.scan(docs, F.col("place")).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "top/a"), 3: ("Apache-2.0", "own", None),
        4: ("CC-BY-NC-4.0", "own", None), 5: (None, "none", None), 6: (None, "none", None), 7: ("MIT", "inherited", "top"),
    }
    odd, empty = frames(spark)
    assert licenses.scan(odd, F.col("source")).count() == odd.count()
    assert licenses.scan(empty, F.col("source")).count() == 0


# --- URLs


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_rules_of_urls(spark):
    rows = [
        "https://a.example.com/en/1", "http://example.com/en/", "https://www.example.com/en/x", "https://WWW.Example.COM/en/x?q",
        "http://x.net/es/1", "http://x.net/fr", "http://net/fr/#a", "http://my.org/en/", "nonsense", None, "", "ftp://com",
        "http://notexample.com/en/", "http://com/?a=b://c/d", "x://y?z/en/", "http://examplenet/es/",
    ]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(pages, plan=urls.FitPlan(trees=2)).collect()}
    for i, u in enumerate(rows):
        host, path = plain_parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert got[i]["rule"] == (best and best.name)
        assert got[i]["verdict"] in (("allow", "block") if best is None else (best.verdict,))


def test_urls_without_labels(spark):
    one = spark.createDataFrame([(1, "http://my.org/")], "page_id long, url string")
    assert urls.judge(one).first()["verdict"] == "allow"
    assert urls.judge(one.limit(0)).count() == 0


def test_trees_learn_the_labels(spark):
    rows = [(i, f"http://h{i}.net/{'es' if i % 2 else 'index'}/{'123456' if i % 2 else 'abc'}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = (urls.UrlRule("net", "/es/", "block"), urls.UrlRule("net", "/index/", "allow"))
    more = spark.createDataFrame([(-1, "http://z.net/xx/123456"), (-2, "http://z.net/yyyyy/abc")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages.unionByName(more), rules).where("page_id < 0").collect()}
    assert got == {-1: "block", -2: "allow"}


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
