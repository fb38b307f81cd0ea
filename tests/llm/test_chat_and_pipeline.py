"""Chat format, the pipeline's stages, and how the queries are registered."""

import hashlib
import os
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import chat, decontam, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TURNS = "conv_id long, turn long, role string, text string, valid string"


def test_texts_come_back(spark):
    both = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "be <|end|> nice"), (1, 1, "user", "\\<|text|>\\"), (1, 2, "assistant", both + "\\"),
        (2, 1, "assistant", "late"), (2, 0, "user", None), (2, 2, "user", "<<|end|>|"), (2, 3, "assistant", "\n\n"),
        (None, None, None, "who"), (3, 0, "user", ""), (3, 0, "user", ""), (4, 5, "<|turn|>", "x" * 50_000),
    ]
    turns = spark.createDataFrame([(*r, "odd") for r in rows], TURNS)
    formatted = chat.format_conversations(turns)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        got = back[conv]
        assert [(t["role"], t["text"]) for t in got["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert "".join(got["learned"]) == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert back[1]["valid"] and not back[3]["valid"] and not back[4]["valid"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_turn_order(spark):
    orders = ["UA", "SUA", "AU", "UU", "SU", "UAUA", "SA", "USA", "X"]
    names = {"U": "user", "A": "assistant", "S": "system", "X": "critic"}
    rows = [(i, k, names[c], "t", "") for i, o in enumerate(orders) for k, c in enumerate(o)]
    got = chat.format_conversations(spark.createDataFrame(rows, TURNS)).select("conv_id", "valid").collect()
    assert {orders[r["conv_id"]] for r in got if r["valid"]} == {"UA", "SUA", "UAUA"}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("<|turn|>text\\end[INST]/s\n é"), max_size=30), min_size=1, max_size=5))
def test_escapes_are_reversible(spark, texts):
    control = chat.ChatTemplate().control
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t"), control).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in control)


def test_segments_flag_only_what_is_learned(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "assistant", "b", "")], TURNS)
    got = [[(s["text"], s["loss"]) for s in r["segments"]] for r in chat.segments(turns).orderBy("turn").collect()]
    assert got[0] == [("<|turn|>user<|text|>", False), ("a", False), ("<|end|>", False)]
    assert got[1] == [("<|turn|>assistant<|text|>", False), ("b", True), ("<|end|>", False)]


def test_pipeline_stages(spark):
    sys.path.insert(0, ROOT)
    import corpus_pipeline

    from tidemill.llm.common import keep

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = keep(stage(spark, before, sf), name)
        assert sorted(after.columns) == sorted(docs.columns)
        kept[name] = (before, after)
        before = after
    start, end = kept["near_duplicates"]
    marked = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(start).collect()}
    assert {r["doc_id"] for r in end.collect()} == {d for d, c in marked.items() if d == c}
    start, end = kept["decontamination"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = decontam.contamination(start, bench).where("NOT contaminated")
    assert {r["doc_id"] for r in end.collect()} == {r["doc_id"] for r in clean.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert len(rows) == before.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_queries_are_registered():
    sys.path.insert(0, ROOT)
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)


def test_digest_of_a_conversation(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in chat.run(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "".join(f"{r['role']}\n{r['text'] or ''}\n" for r in rows if r["conv_id"] == rows[0]["conv_id"])
    assert got[rows[0]["conv_id"]]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert pytest.approx(got[-1]["n_turns"]) == 2
