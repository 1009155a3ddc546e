"""Classifier, rules, mixing, chats and the pipeline."""

import hashlib
import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roleweave.llm import queries
from roleweave.llm.chat import Fold, escape, format_chats, read_back, render, unescape
from roleweave.llm.mixing import exponent, mix_sources, realise
from roleweave.llm.quality_classifier import classify_quality
from roleweave.llm.quality_rules import quality_rules

DATA = os.environ.get("ROLEWEAVE_DATA", "/root/testdata/sf0.001")
DOC = "doc_id long, text string, id string, label int, rank long"


def corpus(spark):
    good = [(i, f"the house {i} has windows and doors that open to a garden of trees near {i % 7}", "x", 1, 1) for i in range(120)]
    bad = [(i, f"BUY!! NOW!! {i} CHEAP!! $$$ ### click | here | {i % 5} | $$$ *** FREE!! | now", "x", 0, 1) for i in range(120, 240)]
    odd = [(None, None, "x", 1, 1), (300, "", "x", 1, 1), (301, " ", "x", 1, 1), (0, good[0][1], "x", 1, 1)]
    return spark.createDataFrame(good + bad + odd, DOC)


def labels(spark):
    rows = [(i, int(i < 120)) for i in range(240)] + [(None, 1), (5, None), (6, 7), (7, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_classifier(spark):
    docs = corpus(spark)
    rows = classify_quality(docs, labels(spark)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["id"] < 240:
            assert r["predicted"] == int(r["id"] < 120)
    no_labels = classify_quality(docs, labels(spark).limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in no_labels] == [0.5]
    assert classify_quality(docs.limit(0), labels(spark)).collect() == []


def test_quality_rules(spark):
    docs = corpus(spark)
    rows = quality_rules(docs, labels(spark)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["id"] is not None and r["id"] < 240:
            assert r["kept"] == (r["id"] < 120)
        else:
            assert r["base_failed"] and not r["kept"]
    plain = quality_rules(docs, labels(spark).limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in plain)
    assert quality_rules(docs.limit(0), labels(spark)).collect() == []


def test_rules_stay_in_the_planner(spark):
    plan = quality_rules(corpus(spark), labels(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def mixture(spark):
    rows = [(i, "w " * (10 + i % 5), "big", 1) for i in range(400)]
    rows += [(1000 + i, "w " * 10, "small", 1) for i in range(20)] + [(2000 + i, "w " * 10, None, 1) for i in range(20)]
    rows += [(3000, None, "none", 1), (3001, "", "small", 1), (1000, "w " * 10, "small", 1), (None, "w w", "small", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key int")


def test_mixing(spark):
    docs = mixture(spark)
    plan = mix_sources(docs, entropy=0.9, repeats=50.0, block_tokens=200)
    got = realise(docs, plan).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("t"), F.first("mix_weight").alias("w")).collect()
    total = sum(r["t"] for r in got if r["w"])
    for r in got:
        if r["w"]:
            assert abs(r["t"] / total - r["w"]) < 0.01
    assert plan.filter("copies < 1 and n_tokens > 0").count() == 0  # the default budget leaves nothing out
    few = mix_sources(docs, entropy=None, repeats=2.0, budget_share=1.0, block_tokens=200)
    assert few.agg(F.max("copies")).first()[0] <= 3
    assert realise(docs, few).agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] <= 400 * 12 + 460
    assert mix_sources(docs.limit(0)).collect() == []


def test_exponent(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,), (0.0,)], "p double")
    e = exponent(shares, 0.95, None)

    def entropy(e):
        import math

        z = sum(p**e for p in (0.7, 0.2, 0.1))
        return -sum(p**e / z * math.log(p**e / z) for p in (0.7, 0.2, 0.1)) / math.log(3)

    assert entropy(e) >= 0.95 and entropy(e + 1e-5) < 0.95
    r = exponent(shares, None, 2.0, 1.0)
    z = sum(p**r for p in (0.7, 0.2, 0.1))
    assert max(p ** (r - 1) / z for p in (0.7, 0.2, 0.1)) <= 2.0 + 1e-9


TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "a\\l<s>\\", "<<SYS>>\\b[INST", "", "\\", "é\n\n", "<<</s>"]


@pytest.mark.parametrize("text", TRICKY)
def test_chat_round_trip(text):
    rendered, start, end = render("user", text)
    assert unescape(escape(text)) == text
    assert [(r, t) for r, t, _, _ in read_back(rendered * 2)] == [("user", text)] * 2
    assert unescape(rendered[start:end]) == text
    assert "</s>" not in rendered and "[INST]" not in rendered


def test_fold():
    fold = Fold()
    for event in [("message", 1, "user", "hi"), ("delta", 2, "assistant", "he"), ("delta", 2, "assistant", "llo"),
                  ("message", 3, "user", "more"), ("edit", 1, "user", "hey"), ("regenerate", 2, "assistant", "bye"), ("delete", 9, "", "")]:
        fold.take(*event)
    assert list(fold.final()) == [("user", "hey"), ("assistant", "bye")]


def test_format_chats(spark):
    rows = [(1, 2, "message", "b", "assistant", "two", 0), (1, 1, None, "a", "user", None, 0), (1, 3, "delta", "b", "assistant", "!", 0),
            (None, 1, "message", "a", None, "</s>", 0), (1, 1, None, "a", "user", None, 0)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string, n_turns int")
    got = {r["conv"]: r for r in format_chats(log).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {"1": 3, None: 1}
    r = got["1"]
    loss = "".join(unescape(r["formatted"][x["start"] : x["end"]]) for x in r["loss"])
    assert loss == "two!" and r["loss_chars"] == 4 and r["formatted_chars"] == len(r["formatted"])
    assert r["loss_sha256"] == hashlib.sha256(b"two!").hexdigest()
    assert format_chats(log.limit(0)).collect() == []


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_chat_query_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    got = Counter(map(tuple, queries.QUERIES["op8_chat_format"](spark, DATA).collect()))
    assert got == Counter(con.execute(queries.ORACLES["op8_chat_format"]).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert docs.columns == columns and 0 < docs.count() <= before
    assert docs.count() >= before and docs.select("doc_id").distinct().count() == before


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        if os.path.isdir(DATA):
            assert stage(spark, docs, DATA).count() == 0
