"""Requests, prompts, pipelines, embedding and settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import config
from loomspark.functions import requests as R
from loomspark.operators import answers, embedding, search


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_expressions(spark):
    null = F.lit(None).cast("string")
    row = one(
        spark, R.client_id(F.lit(" 1.2.3.4, 5.6.7.8"), F.lit("h")), R.client_id(null, F.lit("h")), R.client_id(F.lit(""), null), R.found(F.lit("Yes.")), R.found(F.lit(R.NOT_FOUND + " docs.")), R.found(null), R.stage_line(F.lit("beta"), F.lit("1.30"), F.lit("1.32"), F.lit(True)), R.stage_line(F.lit("ga"), F.lit("1.33"), null, F.lit(None).cast("boolean")),
        R.index_name(F.lit("Some-Model 2"), F.lit(96)), R.frame(F.lit("hits"), F.struct(F.lit(1).alias("n"))), R.rewrite_request(F.lit("Why?"), "rewrite"), R.judge_prompt(F.lit("q"), F.lit(" "), F.lit("a"), F.array(F.lit("s"), null)),
    )
    assert list(row) == ["1.2.3.4", "h", "unknown", True, False, False, "beta: 1.30–1.32 (on by default)", "ga: 1.33", "vectors_some_model_2_96", 'event: hits\ndata: {"n":1}\n\n', "Rewrite as a search query: Why?", "Question: q\nReference: (none)\nAnswer: a\nSource 1: s\nSource 2: (missing)"]


def test_replies(spark):
    reply = json.dumps({"correctness": 2, "correctness_reason": "r", "claims": [{"claim": "a", "support": "supported"}, {"claim": "b", "support": "partial"}, {"claim": "c", "support": "none"}, {"claim": "d", "support": "none"}]})
    df = spark.createDataFrame([([("thinking", "x"), ("text", reply), ("text", "!")],), ([("text", "no json")],), ([],)], "blocks array<struct<type:string,text:string>>")
    g = R.grade_of_reply(F.col("blocks"))
    rows = df.select(g["correctness"].alias("c"), R.faithfulness(g["claims"]).alias("f"), R.text_of_blocks(F.col("blocks")).alias("t")).collect()
    assert [r.c for r in rows] == [2, None, None] and rows[0].f == 0.375 and rows[1].f is None and rows[0].t == reply + "!" and rows[2].t == ""
    request = json.loads(one(spark, R.answer_request(F.lit("Why?"), F.lit("1.42"), F.array(R.document(F.lit("/x/"), F.lit("1.42"), F.lit("text"))), F.lit("large-3")))[0])
    assert request["thinking"] is True and request["prompt"].startswith("[1] URL: /x/\nVersion: 1.42\n\ntext\n\nQuestion (version 1.42): Why?")


def test_settings(spark):
    df = spark.createDataFrame([("a = 1\n[t]\nb = 'x'",), ("not = = toml",), (None,)], "t string")
    assert [json.loads(r[0]) if r[0] else None for r in df.select(config.toml_to_json("t")).collect()] == [{"a": 1, "t": {"b": "x"}}, None, None]
    if config.yaml is not None:
        df = spark.createDataFrame([("title: A\naka: [b]",), (": :\n -",), (None,), ("",)], "t string")
        assert [json.loads(r[0]) if r[0] else None for r in df.select(config.yaml_to_json("t")).collect()] == [{"title": "A", "aka": ["b"]}, None, None, {}]


DOCS = [(1, "The cache of a queue is warm. Poll it twice."), (2, "A disk holds snapshots of the cache."), (3, None), (4, ""), (5, "Nothing here matters much")]


def test_term_search_equals_the_joined_form(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    q = spark.createDataFrame([("a", "warm cache queue"), ("b", "snapshots snapshots disk"), ("c", "zebra"), ("d", None)], "question_id string, question string")
    terms = search.query_terms(q, "question_id", F.col("question"))
    got = {(r.question_id, r.content_id): r.score for r in search.term_search(terms, docs, "id", F.col("text"), 5).collect()}
    tf = 0.5
    assert got[("a", 1)] == round(3 * tf / (3 * np.log2(2 + 5)), 6) and got[("a", 2)] == round(tf / (3 * np.log2(2 + 4)), 6) and set(got) == {("a", 1), ("a", 2), ("b", 2)}
    monkeypatch.setattr(search, "BLOCK", 1)
    assert {(r.question_id, r.content_id): r.score for r in search.term_search(terms, docs, "id", F.col("text"), 5).collect()} == got
    ranked = search.term_search(terms, docs, "id", F.col("text"), 1, (1.2, 0.75)).collect()
    assert {(r.question_id, r.content_id, r["rank"]) for r in ranked} == {("a", 1, 1), ("b", 2, 1)}
    assert search.term_search(terms.limit(0), docs, "id", F.col("text"), 1).count() == 0 and search.term_search(terms, docs.limit(0), "id", F.col("text"), 1).count() == 0


def test_ask(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    q = spark.createDataFrame([("a", "Which cache is warm in the queue?"), ("b", "snapshots of what disk")], "question_id string, question string")
    for method in ("keyword", "bm25", "hybrid"):
        ranked = answers.retrieve(q, docs, answers.RetrievalConfig(method, True, 5, 2))
        got = {r.question_id: (r.answer, r.content_id, r.found) for r in answers.extractive_answers(q, ranked, docs).collect()}
        assert got["a"] == ("The cache of a queue is warm.", 1, True) and got["b"][1] == 2
    with pytest.raises(ValueError):
        answers.RetrievalConfig("other")


def test_vectors_find_contents_without_a_shared_term(spark, monkeypatch):
    near = {"automobile": [1.0, 0.1], "a car drives": [1.0, 0.2], "the cat sleeps": [0.0, 1.0]}
    monkeypatch.setitem(embedding.EMBEDDERS, "said", lambda texts, near=near: np.array([near.get(t, [0.0, 0.0]) for t in texts], np.float32))
    docs = spark.createDataFrame([(1, "the cat sleeps"), (2, "a car drives"), (3, "automobile")], "id long, text string")
    q = spark.createDataFrame([("a", "automobile"), ("b", None)], "question_id string, question string")
    got = {m: [(r.question_id, r.content_id) for r in answers.retrieve(q, docs, answers.RetrievalConfig(m, False, 5, 2, "said")).orderBy("rank").collect()] for m in ("keyword", "vector", "hybrid")}
    assert got == {"keyword": [("a", 3)], "vector": [("a", 3), ("a", 2)], "hybrid": [("a", 3), ("a", 2)]}
    stored = spark.createDataFrame([(1, "said", [1.0, 0.1]), (2, "other", [1.0, 0.1]), (3, "said", None)], "id long, model string, embedding array<float>")
    assert {r.content_id for r in answers.retrieve(q, docs, answers.RetrievalConfig("vector", False, 5, 2, "said"), stored).collect()} == {1, 3}


@pytest.mark.parametrize("method", ["keyword", "bm25", "vector", "hybrid"])
def test_retrieval_keeps_to_version_and_index(spark, method):
    docs = spark.createDataFrame(
        [(1, "warm cache", ["1.42"], "heading-plain"), (2, "warm cache", ["1.41"], "fixed-512"), (3, "a warm cache of disks", ["1.41", "1.42"], "heading-plain"), (4, "warm cache", None, "heading-plain"), (5, "the warm cache again and again", ["1.41"], "heading-plain")],
        "id long, text string, versions array<string>, index_name string",
    )
    q = spark.createDataFrame([("a", "warm cache", "1.41"), ("b", "warm cache", "1.42"), ("c", "warm cache", None)], "question_id string, question string, version string")
    got = {}
    for r in answers.retrieve(q, docs, answers.RetrievalConfig(method, False, 2, 2)).collect():
        got.setdefault(r.question_id, set()).add(r.content_id)
    assert got == {"a": {3, 5}, "b": {1, 3}, "c": {1, 4}}


def test_all_terms_of_a_question_count(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "gamma gamma beta alpha delta"), (4, None)], "id long, text string")
    q = spark.createDataFrame([("three", "gamma beta alpha beta"), ("one", "Delta"), ("none", "alpha zebra"), ("empty", None)], "question_id string, question string")
    got = {(r.question_id, r.content_id) for r in search.all_terms(q, "question_id", F.col("question"), docs, "id", F.col("text")).collect()}
    assert got == {("three", 1), ("three", 3), ("one", 3)}


def test_batches(spark):
    log = [("b1", 1, "submitting", "x", None), ("b1", 2, "submitted", "x", None), ("b1", 3, "settled", "x", None), ("b1", 3, "settled", "y", "overloaded"), ("b2", 1, "submitting", "z", None), ("b2", 2, "submitting", "z", None), ("b3", 1, "rejected", "w", None)]
    df = spark.createDataFrame(log, "batch_id string, seq int, status string, custom_id string, error string")
    assert {r.batch_id: (r.status, r.errors) for r in answers.batch_state(df).collect()} == {"b1": ("settled", 1), "b2": ("unconfirmed", 0), "b3": ("rejected", 0)}
    asked = spark.createDataFrame([(c,) for c in "xyzw"], "custom_id string")
    assert {r.custom_id for r in answers.to_submit(asked, df).collect()} == {"y", "z", "w"}


def test_refs(spark):
    pages = spark.createDataFrame([("/docs/a/b/",), ("/docs/a/c/",), ("/docs/x/",)], "path string")
    refs = spark.createDataFrame([("/docs/a/b/", "c#part"), ("/docs/a/b/", "/docs/x"), ("/docs/a/b/", "x/"), ("/docs/a/", "b"), ("/docs/a/b/", "none")], "page string, target string")
    got = {(r.page, r.target): (r.path, r.anchor) for r in answers.resolve_refs(refs, pages).collect()}
    assert got == {("/docs/a/b/", "c#part"): ("/docs/a/c/", "part"), ("/docs/a/b/", "/docs/x"): ("/docs/x/", ""), ("/docs/a/b/", "x/"): ("/docs/x/", ""), ("/docs/a/", "b"): ("/docs/a/b/", ""), ("/docs/a/b/", "none"): (None, "")}


def test_embedding_uses_the_cache(spark):
    rows = spark.createDataFrame([("k1", "a b"), ("k1", "a b"), ("k2", None), ("k3", "c")], "key string, text string")
    cache = spark.createDataFrame([("k3", "hashed-64", [9.0]), ("k1", "other", [1.0])], "key string, model string, embedding array<float>")
    got = {r.key: r.embedding for r in embedding.embed_missing(rows, cache, "key", "text", "hashed-64").collect()}
    assert len(got) == 3 and got["k3"] == [9.0] and abs(np.linalg.norm(got["k1"]) - 1) < 1e-6 and not any(got["k2"])


def test_all_terms_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i % 7}") for i in range(60)] + [(99, None), (None, "w1")], "id long, text string")
    asked = spark.createDataFrame([(f"q{i}", f"W{i % 3} w{i % 7}?") for i in range(9)] + [("none", "the of"), ("null", None), ("odd", "w1 nothing")], "id string, question string")
    words = lambda t: set(t.lower().strip("?").split())
    want = {(q.id, d.id) for q in asked.collect() for d in docs.collect() if q.question and d.text and d.id is not None and q.id not in ("none",) and words(q.question) <= words(d.text)}
    for size in (8192, 4):
        monkeypatch.setattr(search, "BLOCK", size)
        assert {(r.question_id, r.content_id) for r in search.all_terms(asked, "id", F.col("question"), docs, "id", F.col("text")).collect()} == want
    assert len(want) > 20
