"""Records, sites, money, API tables, caches and query modes on small literal tables."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import registered, sites
from loomspark.functions import requests as R
from loomspark.operators import answers, api, billing, chunking, embedding, pages, search, sync, validation
from loomspark.sources import files


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_urls(spark):
    df = spark.createDataFrame([("1.9", "/a/", "x"), ("1.41", "/b/#y", ""), ("1.42", "/c/", None)], "v string, p string, a string")
    base = sites.base_url(F.col("v"), F.lit("1.42"), "h.example")
    assert [tuple(r) for r in df.select(base, sites.record_id(F.col("v"), F.col("p")), sites.chunk_url(F.lit(""), F.col("p"), F.col("a"))).collect()] == [("https://v1-9.docs.h.example", "v1.9:/a/", "/a/#x"), ("https://v1-41.docs.h.example", "v1.41:/b/#y", "/b/"), ("https://h.example", "v1.42:/c/", "/c/")]
    assert df.agg(sites.newest(F.collect_set("v"))).first()[0] == "1.42"
    refs = spark.createDataFrame([("main",), ("release-1.41",)], "name string")
    assert rows(sites.branches(df.select(F.col("v").alias("version")), refs), "version", "branch") == [("1.41", "release-1.41"), ("1.42", "main"), ("1.9", "main")]
    assert sites.checked_version(df, F.col("v"), F.col("v")).count() == 3
    with pytest.raises(Exception, match="expected version"):
        sites.checked_version(df, F.lit("1.9"), F.col("v")).collect()


def test_token_counter(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    try:
        own = tokenizers.Tokenizer.from_file(path)
    except Exception:  # noqa: BLE001
        pytest.skip("no tokenizer file")
    got = spark.createDataFrame([("A few words.",), (None,), ("",)], "t string").select(sites.token_counter(path)(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(own.encode("A few words.", add_special_tokens=False).ids), 0, 0]


def test_gate_text(spark):
    kind = "name string, stages array<struct<stage:string,fromVersion:string,toVersion:string,defaultValue:boolean,locked:boolean>>, removed boolean, d string"
    stages = [("alpha", "1.30", "1.31", False, None), ("beta", "1.32", "1.32", True, None), ("stable", "1.33", None, True, True)]
    df = spark.createDataFrame([("G", stages, False, "Does it. "), ("H", stages[:1], True, None)], kind)
    got = [r[0] for r in df.select(R.gate_text(F.col("name"), F.lit("1.33"), F.col("stages"), F.col("removed"), F.col("d"), "Quorvane")).collect()]
    assert got[0] == "# Feature gate: G\n\nIn Quorvane v1.33, the `G` feature gate is at the stable stage and is enabled by default.\n\nStage history:\n- alpha (disabled by default): 1.30–1.31\n- beta (enabled by default): 1.32\n- stable (enabled by default, locked): 1.33+\n\nDoes it.\n"
    assert got[1] == "# Feature gate: H\n\nThe `H` feature gate has been removed from Quorvane.\n\nStage history:\n- alpha (disabled by default): 1.30–1.31\n"


PRICES = {"input": 2.0, "output": 10.0, "cache_read": 0.2, "cache_write": 2.5}
PRICE = "input:double,output:double,cache_read:double,cache_write:double"


def test_costs_and_checks(spark):
    usage = "input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint"
    prices = spark.createDataFrame([("m", PRICES)], f"model string, prices struct<{PRICE}>")
    df = spark.createDataFrame([("m", (1000, 100, 500, None), False, 1000), ("m", (1000, 100, 500, 200), True, 300_000), ("n", (1, 1, 1, 1), False, 10), ("m", (0, 0, 0, 0), None, 900_000_000 // 10_000)], f"model string, usage struct<{usage}>, batch boolean, input_tokens long")
    got = df.join(prices, "model", "left").select(billing.cost(F.col("usage"), F.col("prices"), F.col("batch"))).collect()
    assert sorted((r[0] for r in got), key=repr) == sorted([0.0031, 0.0018, None, 0.0], key=repr)
    checked = billing.check_calls(df, prices, F.lit(0.9), 1.0, 100)
    assert rows(checked, "input_tokens", "refusal") == [(10, "unknown model"), (1000, None), (300_000, "input too long"), (90_000, "over budget")]


def test_booked(spark):
    log = [("a", 1, "reserve", 1.0), ("a", 2, "usage", 0.25), ("b", 1, "reserve", 1.0), ("b", 2, "release", -1.0), ("c", 1, "reserve", 0.5), ("d", 1, "reserve", 0.5), ("d", 2, "reserve", 0.5), ("e", 1, "reserve", 1.0), ("e", 2, "usage", 0.1), ("e", 3, "reserve", 0.7), ("f", 1, "reserve", 1.0), ("f", 2, "release", -1.0), ("f", 3, "reserve", 0.3), ("f", 4, "usage", 0.2)]
    df = spark.createDataFrame(log, "request_id string, seq long, kind string, usd double")
    assert rows(billing.booked(df), "request_id", "usd", "state") == [("a", 0.25, "settled"), ("b", 0.0, "released"), ("c", 0.5, "reserved"), ("d", 1.0, "unconfirmed"), ("e", 0.8, "reserved"), ("f", 0.2, "settled")]
    assert billing.booked(df.limit(0)).count() == 0
    requests = spark.createDataFrame([("a", 1.0), ("z", 0.5)], "request_id string, worst double")
    assert rows(billing.settlement(requests, df.where("kind = 'usage'")), "request_id", "used", "released") == [("a", 0.25, 0.75), ("z", 0.0, 0.5)]
    results = spark.createDataFrame([("1", "errored", None, "overloaded", 1), ("1", "succeeded", "x", None, 2), ("2", "errored", None, "invalid", 1), ("3", "expired", None, None, 1)], "custom_id string, type string, text string, error string, seq int")
    good, bad = billing.collected(results, spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "custom_id string"))
    assert rows(good, "custom_id", "text") == [("1", "x")] and rows(bad, "kind", "requests") == [("expired", 1), ("invalid", 1), ("missing", 1)]


def test_guard_and_back_off():
    sent, slept = [], []
    assert billing.guarded(lambda: 5, lambda n: None, lambda: "ok", sent.append) == "ok" and sent == ["ok"]
    with pytest.raises(PermissionError, match="over"):
        billing.guarded(lambda: 9, lambda n: "over budget" if n > 5 else None, lambda: sent.append("no"), sent.append)
    assert sent == ["ok"]
    state = {"n": 0}

    def call():
        state["n"] += 1
        if state["n"] < 4:
            raise TimeoutError
        return state["n"]

    assert billing.with_back_off(call, TimeoutError, sleep=slept.append) == 4 and slept == [1.0, 2.0, 4.0]
    with pytest.raises(TimeoutError):
        billing.with_back_off(lambda: (_ for _ in ()).throw(TimeoutError()), TimeoutError, tries=2, sleep=slept.append)
    with pytest.raises(KeyError):
        billing.with_back_off(lambda: {}["x"], TimeoutError, sleep=slept.append)


def test_evidence_rules(spark):
    passages = spark.createDataFrame([("/p/", "a", "one two three", "r", 0, "c0"), ("/p/", "b", "four five six", "r", 1, "c1"), ("/q/", "a", "x", "s", 0, "c2")], "page string, anchor string, text string, record_id string, ord int, chunk_id string")
    ways = spark.createDataFrame([("1", 0, "/p/", "two", ""), ("2", 0, "/n/", "two", ""), ("3", 0, "/p/", "seven", ""), ("4", 0, "/p/", "two", "z"), ("5", 0, "/p/", "two", "b"), ("6", 0, "/p/", "five", "b"), ("7", 0, "/p/", "", ""), ("8", 0, "/p/", "three four", "")], "id string, fact int, page string, quote string, section string")
    assert rows(validation.check_evidence(ways, passages), "id", "result") == [("1", "ok"), ("2", "page missing"), ("3", "quote missing"), ("4", "section missing"), ("5", "quote not in section"), ("6", "ok"), ("7", "quote missing"), ("8", "quote missing")]
    assert rows(validation.straddling(ways, passages), "id") == [("8",)]


def test_quotas(spark):
    items = spark.createDataFrame([("a", "fact"), ("b", "fact"), ("c", "howto")], "id string, category string")
    assert validation.target_spec("fact=2, howto=1,") == {"fact": 2, "howto": 1}
    validation.assert_quotas(items, {"fact": 2, "howto": 1})
    with pytest.raises(ValueError, match="howto.*version"):
        validation.assert_quotas(items, {"fact": 2, "howto": 2, "version": 1})


def test_api_tables(spark):
    c = spark.createDataFrame([(1, "warm cache of owners", "h1"), (2, "cold queue of owners", "h2")], "id long, text string, content_hash string")
    k = spark.createDataFrame([("h1", "1.9", "c1", "/a/", "A"), ("h1", "1.41", "c2", "/a/", None), ("h2", "1.41", "c3", "/b/", "B")], "content_hash string, version string, chunk_id string, url string, title string")
    q = spark.createDataFrame([("q", "warm cache", "1.9"), ("r", "warm cache", "1.50")], "question_id string, question string, version string")
    got = api.retrieve(q, c, k, answers.RetrievalConfig("keyword", False, 5, 1))
    assert rows(got, "question_id", "chunk_id", "title") == [("q", "c1", "A"), ("r", "c2", "/a/")]
    assert rows(api.health(c, c.limit(0)), "status", "contents", "vectors") == [("ok", 2, 0)]
    requests = spark.createDataFrame([("x", None, 3), (" ", "1.41", 3), ("x" * 501, None, 3), ("x", "new", 3), ("x", "1.41", 0), ("x", "1.41", 99)], "question string, version string, k int")
    assert [r.error for r in api.checked_requests(requests).collect()] == [None, "no question", "question too long", "not a version", "k out of range", "k out of range"]
    scores = spark.createDataFrame([("a", i, float(i % 2)) for i in range(40)], "run string, unit int, value double")
    listed = api.results(scores, spark.createDataFrame([("a", "j1", 1.0), ("a", "j2", 2.0)], "run string, name string, grade double"), 200).first()
    assert listed.low < 0.5 < listed.high and listed.judge_grade == 2.0
    lru = api.Lru(2)
    assert [lru.get(x, lambda x=x: x) for x in "abacb"] == list("abacb") and (lru.hits, lru.misses) == (1, 4)


def test_query_modes(spark):
    c = spark.createDataFrame([(1, "warm cache"), (2, "cold queue"), (3, "tidegate owner")], "id long, text string")
    q = spark.createDataFrame([("q", "warm cache"), ("r", "owner")], "question_id string, question string")
    w = spark.createDataFrame([("q", "queue", "tidegate")], "question_id string, rewrite string, hyde string")
    config = answers.RetrievalConfig("keyword", False, 5, 5)
    found = lambda mode: rows(answers.retrieve_by_mode(q, c, config, w, mode), "question_id", "rank", "content_id")
    assert found("original") == [("q", 1, 1), ("r", 1, 3)] and found("rewrite") == [("q", 1, 2), ("r", 1, 3)] and found("hyde") == [("q", 1, 3), ("r", 1, 3)] and found("union") == [("q", 1, 1), ("q", 2, 2), ("r", 1, 3)]
    reranked = answers.retrieve_by_mode(q, c, answers.RetrievalConfig("keyword", True, 5, 1), w, "union")
    assert rows(reranked, "question_id", "content_id") == [("q", 1), ("r", 3)]
    for bad in (lambda: answers.RetrievalConfig(reranker="none"), lambda: answers.reranker("none"), lambda: answers.searched_questions(q, w, "none")):
        with pytest.raises(ValueError):
            bad()
    asked = answers.ask(q, spark.createDataFrame([("q", "1.41", ""), ("r", "1.41", "")], "question_id string, version string, note string"), c, answers.RetrievalConfig(k=2))
    assert asked.answers.count() == 2 and set(asked.seconds) == {"version", "retrieve", "answer"}


def test_approximate_search_finds_most(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    v = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "id long, grp int, v array<float>")
    q = v.where("id % 50 = 0")
    exact = {(r.question_id, r.content_id) for r in search.vector_top_k(q, v, 5).collect()}
    near = {(r.question_id, r.content_id) for r in search.vector_top_k(q, v, 5, exact=False, probes=6).collect()}
    assert len(exact) == len(near) == 150 and len(exact & near) >= 0.9 * len(exact)


def test_caches(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "k string, t string")
    cache = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2)], "k string, score double, seq int")
    got, new = embedding.with_cache(asked, cache, "k", "score", lambda df: df.withColumn("score", F.lit(9.0)))
    assert rows(got, "k", "score") == [("a", 2.0), ("b", 9.0), ("b", 9.0)] and rows(new, "k", "score") == [("b", 9.0)]
    made = embedding.embed_texts(asked.where("k = 'a'"), "k", "t", "hashed-64")
    assert embedding.verified(made, asked.where("k = 'a'"), "k").count() == 1
    with pytest.raises(ValueError, match="1 contents"):
        embedding.verified(made, asked, "k")


def test_partitions_locks_and_stages(spark, tmp_path):
    path = str(tmp_path / "occurrences")
    kind = "id int, index_name string"
    sync.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], kind), path, "index_name")
    sync.replace_partitions(spark.createDataFrame([(3, "a")], kind), path, "index_name")
    assert rows(spark.read.parquet(path), "id", "index_name") == [(2, "b"), (3, "a")]
    sync.stage(spark.range(3), "staged")
    assert spark.sql("select count(*) from staged").first()[0] == 3
    lock = spark.createDataFrame([("1.42", "main", "c2", {"pages": 3}), ("1.41", "release-1.41", "c1", None)], files.LOCK)
    files.write_lock(lock, str(tmp_path / "lock"))
    assert rows(files.read_lock(spark, str(tmp_path / "lock")), "version", "commit", "files") == [("1.41", "c1", None), ("1.42", "c2", {"pages": 3})]
    assert files.read_lock(spark, str(tmp_path / "none")).count() == 0
    files.create_tables(spark, str(tmp_path / "tables"))
    files.create_tables(spark, str(tmp_path / "tables"))
    assert {"contents_tbl", "occurrences_tbl", "embeddings_tbl"} <= {t.name for t in spark.catalog.listTables()}


def test_chunk_rows_and_states(spark):
    df = spark.createDataFrame([(1, "T", "## A\n\nwords here", "/p/", "1.41", "page", "T", "s.md", "c")], "id long, t string, text string, url string, version string, kind string, title string, source_path string, commit string")
    got = pages.chunk_rows(pages.chunk_pages(df, "id", "t", "text"), df).first()
    assert got.url == "/p/#a" and len(got.content_hash) == 64 and got.version == "1.41"
    s = spark.createDataFrame([("x\nFeature state: `v1 [beta]`", None), ("none", None)], f"t string, states array<{pages.STATE}>")
    assert [r.lines for r in pages.state_mismatches(s, "t", "states").collect()] == [1]


def test_strategies_and_udfs(spark):
    df = spark.createDataFrame([(1, "w " * 200)], "id int, text string")
    assert chunking.chunked("fixed-128", df, "id", F.col("text")).count() == 2
    with pytest.raises(ValueError, match="fixed-128"):
        chunking.chunked("none", df, "id", F.col("text"))
    registered.register(spark)
    assert spark.sql("select weighted_median(v, w) from values (1D, 1D), (5D, 3D), (9D, 1D) t(v, w)").first()[0] == 5.0
