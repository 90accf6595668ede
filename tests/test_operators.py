"""Core operators on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunking, dedupe, ledger, metrics, pages, search, sync, validation
from loomspark.operators.components import connected_components
from loomspark.operators.rows import latest


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (5, 5), (200, 201), (201, 200), (None, 3)]
    got = dict(values(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_latest_row(spark):
    df = spark.createDataFrame([(1, "a", "2031-01-01"), (1, "b", "2031-01-02"), (2, "c", None), (None, "d", None)], "k int, v string, t string").withColumn("loaded_at", F.to_timestamp("t"))
    assert values(latest(df, "k"), "k", "v") == [(1, "b"), (2, "c"), (None, "d")]
    assert latest(df, "k").columns == df.columns


@pytest.mark.parametrize(
    "question,want",
    [("In v1.36, why?", ["1.36"]), ("1.36.2 or 1.37", ["1.36", "1.37"]), ("wait 1.5 seconds", []), ("pi is 11.36", []), ("10.25 and 1.255", []), ("1.41", ["1.41"]), ("in 1.42.", ["1.42"])],
)
def test_version_mentions(spark, question, want):
    assert spark.createDataFrame([(question,)], "q string").select(T.version_mentions(F.col("q"))).first()[0] == want


def test_text_expressions(spark):
    row = spark.createDataFrame([("https://h.io/docs/x/?a=1#part", "`Kind` of [Link](/x/) fields!", "a \n b", " a  b ")], "u string, h string, t string, q string").select(
        T.page_identity(F.col("u")), T.fragment(F.col("u")), T.anchor(F.col("h")), T.contains_quote(F.col("t"), F.col("q")), T.contains_quote(F.col("t"), F.lit(" ")), T.url_path(F.lit("content/en/docs/x/_index.md")), T.url_path(F.lit("content/en/docs/x/y.md")), T.front_matter(F.lit("---\ntitle: A\n---\nBody")),
        T.page_title(F.lit(""), F.lit(None).cast("string"), F.lit("x\n## Head\n"), F.lit("a/b.md")), T.tidy(F.lit("a  \n\n\n\nb<!-- x -->\n")), F.array_sort(F.array(T.version_key(F.lit("1.9")), T.version_key(F.lit("1.41"))))[1],
    ).first()
    assert list(row) == ["/docs/x/?a=1", "part", "kind-of-link-fields", True, False, "/docs/x/", "/docs/x/y/", "title: A", "Head", "a\n\nb\n", [1, 41]]


def test_first_occurrence_and_versions(spark):
    rows = [("1.41", 5, "c1", "h", "page", "same", 3), ("1.9", 7, "c2", "h", "gloss", "same", 4), ("1.9", 8, "c3", "h", "page", "same", 5), ("1.9", 1, "c4", "h2", "page", "other", 1), ("1.9", 2, "c5", "h3", "page", None, 1)]
    df = spark.createDataFrame(rows, "version string, ord long, chunk_id string, content_hash string, kind string, text string, n_tokens int")
    got = {r.embed_text: r for r in dedupe.contents_of(df, F.col("text")).collect()}
    assert got["same"].kind == "gloss" and got["same"].versions == ["1.9", "1.41"] and got["same"].occurrences == 3 and got[""].occurrences == 1


def test_batches_close_before_a_limit(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([100, 100, 100, 500, 10])], "g string, id int, n int")
    got = dict(values(chunking.packed(df, "g", F.col("id"), F.col("n"), 2, 300), "id", "bin"))
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_windows_and_islands(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None), (4, "a\nb\n\nc\n```\n\nx\n```\nd")], "id int, t string")
    assert [r.text for r in chunking.fixed_windows(df.where("id = 1"), "id", F.col("t"), 4, 1).orderBy("window_no").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert chunking.fixed_windows(df.where("id in (2, 3)"), "id", F.col("t"), 4, 1).count() == 0
    assert values(chunking.line_islands(df.where("id = 4"), "id", F.col("t")), "is_code", "lines", "first_line") == [(0, 1, 3), (0, 1, 8), (0, 2, 0), (1, 4, 4)]


def test_rrf_value_and_union(spark):
    lists = spark.createDataFrame([("q", 1, 1, 1), ("q", 1, 2, 2), ("q", 1, 3, 3), ("q", 2, 3, 1), ("q", 2, 4, 2), ("q", 2, 1, 3)], "question_id string, list_no int, content_id long, rank int")
    got = {r.content_id: (r.score, r["rank"], r.first_list) for r in search.rrf(lists, 10).collect()}
    assert got[1] == (round(1 / 61 + 1 / 63, 6), 1, 1) and got[3][:2] == (round(1 / 61 + 1 / 63, 6), 2) and got[4][2] == 2
    assert [r.content_id for r in search.union_of_candidates(lists).orderBy("position").collect()] == [1, 2, 3, 4]


def test_exact_vectors(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [1.0, 0.0]), (4, "a", None), (5, "a", [0.0, 0.0]), (6, "a", [1.0]), (7, "a", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, grp string, v array<float>")
    q = df.where("id = 1")
    assert [r.content_id for r in search.exact_vector_top_k(q, df, 3).orderBy("rank").collect()] == [3, 7, 2]
    assert [r.content_id for r in search.exact_vector_top_k(q, df, 3, same_group=True).orderBy("rank").collect()] == [7, 2]
    assert search.exact_vector_top_k(df.where("id = 4"), df, 3).count() == 0
    many = spark.createDataFrame([(i, "a", [1.0, 0.0]) for i in range(200)], "id long, grp string, v array<float>").repartition(3)
    assert [r.content_id for r in search.exact_vector_top_k(many.where("id = 0"), many, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def case(spark, hits, facts):
    ranked = spark.createDataFrame([("k", "i", r, p, t) for r, (p, t) in enumerate(hits, 1)], "run string, id string, rank int, page string, text string")
    table = spark.createDataFrame([("i", n, p, q) for n, ways in enumerate(facts) for p, q in ways], "id string, fact int, page string, quote string")
    return metrics.retrieval_metrics(metrics.first_covering_rank(ranked, table, ["run"]), ["run"]).first()


def test_retrieval_metrics(spark):
    m = case(spark, [("/a/", "no"), ("/a/", "the  quote\nhere")], [[("/a/", "quote here")]])
    assert (m.mrr, m.ndcg_10, m.recall_1, m.recall_3, m.hit_3) == (0.5, round(1 / math.log2(3), 6), 0.0, 1.0, 1)
    m = case(spark, [("/b/", "quote here")], [[("/a/", "quote here")]])
    assert (m.mrr, m.recall_10) == (0.0, 0.0)
    m = case(spark, [("/a/", "x quote"), ("/a/", "x quote"), ("/c/", "alt")], [[("/a/", "quote")], [("/b/", "none"), ("/c/", "alt")]])
    assert m.recall_1 == 0.5 and m.recall_3 == 1.0 and m.ndcg_10 == round((1 + 1 / 2) / (1 + 1 / math.log2(3)), 6)


def test_kappa_and_confusion(spark):
    pairs = [(1, 1)] * 20 + [(0, 0)] * 15 + [(1, 0)] * 5 + [(0, 1)] * 10
    got = metrics.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b", 2).first()
    assert (got.n, got.agreement, got.kappa) == (50, 0.7, 0.4)
    assert metrics.kappa(spark.createDataFrame([(1, 1), (1, None)], "a int, b int"), "a", "b", 2).first().kappa == 1.0


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", i, 1.0 if i < 80 else 0.0) for i in range(100)] + [("c", i, 0.5) for i in range(30)] + [("g", 1000, None)], "g string, u int, x double")
    got = {r.g: r for r in metrics.bootstrap(df, "g", "u", "x", 200, 7).collect()}
    assert got["g"].n == 100 and got["g"].mean == 0.8 and got["g"].low < 0.8 < got["g"].high and got["g"].share_not_above_0 == 0.0 and (got["c"].low, got["c"].high) == (0.5, 0.5)
    assert {r.g: tuple(r) for r in metrics.bootstrap(df.repartition(7), "g", "u", "x", 200, 7).collect()} == {k: tuple(r) for k, r in got.items()}


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(f"i{k}", "a" if k < 90 else "b", f"pair:p{k // 2}" if k < 10 else "") for k in range(92)], "id string, category string, notes string")
    sample = values(metrics.stratified(df, "id", "category", 10, 7), "category")
    assert sample.count(("b",)) == 1 and sample.count(("a",)) == 10
    split = {r.id: r.split for r in validation.assign_splits(df, {"a": 31, "b": 1}, 7).collect()}
    assert sum(v == "dev" for k, v in split.items() if int(k[1:]) < 90) == 31 and sum(v == "dev" for k, v in split.items() if int(k[1:]) >= 90) == 1
    assert all(split[f"i{2 * k}"] == split[f"i{2 * k + 1}"] for k in range(5))


def test_broken_rules(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 9)], "id string, n int")
    assert values(validation.broken_rules(df, "id", {"small": "n < 5", "missing": "n is null"}), "id", "errors") == [("a", "small"), ("b", "missing")]


def test_sync_keeps_ids(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 7)], "key string, id long")
    new = spark.createDataFrame([("b",), ("c",), ("d",), ("e",), ("e",), (None,)], "key string")
    plan = sync.sync_plan(old, new)
    got = {r.key: (r.id, r.action) for r in plan.collect()}
    assert got["a"] == (1, "delete") and got["b"] == (2, "keep") and got["c"] == (7, "keep") and {got["d"][0], got["e"][0]} == {8, 9}
    again = sync.sync_plan(plan.where("action <> 'delete'").select("key", "id"), new)
    assert {r.action for r in again.collect()} == {"keep"}
    assert values(sync.sync_stats(plan), "action", "contents") == [("delete", 1), ("insert", 2), ("keep", 2)]
    sync.apply_snapshot(spark, plan, spark.createDataFrame([("b", "B"), ("a", "A")], "key string, text string"), str(tmp_path))
    assert values(sync.read_snapshot(spark, str(tmp_path)), "key", "text", "id") == [("b", "B", 2)]
    found, missing = sync.cache_split(new.where("key is not null").distinct(), spark.createDataFrame([("b", 1, 1), ("b", 2, 2)], "key string, value int, seq int"), "key")
    assert values(found, "key", "value") == [("b", 2)] and missing.count() == 3


def test_ledger(spark):
    rows = [(1, "u", "2031-01-01 00:00:00", 1.1), (2, "u", "2031-01-01 00:00:30", 2.2), (3, "u", "2031-01-02 00:00:00", 3.3), (4, "v", "2031-01-01 00:00:00", 5.0)]
    df = spark.createDataFrame(rows, "id int, who string, t string, usd double").withColumn("ts", F.to_timestamp("t"))
    balanced = ledger.running_balance(df, "who", ["ts", "id"], F.col("usd"))
    assert {r.id: float(r.balance) for r in balanced.collect()} == {1: 1.1, 2: 3.3, 3: 6.6, 4: 5.0}
    assert values(ledger.over_budget(balanced, 4.0), "id") == [(3,), (4,)]
    row = spark.range(1).select(ledger.usage_cost(F.lit(1000), F.lit(100), F.lit(1.0), F.lit(5.0), F.lit(True)), ledger.worst_case(F.lit(1000), F.lit(10), F.lit(1.0), F.lit(1.25), F.lit(5.0))).first()
    assert tuple(row) == (0.00075, 0.0013)


def test_limiter_counts_admitted_requests_only(spark):
    rows = [(i, "c", f"2031-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 9, 10, 11, 12])] + [(99, None, "2031-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id int, who string, t string").withColumn("ts", F.to_timestamp("t"))
    got = dict(values(ledger.admitted(df, "who", "ts", "id", 2, 10), "id", "admitted"))
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_sessions(spark):
    df = spark.createDataFrame([("u", "2031-01-01 00:00:00"), ("u", "2031-01-01 00:10:00"), ("u", "2031-01-01 02:00:00")], "who string, t string").withColumn("ts", F.to_timestamp("t"))
    assert values(ledger.sessions(df, "who", "ts", 1800), "session", "events") == [(1, 2), (2, 1)]


def test_skip_reasons(spark):
    rows = [("a/x.md", False, False, True, "t"), ("bad/x.md", True, False, True, "t"), ("h.md", True, None, None, "t"), ("d.md", None, True, None, "t"), ("r.md", None, None, False, "t"), ("e.md", None, None, None, " "), ("n.md", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, headless boolean, draft boolean, rendered boolean, text string")
    assert [r.skip for r in pages.skip_reasons(df, ("bad/",)).orderBy("path").collect()] == [None, "excluded", "draft", "empty", "headless", "empty", "not rendered"]


def test_occurrence_choice(spark):
    wanted = spark.createDataFrame([("h", "1.41"), ("h", "1.9"), ("h", None)], "content_hash string, wanted_version string")
    seen = spark.createDataFrame([("h", "v::10", "1.41"), ("h", "v::2", "1.41"), ("h", "w::1", "1.42"), ("h", "x::1", "1.9")], "content_hash string, chunk_id string, version string")
    got = {r.wanted_version: r.chunk_id for r in search.choose_occurrence(wanted, seen, "content_hash", T.version_key(F.col("version"))).collect()}
    assert got == {"1.41": "v::10", "1.9": "x::1", None: "w::1"}


def test_spread(spark, tmp_path):
    from loomspark.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped and spread(spark.range(100, numPartitions=50)).rdd.getNumPartitions() == 50
