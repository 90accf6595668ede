"""Queries around models: requests, prompts, flags, pipelines, comparisons for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import requests as R
from loomspark.functions import text as T
from loomspark.operators import answers, embedding, search
from loomspark.operators.rows import latest
from loomspark.plans.catalog import ANSWERS, CHUNKS, ITEMS, SQL, query
from loomspark.plans.operations import _PRICES, version_choice
from loomspark.plans.search import _KEYWORD, _METRICS, _POSTS, _QUESTIONS, _TERMS, _top, covered, questions
from loomspark.operators import metrics
from loomspark.session import table


@query("found_flags", f"SELECT row_id, NOT starts_with(coalesce(answer, '{R.NOT_FOUND.replace(chr(39), chr(39) * 2)}'), '{R.NOT_FOUND.replace(chr(39), chr(39) * 2)}') AS found FROM {ANSWERS}")
def found_flags(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "generation_rows"), "row_id", keep=("answer",)).select("row_id", R.found(F.col("answer")).alias("found"))


_SRC = f"SELECT a.row_id, list(coalesce(c.text, '(missing)') ORDER BY u.o) AS texts FROM {ANSWERS} a, unnest(a.sources) WITH ORDINALITY u(s, o) LEFT JOIN {CHUNKS} c ON c.chunk_id = u.s.chunk_id GROUP BY a.row_id"


@query(
    "judge_prompts",
    f"""SELECT a.row_id, md5(concat('Question: ', a.question, chr(10), 'Reference: ', coalesce(nullif(trim(i.reference_answer), ''), '(none)'), chr(10), 'Answer: ', a.answer, chr(10), array_to_string(list_transform(coalesce(s.texts, []), lambda t, n: concat('Source ', n, ': ', t)), chr(10)))) AS digest
    FROM {ANSWERS} a JOIN {ITEMS} i ON i.id = a.id LEFT JOIN ({_SRC}) s ON s.row_id = a.row_id WHERE a.answer IS NOT NULL AND a.question IS NOT NULL""",
)
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("id", "question", "answer", "sources")).where("answer is not null and question is not null")
    texts = latest(table(spark, d, "chunks"), "chunk_id", keep=("text",))
    cited = a.select("row_id", F.posexplode("sources").alias("pos", "s")).select("row_id", "pos", F.col("s.chunk_id").alias("chunk_id")).join(texts, "chunk_id", "left")
    gathered = cited.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))  # the few sources of an answer
    i = latest(table(spark, d, "golden_items"), "id", keep=("reference_answer",))
    rows = a.join(i, "id").join(gathered, "row_id", "left")
    return rows.select("row_id", F.md5(R.judge_prompt(F.col("question"), F.col("reference_answer"), F.col("answer"), F.coalesce("texts", F.array().cast("array<string>")))).alias("digest"))


@query("rewrite_requests", f"SELECT id, 'Write a short passage of documentation that answers: ' || question AS hyde, 'Rewrite as a search query: ' || question AS rewrite FROM {ITEMS} WHERE split IN ('dev', 'test') AND len(evidence) > 0")
def rewrite_requests(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).where(F.size("evidence") > 0)
    return q.select("id", R.rewrite_request(F.col("question"), "hyde").alias("hyde"), R.rewrite_request(F.col("question"), "rewrite").alias("rewrite"))


@query("batch_estimate", f"SELECT run, count(*) AS requests, CAST(sum(CAST((usage.input_tokens * greatest(i, c)::DOUBLE + 1024 * o::DOUBLE) / 1000000 AS DECIMAL(18,9))) AS DOUBLE) AS worst FROM {ANSWERS} a JOIN {_PRICES} USING (run) GROUP BY run")
def batch_estimate(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("baseline", 1.0, 5.0, 1.25), ("default", 1.0, 5.0, 1.25), ("e5-rerank", 3.0, 15.0, 3.75), ("e7-hyde", 3.0, 15.0, 3.75), ("e8-small", 0.25, 1.25, 0.3)], "run string, i double, o double, c double")
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "usage")).join(F.broadcast(prices), "run")
    worst = (F.col("usage.input_tokens") * F.greatest("i", "c") + 1024 * F.col("o")) / 1_000_000
    return a.groupBy("run").agg(F.count("*").alias("requests"), F.sum(worst.cast("decimal(18,9)")).cast("double").alias("worst"))


_ALL_TERMS = f"(SELECT question_id, doc FROM {_TERMS} t JOIN {_POSTS} p USING (term) GROUP BY question_id, doc HAVING count(*) = max(q_len))"


@query("all_terms_match", f"SELECT q.question_id, count(m.doc) AS contents, min(m.doc) AS first_id FROM {_QUESTIONS} q LEFT JOIN {_ALL_TERMS} m ON m.question_id = q.question_id GROUP BY q.question_id")
def all_terms_match(spark: SparkSession, d: str) -> DataFrame:
    """The AND match over all terms of each question; a question without a match has 0 contents."""
    q = questions(spark, d)
    matched = search.all_terms(q, "id", F.col("question"), table(spark, d, "contents"), "id", F.col("text"))
    per = matched.groupBy("question_id").agg(F.count("*").alias("contents"), F.min("content_id").alias("first_id"))
    return q.select(F.col("id").alias("question_id")).join(per, "question_id", "left").select("question_id", F.coalesce("contents", F.lit(0)).alias("contents"), "first_id")


@query("next_ids", f"SELECT split, CAST(max(CAST(split_part(id, '-', 2) AS BIGINT)) + 1 AS BIGINT) AS next_no, count(*) AS items FROM {ITEMS} GROUP BY split")
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    """Where new ids of a split go on."""
    i = latest(table(spark, d, "golden_items"), "id", keep=("split",))
    return i.groupBy("split").agg((F.max(F.split_part("id", F.lit("-"), F.lit(2)).cast("long")) + 1).alias("next_no"), F.count("*").alias("items"))


@query("best_per_metric", f"WITH {_METRICS}, S AS (SELECT config_id, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg_10), 4) AS ndcg_10 FROM M GROUP BY 1), U AS (SELECT config_id, 'recall_10' AS metric, recall_10 AS value FROM S UNION ALL SELECT config_id, 'mrr', mrr FROM S UNION ALL SELECT config_id, 'ndcg_10', ndcg_10 FROM S) SELECT metric, value, config_id FROM U QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, config_id) = 1")
def best_per_metric(spark: SparkSession, d: str) -> DataFrame:
    """The best config of each metric, for a dashboard; metrics as rows."""
    m = metrics.retrieval_metrics(covered(spark, d), ["config_id"])
    means = m.groupBy("config_id").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall_10", "mrr", "ndcg_10")])
    long = means.unpivot("config_id", ["recall_10", "mrr", "ndcg_10"], "metric", "value")
    best = long.groupBy("metric").agg(F.max(F.struct("value", (-F.col("config_id")).alias("c"))).alias("b"))
    return best.select("metric", F.col("b.value").alias("value"), (-F.col("b.c")).alias("config_id"))


@query("examples_by_category", f"SELECT category, count(*) AS examples, min(id) AS first_id FROM {ITEMS} WHERE answerable AND len(evidence) > 0 GROUP BY category")
def examples_by_category(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "golden_items"), "id", keep=("answerable", "evidence", "category")).where("answerable and size(evidence) > 0").groupBy("category").agg(F.count("*").alias("examples"), F.min("id").alias("first_id"))


@query(
    "gate_texts",
    f"""WITH s AS (SELECT DISTINCT u.s.feature_gate AS gate, u.s.state AS state, u.s.since AS since, u.s.default_enabled AS on_default FROM {CHUNKS} c, unnest(c.feature_states) AS u(s) WHERE u.s.feature_gate IS NOT NULL),
    l AS (SELECT gate, since, state, concat('- ', state, ': ', since, CASE WHEN on_default THEN ' (on by default)' WHEN NOT on_default THEN ' (off by default)' ELSE '' END) AS line FROM s)
    SELECT gate, concat('# Feature gate: ', gate, chr(10), chr(10), string_agg(line, chr(10) ORDER BY since, line)) AS text FROM l GROUP BY gate""",
)
def gate_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of a feature gate's record: its stages in order."""
    s = latest(table(spark, d, "chunks"), "chunk_id", keep=("feature_states",)).select(F.explode("feature_states").alias("s")).where("s.feature_gate is not null").select("s.*").distinct()
    line = F.concat(F.lit("- "), R.stage_line(F.col("state"), F.col("since"), F.lit(None).cast("string"), F.col("default_enabled")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("since", line.alias("line")))), lambda x: x["line"])  # the few stages of a gate
    return s.groupBy(F.col("feature_gate").alias("gate")).agg(F.concat(F.lit("# Feature gate: "), F.first("feature_gate"), F.lit("\n\n"), F.array_join(ordered, "\n")).alias("text"))


@query("vector_index_names", "SELECT model, CAST(mode(len(embedding)) AS INT) AS dim, concat('vectors_', regexp_replace(lower(model), '[^a-z0-9]+', '_', 'g'), '_', mode(len(embedding))) AS name FROM content_vectors WHERE len(embedding) > 0 GROUP BY model")
def vector_index_names(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "content_vectors").where("size(embedding) > 0").groupBy("model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    return v.groupBy("model").agg(F.max_by("dim", "n").alias("dim")).select("model", "dim", R.index_name(F.col("model"), F.col("dim")).alias("name"))


@query("link_targets", f"SELECT CAST(count(*) AS BIGINT) AS links, CAST(count(path) AS BIGINT) AS resolved FROM (SELECT g.row_id, g.full_link, min(c.page) AS path FROM glossary_terms g LEFT JOIN (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS page FROM {CHUNKS}) c ON c.page IN (concat('/', regexp_replace(regexp_replace(regexp_replace(g.full_link, '#.*$', ''), '/+$', ''), '^/+', ''), '/'), concat('/docs/', regexp_replace(regexp_replace(regexp_replace(g.full_link, '#.*$', ''), '/+$', ''), '^/+', ''), '/')) WHERE g.full_link IS NOT NULL GROUP BY 1, 2)")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many links of the glossary lead to a page of the corpus."""
    refs = table(spark, d, "glossary_terms").where("full_link is not null").select(F.lit("/").alias("page"), F.col("full_link").alias("target"), "row_id")
    pages = latest(table(spark, d, "chunks"), "chunk_id", keep=("url",)).select(F.regexp_replace("url", "#.*$", "").alias("path"))
    found = answers.resolve_refs(refs.select("page", "target").distinct(), pages).select("target", "path")
    return refs.join(found, "target").agg(F.count("*").alias("links"), F.count("path").alias("resolved"))


@query("ask")
def ask(spark: SparkSession, d: str) -> DataFrame:
    """All questions through the whole pipeline: the version, hybrid retrieval in it, reranking, an extractive answer."""
    chosen = version_choice(spark, d).select(F.col("id").alias("question_id"), "version")
    q = questions(spark, d).select(F.col("id").alias("question_id"), "question").join(chosen, "question_id")
    c = table(spark, d, "contents").where("text is not null").select("id", "text", "versions", "index_name")
    return answers.extractive_answers(q, answers.retrieve(q, c, answers.RetrievalConfig()), c)


_IN_VERSION = f"(SELECT k.* FROM {_KEYWORD} k JOIN contents c ON c.id = k.content_id JOIN ({SQL['version_choice']}) v ON v.id = k.question_id WHERE c.index_name = 'heading-plain' AND list_contains(c.versions, v.version))"


@query("keyword_topk_version", f"SELECT question_id, content_id, score, rank FROM {_top(_IN_VERSION, 10)}")
def keyword_topk_version(spark: SparkSession, d: str) -> DataFrame:
    """The keyword search as a question's pipeline runs it: in the chosen version and one index."""
    chosen = version_choice(spark, d).select(F.col("id").alias("question_id"), "version")
    terms = search.query_terms(questions(spark, d), "id", F.col("question")).join(chosen, "question_id")
    docs = table(spark, d, "contents").where("text is not null and index_name = 'heading-plain'")
    return search.term_search(terms, docs, "id", F.col("text"), 10, versions=F.col("versions"))


@query("embedded_contents")
def embedded_contents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all contents by the default embedder; each different text is embedded once."""
    c = table(spark, d, "contents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text", "index_name")
    # What one index embedded before is the cache of the load of all.
    cache = embedding.embed_texts(c.where("index_name = 'heading-plain'").groupBy("key").agg(F.first("text").alias("text")), "key", "text", "hashed-64")
    return embedding.verified(embedding.embed_missing(c, cache, "key", "text", "hashed-64"), c, "key").select("key", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))
