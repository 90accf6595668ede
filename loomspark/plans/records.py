"""Queries of records: their URLs and ids, unions of kinds, orders, strategies, caches of questions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import requests as R
from loomspark.functions import sites
from loomspark.functions import text as T
from loomspark.operators import chunking, sync
from loomspark.operators.rows import latest
from loomspark.plans.catalog import ANSWERS, CHUNKS, ITEMS, SECTIONS, query
from loomspark.plans.search import _TERMS, questions, ranked_hits
from loomspark.session import table

HOST = "quorvane.example"
_LAST = "(SELECT version FROM chunks WHERE version IS NOT NULL ORDER BY list_transform(string_split(version, '.'), lambda p: CAST(p AS INT)) DESC LIMIT 1)"
_BASE = f"CASE WHEN version = {_LAST} THEN 'https://{HOST}' ELSE 'https://v' || replace(version, '.', '-') || '.docs.{HOST}' END"


def _chunks(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return latest(table(spark, d, "chunks"), "chunk_id", keep=keep)


def _newest(spark: SparkSession, d: str) -> DataFrame:
    return F.broadcast(table(spark, d, "chunks").agg(sites.newest(F.collect_set("version")).alias("newest")))  # one row


@query("record_urls", f"SELECT DISTINCT record_id, 'v' || version || ':' || regexp_replace(url, '#.*$', '') AS id, {_BASE} || regexp_replace(url, '#.*$', '') AS url FROM {CHUNKS}")
def record_urls(spark: SparkSession, d: str) -> DataFrame:
    """A record's id and address out of its version and path."""
    c = _chunks(spark, d, "record_id", "version", "url").crossJoin(_newest(spark, d))
    page = F.regexp_replace("url", "#.*$", "")
    return c.select("record_id", sites.record_id(F.col("version"), page).alias("id"), F.concat(sites.base_url(F.col("version"), F.col("newest"), HOST), page).alias("url")).distinct()


@query("chunk_urls", f"SELECT chunk_id, {_BASE} || regexp_replace(url, '#.*$', '') || coalesce('#' || nullif(anchor, ''), '') AS url FROM {CHUNKS}")
def chunk_urls(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "version", "url", "anchor").crossJoin(_newest(spark, d))
    return c.select("chunk_id", sites.chunk_url(sites.base_url(F.col("version"), F.col("newest"), HOST), F.col("url"), F.col("anchor")).alias("url"))


_REFS = "(VALUES ('main'), ('release-1.41'), ('release-1.42'), ('release-1.43')) r(name)"


@query("version_branches", f"SELECT v.version, coalesce(r.name, 'main') AS branch FROM (SELECT DISTINCT version FROM chunks) v LEFT JOIN {_REFS} ON r.name = 'release-' || v.version")
def version_branches(spark: SparkSession, d: str) -> DataFrame:
    refs = spark.createDataFrame([("main",), ("release-1.41",), ("release-1.42",), ("release-1.43",)], "name string")
    return sites.branches(table(spark, d, "chunks").select("version").distinct(), refs)


@query("version_sanity", f"SELECT version, count(DISTINCT record_id) AS records FROM {CHUNKS} GROUP BY version")
def version_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Records by version, after a check that fails the read where a record's id names another version."""
    c = sites.checked_version(_chunks(spark, d, "version", "record_id"), F.col("version"), F.regexp_extract("record_id", "^v([^:]+):", 1))
    return c.groupBy("version").agg(F.countDistinct("record_id").alias("records"))


@query("records_by_path", f"SELECT regexp_replace(url, '#.*$', '') AS path, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS records FROM {CHUNKS} GROUP BY 1")
def records_by_path(spark: SparkSession, d: str) -> DataFrame:
    """All records of a path, one a version at most, so the list is short."""
    return _chunks(spark, d, "record_id", "url").groupBy(F.regexp_replace("url", "#.*$", "").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("record_id")), ",").alias("records"))


@query("record_kinds", f"SELECT kind, version, count(*) AS records, CAST(count(full_link) AS BIGINT) AS links FROM (SELECT DISTINCT 'page' AS kind, version, record_id AS id, NULL AS full_link FROM {CHUNKS} UNION ALL SELECT 'glossary', version, id, full_link FROM glossary_terms UNION ALL SELECT DISTINCT 'feature_gate', c.version, u.s.feature_gate, NULL FROM {CHUNKS} c, unnest(c.feature_states) AS u(s) WHERE u.s.feature_gate IS NOT NULL) GROUP BY kind, version")
def record_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pages, glossary terms and feature gates as one table; columns that a kind lacks are null."""
    c = _chunks(spark, d, "version", "record_id", "feature_states")
    pages = c.select(F.lit("page").alias("kind"), "version", F.col("record_id").alias("id")).distinct()
    gates = c.select("version", F.explode("feature_states.feature_gate").alias("id")).where("id is not null").distinct().withColumn("kind", F.lit("feature_gate"))
    terms = table(spark, d, "glossary_terms").select(F.lit("glossary").alias("kind"), "version", "id", "full_link")
    every = pages.unionByName(terms, allowMissingColumns=True).unionByName(gates, allowMissingColumns=True)
    return every.groupBy("kind", "version").agg(F.count("*").alias("records"), F.count("full_link").alias("links"))


ORDER = ("fact", "howto", "version", "multihop", "false_premise", "unanswerable")
_ORDER = "list_position([" + ", ".join(f"'{c}'" for c in ORDER) + "], category)"


@query("items_in_order", f"SELECT id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY coalesce({_ORDER}, 0), id) AS INT) AS place FROM {ITEMS}")
def items_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Items of a split by an order of categories of one's own, then by id; categories it doesn't name come first. Places are counts of whole categories before, so no task sorts a split."""
    i = latest(table(spark, d, "golden_items"), "id", keep=("split", "category")).withColumn("c", F.coalesce(F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("category")), F.lit(0)))
    before = i.groupBy("split", "c").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return i.join(F.broadcast(before), ["split", "c"]).select("id", "split", (F.col("before") + F.row_number().over(Window.partitionBy("split", "c").orderBy("id"))).cast("int").alias("place"))  # before: a row a split and category


@query("first_passages", f"SELECT c.chunk_id, CAST(u.o - 1 AS INT) AS line_no, u.line FROM {CHUNKS} c, unnest(string_split(c.text, chr(10))) WITH ORDINALITY u(line, o) WHERE regexp_matches(u.line, '(?i)drains? (?:a|the) ') ORDER BY 1, 2 LIMIT 20")
def first_passages(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 matches of a search, for a quick look."""
    lines = _chunks(spark, d, "text").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike("(?i)drains? (?:a|the) ")).orderBy("chunk_id", "line_no").limit(20)


@query("or_queries", f"SELECT question_id, string_agg(DISTINCT term, ' | ' ORDER BY term) AS query FROM {_TERMS} GROUP BY question_id")
def or_queries(spark: SparkSession, d: str) -> DataFrame:
    """A question's different terms as an OR query."""
    q = questions(spark, d).select(F.col("id").alias("question_id"), F.array_sort(F.array_distinct(T.tokens(F.col("question")))).alias("ts"))
    return q.where(F.size("ts") > 0).select("question_id", F.array_join("ts", " | ").alias("query"))


_WS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(
    "chunk_strategies",
    f"""SELECT 'fixed-128' AS strategy, id, CAST(greatest(ceil((len(ws) - 16) / 112), 1) AS BIGINT) AS chunks FROM (SELECT id, {_WS} AS ws FROM contents WHERE text IS NOT NULL) WHERE len(ws) > 0
    UNION ALL SELECT 'fixed-512', id, CAST(greatest(ceil((len(ws) - 64) / 448), 1) AS BIGINT) FROM (SELECT id, {_WS} AS ws FROM contents WHERE text IS NOT NULL) WHERE len(ws) > 0""",
)
def chunk_strategies(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each word strategy of the registry makes of each text."""
    c = table(spark, d, "contents").where("text is not null")
    parts = [chunking.STRATEGIES[name](c, "id", F.col("text")).groupBy("id").agg(F.count("*").alias("chunks")).select(F.lit(name).alias("strategy"), "id", "chunks") for name in ("fixed-128", "fixed-512")]
    return parts[0].unionByName(parts[1])


# ---- caches


@query("missing_queries", f"SELECT DISTINCT trim(regexp_replace(question, '\\s+', ' ', 'g'), ' ') AS question FROM {ITEMS} WHERE split IN ('dev', 'test') AND question IS NOT NULL AND trim(regexp_replace(question, '\\s+', ' ', 'g'), ' ') NOT IN (SELECT trim(regexp_replace(question, '\\s+', ' ', 'g'), ' ') FROM {ITEMS} WHERE split = 'train' AND question IS NOT NULL)")
def missing_queries(spark: SparkSession, d: str) -> DataFrame:
    """The different questions that a cache lacks, in order; the training questions stand for the cache."""
    i = latest(table(spark, d, "golden_items"), "id", keep=("split", "question")).where("question is not null").select("split", T.normalised(F.col("question")).alias("question"))
    return i.where("split in ('dev', 'test')").select("question").distinct().join(i.where("split = 'train'").select("question"), "question", "left_anti").orderBy("question")


@query("cache_split_counts", "SELECT index_name, count(*) AS texts, CAST(count(*) FILTER (hit) AS BIGINT) AS found, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS missing FROM (SELECT index_name, sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM contents WHERE index_name = 'heading-plain') AS hit FROM contents) GROUP BY index_name")
def cache_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """What of each index a cache of one index's texts holds."""
    c = table(spark, d, "contents").select("index_name", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    cache = c.where("index_name = 'heading-plain'").select("key", F.lit("v").alias("value"), F.lit(1).alias("seq"))
    found, missing = sync.cache_split(c, cache, "key")
    both = found.select("index_name", F.lit(1).alias("f")).unionByName(missing.select("index_name", F.lit(0).alias("f")))
    return both.groupBy("index_name").agg(F.count("*").alias("texts"), F.sum("f").alias("found"), F.sum(1 - F.col("f")).alias("missing"))


@query(
    "rerank_cache_keys",
    f"""SELECT r.question_id, r.config_id, sha256('lumen-rerank-1' || chr(10) || q.question || chr(10) || string_agg(sha256(c.text), ',' ORDER BY r.rank)) AS key FROM (SELECT h.*, row_number() OVER (PARTITION BY h.question_id, h.config_id ORDER BY CASE WHEN c.score_kind = 'distance' THEN h.score ELSE -h.score END, h.content_id) AS rank FROM (SELECT * FROM hits WHERE score IS NOT NULL AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY question_id, config_id, content_id ORDER BY loaded_at DESC) = 1) h JOIN retrieval_configs c USING (config_id)) r
    JOIN {ITEMS} q ON q.id = r.question_id JOIN contents c ON c.id = r.content_id WHERE q.question IS NOT NULL AND c.text IS NOT NULL GROUP BY r.question_id, r.config_id, q.question""",
)
def rerank_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of a rerank call's scores: model, question and candidates in their order, which are as many as the config's."""
    q = questions(spark, d).where("question is not null").select(F.col("id").alias("question_id"), "question")
    c = table(spark, d, "contents").where("text is not null").select(F.col("id").alias("content_id"), F.sha2("text", 256).alias("h"))
    rows = ranked_hits(spark, d).select("question_id", "config_id", "content_id", "rank").join(q, "question_id").join(c, "content_id")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"]), ",")
    return rows.groupBy("question_id", "config_id", "question").agg(texts.alias("t")).select("question_id", "config_id", R.rerank_key(F.lit("lumen-rerank-1"), F.col("question"), F.col("t")).alias("key"))


@query("page_anchors", f"SELECT record_id, count(*) AS sections, count(DISTINCT anchor) AS anchors, CAST(count(*) FILTER (title IS NULL) AS BIGINT) AS untitled FROM {SECTIONS} GROUP BY record_id")
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "sections"), "section_id", keep=("record_id", "anchor", "title"))
    return s.groupBy("record_id").agg(F.count("*").alias("sections"), F.countDistinct("anchor").alias("anchors"), F.count_if(F.col("title").isNull()).alias("untitled"))


_URLS = "list_filter(us, lambda u, i: list_position(us, u) = i)"


@query("answer_lines", f"SELECT row_id, concat(coalesce(answer, ''), CASE WHEN stop_reason = 'max_tokens' THEN chr(10) || chr(10) || '(answer cut off)' ELSE '' END, coalesce(chr(10) || chr(10) || nullif(array_to_string(list_transform({_URLS}, lambda u, i: '[' || i || '] ' || u), chr(10)), ''), '')) AS text FROM (SELECT row_id, answer, stop_reason, list_transform(sources, lambda s: s.url) AS us FROM {ANSWERS})")
def answer_lines(spark: SparkSession, d: str) -> DataFrame:
    """An answer as a terminal shows it: its text, a note if it was cut off, and its different sources by number, in the order of their first use."""
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("answer", "stop_reason", "sources"))
    urls = F.array_distinct(F.transform("sources", lambda s: s["url"]))
    return a.select("row_id", R.rendered_answer(F.col("answer"), F.col("stop_reason"), urls).alias("text"))
