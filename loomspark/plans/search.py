"""Queries of retrieval: keyword and vector search, fusion, reranking, occurrences, and the metrics of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import metrics, search
from loomspark.operators.rows import latest
from loomspark.plans.catalog import CHUNKS, HITS, ITEMS, query
from loomspark.session import table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains([" + _STOP.replace("{", "{{") + "], w))"
_QUESTIONS = f"(SELECT id AS question_id, question, version FROM {ITEMS} WHERE split IN ('dev', 'test'))"
_TERMS = f"(SELECT question_id, CAST(len(ts) AS BIGINT) AS q_len, unnest(ts) AS term FROM (SELECT question_id, list_distinct({_TOK.format('question')}) AS ts FROM {_QUESTIONS}))"
_POSTS = f"(SELECT doc, len, term, count(*) AS tf FROM (SELECT id AS doc, len({_TOK.format('text')}) AS len, unnest({_TOK.format('text')}) AS term FROM contents WHERE text IS NOT NULL) GROUP BY doc, len, term)"
_KEYWORD = f"(SELECT question_id, doc AS content_id, round(sum(tf / (tf + 1)) / (max(q_len) * log2(2 + max(len))), 6) AS score FROM {_TERMS} JOIN {_POSTS} USING (term) GROUP BY question_id, doc)"
_BM25 = f"""(SELECT question_id, p.doc AS content_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / s.m))), 6) AS score FROM {_TERMS} t JOIN P p ON p.term = t.term
JOIN (SELECT term, count(*) AS df FROM P GROUP BY term) f ON f.term = t.term, (SELECT count(*) AS n, avg(len) AS m FROM (SELECT DISTINCT doc, len FROM P)) s GROUP BY question_id, p.doc)"""


def _top(scores: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, content_id) AS rank FROM {scores} QUALIFY rank <= {k})"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "golden_items"), "id", keep=("split", "question", "version", "category", "evidence")).where("split in ('dev', 'test')")


def contents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contents").where("text is not null")


BM25 = (1.2, 0.75)


def _by_terms(spark: SparkSession, d: str, k: int, bm25: tuple[float, float] | None = None) -> DataFrame:
    return search.term_search(search.query_terms(questions(spark, d), "id", F.col("question")), contents(spark, d), "id", F.col("text"), k, bm25)


@query("keyword_topk", f"SELECT question_id, content_id, score, rank FROM {_top(_KEYWORD, 10)}")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return _by_terms(spark, d, 10)


@query("bm25_topk", f"WITH P AS {_POSTS} SELECT question_id, content_id, score, rank FROM {_top(_BM25, 10)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _by_terms(spark, d, 10, BM25)


_RANKED = f"(SELECT h.*, row_number() OVER (PARTITION BY h.question_id, h.config_id ORDER BY CASE WHEN c.score_kind = 'distance' THEN h.score ELSE -h.score END, h.content_id) AS rank FROM {HITS} h JOIN retrieval_configs c USING (config_id))"


def ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    """hits without redeliveries and without null or NaN scores, with their rank in the list of question and config (lists hold at most the config's candidates)."""
    hits = latest(table(spark, d, "hits").where("score is not null and not isnan(score)"), "question_id", "config_id", "content_id", keep=("score", "url"))
    kinds = table(spark, d, "retrieval_configs").select("config_id", "score_kind")
    strength = F.when(F.col("score_kind") == "distance", F.col("score")).otherwise(-F.col("score"))
    return hits.join(kinds, "config_id").withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "config_id").orderBy(strength, "content_id")))


@query(
    "lexical_fusion_topk",
    f"""WITH P AS {_POSTS}, r AS (SELECT question_id, content_id, rank, 1 AS list_no FROM {_top(_KEYWORD, 50)} UNION ALL SELECT question_id, content_id, rank, 2 FROM {_top(_BM25, 50)}),
    f AS (SELECT question_id, content_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(list_no) AS first_list FROM r GROUP BY 1, 2) SELECT question_id, content_id, score, first_list, rank FROM {_top('f', 10)}""",
)
def lexical_fusion_topk(spark: SparkSession, d: str) -> DataFrame:
    """Two term lists, keyword and BM25, fused."""
    a = _by_terms(spark, d, 50).withColumn("list_no", F.lit(1))
    b = _by_terms(spark, d, 50, BM25).withColumn("list_no", F.lit(2))
    return search.rrf(a.unionByName(b), 10).select("question_id", "content_id", "score", "first_list", "rank")


_DENSE = f"(SELECT question_id, content_id, min(rank) AS rank FROM {_RANKED} WHERE config_id = (SELECT min(config_id) FROM retrieval_configs WHERE method = 'vector') AND rank <= 50 GROUP BY 1, 2)"


@query(
    "hybrid_topk",
    f"""WITH r AS (SELECT question_id, content_id, rank, 1 AS list_no FROM {_DENSE} UNION ALL SELECT question_id, content_id, rank, 2 FROM {_top(_KEYWORD, 50)}),
    f AS (SELECT question_id, content_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(list_no) AS first_list FROM r GROUP BY 1, 2) SELECT question_id, content_id, score, first_list, rank FROM {_top('f', 10)}""",
)
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse: the first vector config's stored list of 50 and the keyword search's 50, fused. `answers.retrieve` does the same with embedded questions."""
    first = table(spark, d, "retrieval_configs").where("method = 'vector'").agg(F.min("config_id").alias("config_id"))  # one row
    dense = ranked_hits(spark, d).where("rank <= 50").join(F.broadcast(first), "config_id", "left_semi").select("question_id", "content_id", "rank", F.lit(1).alias("list_no"))
    sparse = _by_terms(spark, d, 50).select("question_id", "content_id", "rank", F.lit(2).alias("list_no"))
    return search.rrf(dense.unionByName(sparse), 10).select("question_id", "content_id", "score", "first_list", "rank")


@query("rrf_fusion", f"WITH f AS (SELECT question_id, content_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(config_id) AS first_list FROM {_RANKED} GROUP BY 1, 2) SELECT question_id, content_id, score, first_list, rank FROM {_top('f', 8)}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf(ranked_hits(spark, d).withColumnRenamed("config_id", "list_no"), 8).select("question_id", "content_id", "score", "first_list", "rank")


@query(
    "candidate_union",
    f"WITH u AS (SELECT question_id, content_id, min(struct_pack(l := config_id, r := rank)) AS a FROM {_RANKED} GROUP BY 1, 2) SELECT question_id, content_id, row_number() OVER (PARTITION BY question_id ORDER BY a.l, a.r) AS position FROM u",
)
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return search.union_of_candidates(ranked_hits(spark, d).withColumnRenamed("config_id", "list_no"))


_OVERLAP = f"len(list_intersect(list_distinct({_TOK.format('q.question')}), list_distinct({_TOK.format('c.text')}))) / greatest(len(list_distinct({_TOK.format('q.question')})), 1)"
_RERANKED = f"SELECT r.question_id, r.config_id, r.content_id, r.rank, round({_OVERLAP}, 6) AS rerank_score FROM {_RANKED} r JOIN {_QUESTIONS} q ON q.question_id = r.question_id JOIN contents c ON c.id = r.content_id"


def _with_texts(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).select(F.col("id").alias("question_id"), "question")
    c = table(spark, d, "contents").select(F.col("id").alias("content_id"), "text", "n_tokens")
    return ranked_hits(spark, d).select("question_id", "config_id", "content_id", "rank").join(q, "question_id").join(c, "content_id")


@query("rerank_topk", f"SELECT *, row_number() OVER (PARTITION BY question_id, config_id ORDER BY rerank_score DESC, rank) AS new_rank FROM ({_RERANKED}) QUALIFY new_rank <= 5")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.array_distinct(T.tokens(F.col("question"))), F.array_distinct(T.tokens(F.col("text")))
    overlap = F.round(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 6)
    return search.rerank(_with_texts(spark, d), overlap, 5, ("question_id", "config_id")).select("question_id", "config_id", "content_id", "rank", "rerank_score", "new_rank")


_WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


@query(
    "rerank_cost",
    f"SELECT r.question_id, r.config_id, count(*) AS candidates, CAST(floor((max({_WORDS.format('q.question')}) * count(*) + sum({_WORDS.format('c.text')})) * 11 / 10) AS BIGINT) AS tokens FROM {_RANKED} r JOIN {_QUESTIONS} q ON q.question_id = r.question_id JOIN contents c ON c.id = r.content_id GROUP BY 1, 2",
)
def rerank_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_texts(spark, d)
    total = (F.max(T.word_count(F.col("question"))) * F.count("*") + F.sum(T.word_count(F.col("text")))) * 11
    return rows.groupBy("question_id", "config_id").agg(F.count("*").alias("candidates"), F.floor(total / 10).alias("tokens"))


_VECTORS = "(SELECT content_id AS id, model, embedding FROM content_vectors WHERE embedding IS NOT NULL AND len(embedding) = CASE model WHEN 'lumen-embed-2' THEN 96 ELSE 64 END AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0 QUALIFY row_number() OVER (PARTITION BY content_id, model ORDER BY loaded_at DESC) = 1)"
_COS = "round(list_inner_product(CAST(a.{0} AS DOUBLE[]), CAST(b.{0} AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.{0} AS DOUBLE[]), CAST(a.{0} AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.{0} AS DOUBLE[]), CAST(b.{0} AS DOUBLE[])))), 6)"


@query("vector_topk", f"WITH v AS {_VECTORS}, s AS (SELECT a.id AS question_id, b.id AS content_id, {_COS.format('embedding')} AS score FROM v a JOIN v b ON a.model = b.model AND a.id <> b.id WHERE a.id % 50 = 0) SELECT question_id, content_id, score, rank FROM {_top('s', 10)}")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of the query set (ids divisible by 50) among all vectors of the same model, told by its length."""
    v = latest(table(spark, d, "content_vectors"), "content_id", "model", keep=("embedding",)).select(F.col("content_id").alias("id"), F.col("model").alias("grp"), F.col("embedding").alias("v"))
    return search.exact_vector_top_k(v.where("id % 50 = 0"), v, 10)


@query("vector_topk_filtered", f"WITH s AS (SELECT a.vec_id AS question_id, b.vec_id AS content_id, {_COS.format('embedding')} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT question_id, content_id, score, rank FROM {_top('s', 10)}")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return search.exact_vector_top_k(v.where("id % 50 = 0"), v, 10, same_group=True)


@query(
    "occurrence_choice",
    f"""WITH w AS (SELECT DISTINCT h.question_id, h.content_id, q.version AS wanted_version, c.sha FROM {HITS} h JOIN {_QUESTIONS} q ON q.question_id = h.question_id JOIN (SELECT id, sha256(text) AS sha FROM contents WHERE text IS NOT NULL) c ON c.id = h.content_id)
    SELECT question_id, content_id, wanted_version, o.chunk_id, o.version FROM w JOIN {CHUNKS} o ON o.content_hash = w.sha
    QUALIFY row_number() OVER (PARTITION BY question_id, content_id ORDER BY CASE WHEN o.version = wanted_version THEN 0 ELSE 1 END, list_transform(string_split(o.version, '.'), lambda p: -CAST(p AS INT)), o.chunk_id) = 1""",
)
def occurrence_choice(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").where("score is not null and not isnan(score)").select("question_id", "content_id").distinct()
    q = questions(spark, d).select(F.col("id").alias("question_id"), F.col("version").alias("wanted_version"))
    c = contents(spark, d).select(F.col("id").alias("content_id"), F.sha2("text", 256).alias("content_hash"))
    o = latest(table(spark, d, "chunks"), "chunk_id", keep=("content_hash", "version"))
    wanted = hits.join(q, "question_id").join(c, "content_id")
    return search.choose_occurrence(wanted, o, "content_hash", T.version_key(F.col("version"))).select("question_id", "content_id", "wanted_version", "chunk_id", "version")


@query("missing_embeddings", f"SELECT m.model, c.id, c.index_name FROM contents c, (SELECT DISTINCT model FROM content_vectors WHERE model IS NOT NULL) m WHERE NOT EXISTS (SELECT 1 FROM {_VECTORS} v WHERE v.id = c.id AND v.model = m.model)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The contents that have no usable vector, for each model, in the order of their ids."""
    v = _usable(spark, d).select("model", F.col("content_id").alias("id"))
    models = table(spark, d, "content_vectors").where("model is not null").select("model").distinct()  # a handful of rows
    return table(spark, d, "contents").select("id", "index_name").crossJoin(F.broadcast(models)).join(v, ["model", "id"], "left_anti").select("model", "id", "index_name").sortWithinPartitions("model", "id")


def _is_usable() -> Column:
    """Of a row of content_vectors: its vector is finite, not zero and of its model's length."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    dim = F.when(F.col("model") == "lumen-embed-2", 96).otherwise(64)
    return (F.size("embedding") == dim) & finite


def _usable(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are finite, not zero and of their model's length."""
    return latest(table(spark, d, "content_vectors"), "content_id", "model", keep=("embedding",)).where(_is_usable())


@query("embedded_counts", f"SELECT model, count(DISTINCT id) AS contents FROM {_VECTORS} WHERE id IN (SELECT id FROM contents) GROUP BY model")
def embedded_counts(spark: SparkSession, d: str) -> DataFrame:
    v = _usable(spark, d).select("model", F.col("content_id").alias("id"))
    return v.join(table(spark, d, "contents").select("id"), "id", "left_semi").groupBy("model").agg(F.count("*").alias("contents"))


_L2 = "round(sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 5)"


@query("vector_distances", f"WITH v AS {_VECTORS}, s AS (SELECT a.model, a.id AS question_id, b.id AS content_id, {_L2} AS distance FROM v a JOIN v b ON a.model = b.model AND a.id <> b.id WHERE a.id % 50 = 0) SELECT model, question_id, content_id, distance FROM s QUALIFY row_number() OVER (PARTITION BY model, question_id ORDER BY distance, content_id) <= 3")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors by Euclidean distance of the query set (ids divisible by 50), by model. Of a redelivered vector the last usable one counts."""
    sound = table(spark, d, "content_vectors").where(F.col("content_id").isNotNull() & F.col("model").isNotNull() & _is_usable())
    v = latest(sound, "content_id", "model", keep=("embedding",)).select(F.col("content_id").alias("id"), F.col("model").alias("grp"), F.col("embedding").alias("v"))
    return search.nearest_vectors(v.where("id % 50 = 0"), v, 3).withColumnRenamed("grp", "model")


_PAGE = "regexp_replace(regexp_replace({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', '')"
_PAGE_KEYED = f"CASE WHEN regexp_replace({_PAGE}, '\\?.*$', '') IN ('/docs/reference/toggle-register/') THEN regexp_replace({{0}}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') ELSE {_PAGE} END"
_NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"
_FACTS = f"""(SELECT id, fact, {_PAGE_KEYED.format('w.url')} AS page, w.quote AS quote FROM (SELECT i.id, CAST(u.o - 1 AS INT) AS fact, unnest(list_concat([struct_pack(url := u.e.url, quote := u.e.quote)], coalesce(u.e.alternatives, []))) AS w FROM {ITEMS} i, unnest(i.evidence) WITH ORDINALITY u(e, o)))"""
_COVER = f"""R AS (SELECT r.config_id, r.question_id AS id, r.rank, {_PAGE_KEYED.format('r.url')} AS page, {_NORM.format('c.text')} AS text FROM {_RANKED} r JOIN contents c ON c.id = r.content_id), F AS {_FACTS},
H AS (SELECT R.config_id, R.id, F.fact, min(R.rank) AS rank FROM R JOIN F ON F.id = R.id AND F.page = R.page AND length({_NORM.format('F.quote')}) > 0 AND contains(R.text, {_NORM.format('F.quote')}) GROUP BY 1, 2, 3),
C AS (SELECT k.config_id, k.id, f.fact, H.rank FROM (SELECT DISTINCT config_id, id FROM R) k JOIN (SELECT DISTINCT id, fact FROM F) f ON f.id = k.id LEFT JOIN H ON H.config_id = k.config_id AND H.id = k.id AND H.fact = f.fact)"""
_METRICS = f"""{_COVER}, M AS (SELECT config_id, id, count(*) AS facts, {', '.join(f'round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}, CAST(count(*) FILTER (rank <= {k}) > 0 AS INT) AS hit_{k}' for k in metrics.CUTS)},
round(coalesce(1 / min(rank), 0), 6) AS mrr, round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(count(*), 10)), 6) AS ndcg_10 FROM C GROUP BY config_id, id)"""
# An aggregate may not stand inside a subquery, so the ideal gain comes from a list.
_METRICS = _METRICS.replace("(SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(count(*), 10))", "list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1)))")


def covered(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contents").select(F.col("id").alias("content_id"), "text")
    ranked = ranked_hits(spark, d).select("config_id", F.col("question_id").alias("id"), "rank", T.page_identity(F.col("url")).alias("page"), "content_id").join(c, "content_id")
    facts = metrics.facts_of(latest(table(spark, d, "golden_items"), "id", keep=("evidence",)))
    return metrics.first_covering_rank(ranked, facts, ["config_id"])


@query("quote_coverage", f"WITH {_COVER} SELECT config_id, id, fact, rank FROM C")
def quote_coverage(spark: SparkSession, d: str) -> DataFrame:
    return covered(spark, d).select("config_id", "id", "fact", "rank")


@query("retrieval_metrics", f"WITH {_METRICS} SELECT * FROM M")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(covered(spark, d), ["config_id"])


@query(
    "retrieval_summary",
    f"WITH {_METRICS} SELECT config_id, coalesce(category, 'all') AS category, count(*) AS items, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(mrr), 4) AS mrr, round(avg(ndcg_10), 4) AS ndcg_10 FROM M JOIN (SELECT id, category FROM {ITEMS}) i USING (id) GROUP BY GROUPING SETS ((config_id, category), (config_id))",
)
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means overall and by category in one pass."""
    m = metrics.retrieval_metrics(covered(spark, d), ["config_id"]).join(latest(table(spark, d, "golden_items"), "id", keep=("category",)), "id")
    means = [F.round(F.avg(c), 4).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")]
    return m.rollup("config_id", "category").agg(F.count("*").alias("items"), *means).where("config_id is not null").withColumn("category", F.coalesce("category", F.lit("all")))
