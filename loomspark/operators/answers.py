"""From questions to answers in one plan: version, retrieval, reranking, an extractive answer; and the control of model batches."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import embedding, search
from loomspark.session import spread, written


@dataclass(frozen=True)
class RetrievalConfig:
    """method: vector, keyword, bm25 or hybrid (vector and keyword, fused); rerank: reorder the candidates by word overlap; k of them are
    kept; model: the embedder of the questions, out of the registry; index_name: the index searched, where contents name theirs (None: all); exact: compare all
    vectors, or only those in the cells nearest to a question; reranker: the scorer's name."""

    method: str = "hybrid"
    rerank: bool = True
    candidates: int = 50
    k: int = 8
    model: str = "hashed-64"
    index_name: str | None = "heading-plain"
    exact: bool = True
    reranker: str = "overlap"

    def __post_init__(self) -> None:
        if self.reranker not in RERANKERS or self.method not in ("vector", "keyword", "bm25", "hybrid") or not 0 < self.k <= self.candidates:
            raise ValueError(f"not a retrieval config: {self}")


def _by_vectors(questions: DataFrame, contents: DataFrame, vectors: DataFrame | None, model: str, k: int, exact: bool) -> DataFrame:
    """The k contents nearest to each question; vectors(id, model, embedding) are used where the model has one, others are made."""
    asked = embedding.embed_texts(questions, "question_id", "question", model)
    rows = contents.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    if vectors is None:
        made = embedding.embed_texts(spread(rows), "id", "text", model)
    else:
        made = embedding.embed_missing(rows, vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "model", "embedding"), "id", "text", model)
    parts = [x.select(F.col(key).alias("id"), F.lit(0).alias("grp"), F.col("embedding").alias("v")) for x, key in ((asked, "question_id"), (made, "id"))]
    if "version" in questions.columns and "versions" in contents.columns:
        parts[0] = parts[0].join(questions.select(F.col("question_id").alias("id"), "version"), "id")
        parts[1] = parts[1].join(contents.select(F.col("id").cast("long").alias("id"), "versions"), "id")
    return search.vector_top_k(*parts, k, own=False, exact=exact)


def retrieve(questions: DataFrame, contents: DataFrame, config: RetrievalConfig, vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, content_id, rank, score): the k best contents of each question(question_id, question); vectors(id, model, embedding) of contents where there are any.

    Only contents of the config's index count, if contents(id, text) have an index_name, and for a question with a version only those of that version, if they have versions."""
    if config.index_name is not None and "index_name" in contents.columns:
        contents = contents.where(F.col("index_name") == config.index_name)
    versioned = "version" in questions.columns and "versions" in contents.columns
    depth = config.candidates if config.rerank else config.k
    terms = search.query_terms(questions, "question_id", F.col("question"))
    if versioned:
        terms = terms.join(questions.select("question_id", "version"), "question_id")
    by = lambda bm25: search.term_search(terms, contents, "id", F.col("text"), depth, bm25, F.col("versions") if versioned else None)
    lists = {"keyword": lambda: by(None), "bm25": lambda: by((1.2, 0.75)), "vector": lambda: _by_vectors(questions, contents, vectors, config.model, depth, config.exact)}
    if config.method == "hybrid":
        both = [lists[m]().withColumn("list_no", F.lit(i)) for i, m in enumerate(("vector", "keyword"))]
        ranked = search.rrf(both[0].unionByName(both[1]), depth)
    else:
        ranked = lists[config.method]()
    if not config.rerank:
        return ranked.select("question_id", "content_id", "rank", "score")
    return _reranked(ranked, questions, contents, config)


def _terms(text: Column) -> Column:
    return F.array_distinct(T.tokens(text))


#: Rerank scorers by name: what is made of each question and text once, before they meet, and the score of the two. Models of one's own are put in by name; others are refused.
RERANKERS = {"overlap": (_terms, lambda q, t: F.round(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)), 6))}


def reranker(name: str):
    if name not in RERANKERS:
        raise ValueError(f"no rerank model {name}; allowed are {', '.join(sorted(RERANKERS))}")
    return RERANKERS[name]


def _reranked(ranked: DataFrame, questions: DataFrame, contents: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The k best of ranked(question_id, content_id, rank) by the config's scorer; questions and texts are prepared once each, not once a pair."""
    prepare, score = reranker(config.reranker)
    q = questions.select("question_id", prepare(F.col("question")).alias("_q"))
    c = contents.select(F.col("id").alias("content_id"), prepare(F.col("text")).alias("_t"))
    rows = ranked.select("question_id", "content_id", "rank").join(q, "question_id").join(c, "content_id")
    return search.rerank(rows, score(F.col("_q"), F.col("_t")), config.k).select("question_id", "content_id", F.col("new_rank").alias("rank"), F.col("rerank_score").alias("score"))


QUERY_MODES = ("original", "rewrite", "hyde", "union")


def searched_questions(questions: DataFrame, rewrites: DataFrame | None, mode: str) -> DataFrame:
    """(question_id, list_no, question, …) that is searched for by a query mode: the question itself, its rewrite(question_id, rewrite, hyde), a passage that would answer it, or question and rewrite, whose
    candidates are united. A question without a rewrite is searched for as it is; reranking always uses the question."""
    if mode not in QUERY_MODES:
        raise ValueError(f"no query mode {mode}")
    if mode == "original" or rewrites is None:
        return questions.withColumn("list_no", F.lit(1))
    joined = questions.join(rewrites.select("question_id", "rewrite", "hyde"), "question_id", "left")
    other = F.coalesce(F.col("hyde" if mode == "hyde" else "rewrite"), F.col("question"))
    changed = joined.withColumn("question", other).withColumn("list_no", F.lit(2 if mode == "union" else 1)).drop("rewrite", "hyde")
    return questions.withColumn("list_no", F.lit(1)).unionByName(changed) if mode == "union" else changed


def retrieve_by_mode(questions: DataFrame, contents: DataFrame, config: RetrievalConfig, rewrites: DataFrame | None = None, mode: str = "original", vectors: DataFrame | None = None) -> DataFrame:
    """`retrieve` for a query mode: lists of candidates are united, those of the question first, and reranked by the question itself, or cut at k."""
    plain = replace(config, rerank=False, k=config.candidates if config.rerank or mode == "union" else config.k)
    asked = searched_questions(questions, rewrites, mode)
    lists = [retrieve(asked.where(F.col("list_no") == n).drop("list_no"), contents, plain, vectors).withColumn("list_no", F.lit(n)) for n in ((1, 2) if mode == "union" else (1,))]
    united = search.union_of_candidates(reduce(DataFrame.unionByName, lists)).withColumnRenamed("position", "rank")
    if not config.rerank:
        return united.where(F.col("rank") <= config.k)
    return _reranked(united, questions, contents, config)


@dataclass(frozen=True)
class Asked:
    """Answers of a table of questions, the versions chosen, and the seconds that each stage took."""

    answers: DataFrame
    versions: DataFrame
    seconds: dict[str, float]


def ask(questions: DataFrame, versions: DataFrame, contents: DataFrame, config: RetrievalConfig, vectors: DataFrame | None = None) -> Asked:
    """All questions(question_id, question) through the pipeline, stage by stage, each written so that its time can be told: versions(question_id, version, note), retrieval in the version, answers."""
    seconds, began = {}, time.perf_counter()

    def done(stage: str, df: DataFrame) -> DataFrame:
        nonlocal began
        out = written(df)
        seconds[stage], began = round(time.perf_counter() - began, 3), time.perf_counter()
        return out

    chosen = done("version", versions)
    hits = done("retrieve", retrieve(questions.join(chosen.select("question_id", "version"), "question_id"), contents, config, vectors))
    return Asked(done("answer", extractive_answers(questions, hits, contents)), chosen, seconds)


def extractive_answers(questions: DataFrame, ranked: DataFrame, contents: DataFrame, least: float = 0.2) -> DataFrame:
    """(question_id, answer, content_id, found): the sentence of the retrieved contents that shares most terms with the question; below `least` nothing is found."""
    q = questions.select("question_id", _terms(F.col("question")).alias("_q"))
    cut = F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.struct(s.alias("sentence"), _terms(s).alias("terms")))
    rows = ranked.select("question_id", "content_id", "rank").join(q, "question_id").join(contents.select(F.col("id").alias("content_id"), cut.alias("_s")), "content_id")
    sentences = rows.select("question_id", "_q", "content_id", "rank", F.posexplode("_s").alias("pos", "s"))
    scored = sentences.select("question_id", "content_id", "rank", "pos", "s.sentence", F.round(F.size(F.array_intersect("_q", "s.terms")) / F.greatest(F.size("_q"), F.lit(1)), 6).alias("score"))
    best = scored.groupBy("question_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), (-F.col("pos")).alias("p"), "content_id", "sentence")).alias("b"))
    return best.select("question_id", F.when(F.col("b.score") >= least, F.trim("b.sentence")).alias("answer"), F.col("b.content_id").alias("content_id"), (F.col("b.score") >= least).alias("found"))


def batch_state(log: DataFrame) -> DataFrame:
    """(batch_id, status, errors): where each batch stands, from its append-only log(batch_id, seq, status, custom_id, error): the last
    status counts; a batch submitted twice without an answer in between is 'unconfirmed', so that its worst case stays booked."""
    order = Window.partitionBy("batch_id").orderBy("seq")
    twice = log.withColumn("again", (F.col("status") == "submitting") & (F.lag("status").over(order) == "submitting"))
    per = twice.groupBy("batch_id").agg(F.max_by("status", "seq").alias("last"), F.bool_or("again").alias("again"), F.count("error").alias("errors"))
    return per.select("batch_id", F.when(F.col("again") & (F.col("last") == "submitting"), "unconfirmed").otherwise(F.col("last")).alias("status"), "errors")


def to_submit(requests: DataFrame, log: DataFrame) -> DataFrame:
    """The requests(custom_id, …) that no live or settled batch holds: what a resumed run still has to send."""
    held = log.join(batch_state(log).where("status in ('submitting', 'submitted', 'settled')").select("batch_id"), "batch_id", "left_semi").where("error is null").select("custom_id").distinct()
    return requests.join(held, "custom_id", "left_anti")


def resolve_refs(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """refs(page, target) with path and anchor: the first of four places where the target's page exists; null where none does.

    pages: path, as '/docs/x/'. Places: the target as it is, below /docs/, beside the page, below the page."""
    bare = F.regexp_replace(F.regexp_replace("target", "#.*$", ""), "/+$", "")
    here, folder = F.regexp_replace("page", "/+$", ""), F.regexp_replace("page", "[^/]+/*$", "")
    name = F.regexp_replace(bare, "^/+", "")
    places = F.array(F.concat(F.lit("/"), name, F.lit("/")), F.concat(F.lit("/docs/"), name, F.lit("/")), F.concat(folder, name, F.lit("/")), F.concat(here, F.lit("/"), name, F.lit("/")))
    tried = refs.select("page", "target", F.posexplode(places).alias("n", "path"))
    hit = tried.join(pages.select("path").distinct(), "path", "left_semi").groupBy("page", "target").agg(F.min_by("path", "n").alias("path"))
    return refs.join(hit, ["page", "target"], "left").withColumn("anchor", F.regexp_extract("target", "#(.*)$", 1))
