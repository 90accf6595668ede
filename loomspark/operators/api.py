"""What a service shows, as tables: health, retrieval, examples, results with intervals; and a cache of responses on the driver."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import answers, metrics


def health(contents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(status, contents, vectors): one row; 'empty' without contents."""
    c, v = contents.agg(F.count("*").alias("contents")), vectors.agg(F.count("*").alias("vectors"))  # one row each
    return c.crossJoin(v).select(F.when(F.col("contents") > 0, "ok").otherwise("empty").alias("status"), "contents", "vectors")


def checked_requests(requests: DataFrame, most_question: int = 500, most_k: int = 20) -> DataFrame:
    """requests(question, version, k) with error: the first rule that a request breaks, null if it may be served."""
    question = F.trim(F.coalesce("question", F.lit("")))
    version = F.col("version").isNotNull() & ~F.coalesce(F.col("version").rlike(r"^\d+\.\d+$"), F.lit(False))
    k = F.coalesce("k", F.lit(0))
    return requests.withColumn("error", F.when(question == "", "no question").when(F.length(question) > most_question, "question too long").when(version, "not a version").when((k < 1) | (k > most_k), "k out of range"))


def retrieve(questions: DataFrame, contents: DataFrame, chunks: DataFrame, config: answers.RetrievalConfig, vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, rank, content_id, score, chunk_id, url, title): hits with where they occur: contents(id, text, content_hash, …), chunks(content_hash, version, chunk_id, url, title). The
    occurrence is that of the question's version, else the newest."""
    from loomspark.functions.text import version_key
    from loomspark.operators.search import choose_occurrence

    hits = answers.retrieve(questions, contents, config, vectors).join(contents.select(F.col("id").alias("content_id"), "content_hash"), "content_id")
    version = F.col("version") if "version" in questions.columns else F.lit(None).cast("string")
    wanted = hits.join(questions.select("question_id", version.alias("wanted_version")), "question_id")
    placed = choose_occurrence(wanted, chunks, "content_hash", version_key(F.col("version")))
    return placed.join(chunks.select("chunk_id", "url", "title"), "chunk_id").select("question_id", "rank", "content_id", "score", "chunk_id", "url", F.coalesce("title", "url").alias("title"))


def examples(items: DataFrame) -> DataFrame:
    """(id, question, category, version) of answerable items with evidence."""
    return items.where("answerable and size(evidence) > 0 and question is not null").select("id", "question", "category", "version")


def results(scores: DataFrame, judges: DataFrame | None = None, samples: int = 2000, seed: int = 7) -> DataFrame:
    """Runs with their mean and interval: scores(run, unit, value); judges(run, name, …) adds the columns of the latest summary, the last by name."""
    listed = metrics.bootstrap(scores, "run", "unit", "value", samples, seed)
    if judges is None:
        return listed
    rest = [c for c in judges.columns if c != "run"]
    last = judges.groupBy("run").agg(F.max_by(F.struct(*rest), "name").alias("j")).select("run", *[F.col("j")[c].alias(f"judge_{c}") for c in rest])
    return listed.join(last, "run", "left")


class Lru:
    """The responses used last, at most `size` of them; a service's driver holds it."""

    def __init__(self, size: int):
        self.size, self.held, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        if key in self.held:
            self.held.move_to_end(key)
            self.hits += 1
            return self.held[key]
        self.misses += 1
        value = make()
        self.held[key] = value
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value
