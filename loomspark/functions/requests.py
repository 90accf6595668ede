"""Requests to models and their answers, as columns: prompts, documents, flags, citations, frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an answer that found nothing begins, and the models that take a thinking parameter.
NOT_FOUND = "I couldn't find this in the"
THINKING = ("large-2", "large-3")


def client_id(forwarded: Column, host: Column) -> Column:
    """The first forwarded address, else the host, else 'unknown'."""
    return F.coalesce(F.nullif(F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1))), F.lit("")), F.nullif(F.trim(host), F.lit("")), F.lit("unknown"))


def found(answer: Column) -> Column:
    return ~F.startswith(F.coalesce(answer, F.lit(NOT_FOUND)), F.lit(NOT_FOUND))


def document(url: Column, version: Column, text: Column) -> Column:
    return F.concat(F.lit("URL: "), url, F.lit("\nVersion: "), version, F.lit("\n\n"), text)


def answer_request(question: Column, version: Column, documents: Column, model: Column) -> Column:
    """A JSON request: the documents as numbered blocks, the question, and thinking for models that have it."""
    blocks = F.array_join(F.transform(documents, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n\n")
    prompt = F.concat(blocks, F.lit("\n\nQuestion (version "), version, F.lit("): "), question)
    return F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), model.isin(*THINKING).alias("thinking")))


def rewrite_request(question: Column, mode: str) -> Column:
    """The request of a query mode: 'rewrite' asks for search words, 'hyde' for a passage that would answer."""
    task = {"rewrite": "Rewrite as a search query: ", "hyde": "Write a short passage of documentation that answers: "}[mode]
    return F.concat(F.lit(task), question)


def judge_prompt(question: Column, reference: Column, answer: Column, sources: Column) -> Column:
    """Numbered sources, '(missing)' for texts that aren't there."""
    numbered = F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(": "), F.coalesce(s, F.lit("(missing)")))), "\n")
    return F.concat(F.lit("Question: "), question, F.lit("\nReference: "), F.coalesce(F.nullif(F.trim(reference), F.lit("")), F.lit("(none)")), F.lit("\nAnswer: "), answer, F.lit("\n"), numbered)


def text_of_blocks(blocks: Column) -> Column:
    """All text blocks of a reply, joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def grade_of_reply(blocks: Column) -> Column:
    """The first text block of a judge's reply as its structure; null if there is none or it isn't JSON."""
    first = F.try_element_at(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(1))["text"]
    return F.from_json(first, "correctness int, correctness_reason string, claims array<struct<claim:string,support:string>>")


def faithfulness(claims: Column) -> Column:
    """Mean of 1, a half and 0 for supported, partly supported and other claims; null without claims."""
    weights = F.transform(claims, lambda c: F.when(c["support"] == "supported", 1.0).when(c["support"] == "partial", 0.5).otherwise(0.0))
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(claims), F.lit(0))


def frame(event: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def stage_line(stage: Column, since: Column, until: Column, on: Column) -> Column:
    """'beta: 1.30–1.32 (on by default)': the end is left open where there is none."""
    span = F.when(until.isNull() | (until == since), since).otherwise(F.concat(since, F.lit("–"), until))
    return F.concat(stage, F.lit(": "), span, F.when(on, " (on by default)").when(~on, " (off by default)").otherwise(""))


def index_name(model: Column, dim: Column) -> Column:
    return F.concat(F.lit("vectors_"), F.regexp_replace(F.lower(model), "[^a-z0-9]+", "_"), F.lit("_"), dim.cast("string"))


def rerank_key(model: Column, question: Column, texts: Column) -> Column:
    """The cache key of a rerank call; texts is one string of the hashes of its texts."""
    return F.sha2(F.concat(model, F.lit("\n"), question, F.lit("\n"), texts), 256)


def rendered_answer(answer: Column, stop_reason: Column, urls: Column) -> Column:
    """An answer's text, a note if it was cut off, and its sources by number."""
    note = F.when(stop_reason == "max_tokens", "\n\n(answer cut off)").otherwise("")
    listed = F.array_join(F.transform(urls, lambda u, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), u)), "\n")
    return F.concat(F.coalesce(answer, F.lit("")), note, F.coalesce(F.concat(F.lit("\n\n"), F.nullif(listed, F.lit(""))), F.lit("")))


def gate_stage(stage: Column, since: Column, until: Column, on: Column, locked: Column) -> Column:
    """'- beta (enabled by default, locked): 1.43+': a stage that has no end goes on, one that ends where it began is one version."""
    span = F.when(until.isNull(), F.concat(since, F.lit("+"))).when(until == since, since).otherwise(F.concat(since, F.lit("–"), until))
    return F.concat(F.lit("- "), stage, F.lit(" ("), F.when(on, "enabled").otherwise("disabled"), F.lit(" by default"), F.when(locked, ", locked").otherwise(""), F.lit("): "), span)


def gate_text(name: Column, version: Column, stages: Column, removed: Column, description: Column, product: str) -> Column:
    """The text of a feature gate's record: whether and how it is there in a version, its stages(stage, fromVersion, toVersion, defaultValue, locked) and its description."""
    now = F.element_at(stages, -1)
    there = F.concat(F.lit(f"In {product} v"), version, F.lit(", the `"), name, F.lit("` feature gate is at the "), now["stage"], F.lit(" stage and is "), F.when(F.coalesce(now["defaultValue"], F.lit(False)), "enabled").otherwise("disabled"), F.lit(" by default."))
    gone = F.concat(F.lit("The `"), name, F.lit(f"` feature gate has been removed from {product}."))
    lines = F.array_join(F.transform(stages, lambda s: gate_stage(s["stage"], s["fromVersion"], s["toVersion"], F.coalesce(s["defaultValue"], F.lit(False)), F.coalesce(s["locked"], F.lit(False)))), "\n")
    body = F.concat(F.lit("# Feature gate: "), name, F.lit("\n\n"), F.when(removed, gone).otherwise(there), F.lit("\n\nStage history:\n"), lines, F.lit("\n\n"), F.trim(F.coalesce(description, F.lit(""))))
    return F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n"))
