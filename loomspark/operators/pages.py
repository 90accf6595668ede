"""Pages as tables: rendering, HTML conversion and chunking inside Arrow batches; filters, inventory and report in expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import html, sections, shortcodes, sites
from loomspark.functions.text import tag_count
from loomspark.session import cut

STATE = "struct<feature_gate:string,state:string,since:string,default_enabled:boolean>"
#: Characters of a site's dimension tables that may be sent to the executors.
SITE_MOST = 256 << 20


def _size(df: DataFrame | None, size: str) -> int:
    return 0 if df is None else df.agg(F.sum(F.length(F.expr(size)))).first()[0] or 0


def site_of(version: str, latest: str, *, params: DataFrame | None = None, labels: DataFrame | None = None, glossary: DataFrame | None = None, gates: DataFrame | None = None, files: DataFrame | None = None, **names: str) -> shortcodes.Site | None:
    """A site's dimension tables (params, labels and files: key, value; glossary: id, title, body; gates: name, stages) on the driver; None if together they have
    more than SITE_MOST characters, for `render_pages_by_joins`. names: the other fields of a Site."""
    sizes = [_size(params, "value"), _size(labels, "value"), _size(glossary, "concat(id, coalesce(title, ''), coalesce(body, ''))"), _size(gates, "to_json(struct(name, stages))"), _size(files, "concat(key, value)")]
    if sum(sizes) > SITE_MOST:
        return None
    rows = lambda df: [] if df is None else df.collect()
    return shortcodes.Site(
        version, latest, {r.key: r.value for r in rows(params)}, {r.key: r.value for r in rows(labels)}, {r.id.lower(): {"title": r.title, "body": r.body or ""} for r in rows(glossary)},
        {r.name: [s.asDict() for s in r.stages] for r in rows(gates)}, {r.key: r.value for r in rows(files)}, **names,
    )


def _rendered(df: DataFrame, id: str, site: shortcodes.Site) -> DataFrame:
    """df: id, t (text), front (JSON), path, found (JSON of what the page needs beside the site's own tables). The rest as in `render_pages`."""
    sent = df.sparkSession.sparkContext.broadcast(site)
    kind = dict(df.dtypes)[id]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, front, path, found in zip(pdf["t"], pdf["front"], pdf["path"], pdf["found"]):
                own = sent.value
                if found:
                    dims = {"term": {}, "gate": {}, "file": {}}
                    for x in json.loads(found):
                        dims[x["kind"]][x["key"]] = json.loads(x["value"])
                    own = replace(own, glossary=own.glossary | dims["term"], gates=own.gates | dims["gate"], files=own.files | dims["file"])
                out.append(shortcodes.clean(t, own, json.loads(front) if front else None, path or "") if t is not None else None)
            yield pd.DataFrame({id: pdf[id], "text": [r.text if r else None for r in out], "feature_states": [r.states if r else [] for r in out], "warnings": [r.warnings if r else [] for r in out]})

    return df.mapInPandas(work, f"{id} {kind}, text string, feature_states array<{STATE}>, warnings array<string>")


def render_pages(df: DataFrame, id: str, text: str, site: shortcodes.Site, front: str | None = None, path: str | None = None) -> DataFrame:
    """(id, text, feature_states, warnings): each page with its template calls replaced, its HTML converted and its space tidied; what is fenced code stays code.

    front: a column of front matter as JSON; path: one of paths below the site's root. Null texts stay null without warnings."""
    none = F.lit(None).cast("string")
    return _rendered(df.select(id, F.col(text).alias("t"), (F.col(front) if front else none).alias("front"), (F.col(path) if path else none).alias("path"), none.alias("found")), id, site)


def render_pages_by_joins(df: DataFrame, id: str, text: str, site: shortcodes.Site, glossary: DataFrame | None = None, gates: DataFrame | None = None, files: DataFrame | None = None, front: str | None = None, path: str | None = None) -> DataFrame:
    """`render_pages` for dimension tables of any size (glossary: id, title, body; gates: name, stages; files: key, value): each page gets the rows that it needs by joins.

    What a page's calls name is looked up, then what the texts found name, as deep as includes may nest; so only named rows travel. Ids are unique and not null."""
    none = F.lit(None).cast("string")
    dims = [
        x for x in (
            glossary.select(F.lit("term").alias("kind"), F.lower("id").alias("key"), F.to_json(F.struct("title", F.coalesce("body", F.lit("")).alias("body"))).alias("value"), F.col("body").alias("text")) if glossary is not None else None,
            gates.select(F.lit("gate").alias("kind"), F.col("name").alias("key"), F.to_json("stages").alias("value"), none.alias("text")) if gates is not None else None,
            files.select(F.lit("file").alias("kind"), "key", F.expr("substring(to_json(array(value)), 2, length(to_json(array(value))) - 2)").alias("value"), F.col("value").alias("text")) if files is not None else None,
        ) if x is not None
    ]
    pages = df.select(id, F.col(text).alias("t"), (F.col(front) if front else none).alias("front"), (F.col(path) if path else none).alias("path"))
    if not dims:
        return _rendered(pages.withColumn("found", none), id, site)
    known = reduce(DataFrame.unionByName, dims).where("key is not null").groupBy("kind", "key").agg(F.max(F.struct("value", "text")).alias("v")).select("kind", "key", "v.*")
    kind = dict(df.dtypes)[id]

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, key) for i, t, p in zip(pdf[id], pdf["text"], pdf["path"]) if t for k, key in sorted(shortcodes.needs(t, p or ""))]
            yield pd.DataFrame(rows, columns=[id, "kind", "key"])

    found: DataFrame | None = None
    texts = pages.select(id, F.col("t").alias("text"), "path")
    for _ in range(shortcodes.DEEPEST):
        wanted = texts.mapInPandas(named, f"{id} {kind}, kind string, key string").distinct()
        if found is not None:
            wanted = wanted.join(found, [id, "kind", "key"], "left_anti")
        new = cut(wanted.join(known, ["kind", "key"]).select(id, "kind", "key", "value", "text"))
        if new.isEmpty():
            break
        found = new.drop("text") if found is None else found.unionByName(new.drop("text"))
        texts = new.where("text is not null").join(pages.select(id, "path"), id).select(id, "text", "path")
    if found is None:
        return _rendered(pages.withColumn("found", none), id, site)
    per_page = found.groupBy(id).agg(F.to_json(F.collect_list(F.struct("kind", "key", "value"))).alias("found"))  # what one page names
    return _rendered(pages.join(per_page, id, "left").select(id, "t", "front", "path", "found"), id, site)


def convert_html(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text): HTML as Markdown, outside of fenced code. Texts without '<' and '&' don't leave the JVM."""
    kind = dict(df.dtypes)[id]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id: pdf[id], "text": [html.convert(t) for t in pdf["text"]]})

    rows = df.select(id, F.col(text).alias("text"))
    marked = F.coalesce(F.contains("text", F.lit("<")) | F.contains("text", F.lit("&")), F.lit(False))
    return rows.where(~marked).unionByName(rows.where(marked).mapInPandas(work, f"{id} {kind}, text string"))


def chunk_pages(df: DataFrame, id: str, title: str, text: str, states: str | None = None, most: int = 512, least: int = 64, count: Callable[[str], int] = sections.words) -> DataFrame:
    """(chunk_id, id, ord, heading_path, anchor, text, n_tokens, feature_states): chunks of every page, page by page, without a shuffle. Null texts have none."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, name, body, held in zip(pdf["id"], pdf["title"], pdf["text"], pdf["states"]):
                known = [json.loads(s) for s in held] if held is not None else []
                rows += [{"chunk_id": f"{key}::{c['ord']}", "id": key, **c} for c in sections.chunk(name or "", body, known, most, least, count)]
            yield pd.DataFrame(rows, columns=["chunk_id", "id", "ord", "heading_path", "anchor", "text", "n_tokens", "feature_states"])

    held = F.transform(F.col(states), F.to_json) if states else F.array().cast("array<string>")
    rows = df.where(F.col(text).isNotNull()).select(F.col(id).cast("string").alias("id"), F.col(title).alias("title"), F.col(text).alias("text"), held.alias("states"))
    return rows.mapInPandas(work, f"chunk_id string, id string, ord int, heading_path array<string>, anchor string, text string, n_tokens int, feature_states array<{STATE}>")


def chunk_rows(chunks: DataFrame, records: DataFrame, id: str = "id") -> DataFrame:
    """Chunks as they are stored: with their URL (the record's with the first section's anchor), the hash of their text, and the record's version, source and commit.

    chunks: as `chunk_pages` gives them; records: id, url, version, kind, title, source_path, commit."""
    rows = chunks.join(records.select(F.col("id").cast("string").alias(id), "url", "version", "kind", "title", "source_path", "commit"), id)
    return rows.withColumn("url", sites.chunk_url(F.lit(""), F.col("url"), F.col("anchor"))).withColumn("content_hash", F.sha2("text", 256))


def state_mismatches(pages: DataFrame, text: str, states: str) -> DataFrame:
    """The pages whose text has another number of state lines than the page has states."""
    return pages.withColumn("lines", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)^Feature state: "))).where(F.col("lines") != F.size(F.coalesce(F.col(states), F.array().cast(f"array<{STATE}>"))))


def skip_reasons(pages: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """pages(path, headless, draft, rendered, text) with skip: why a page is left out, null if it isn't; the first reason that holds counts."""
    out = F.lit(False)
    for prefix in excluded:
        out = out | F.startswith("path", F.lit(prefix))
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    reason = F.when(out, "excluded").when(flag("headless", False), "headless").when(flag("draft", False), "draft").when(~flag("rendered", True), "not rendered").when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "empty")
    return pages.withColumn("skip", reason)


def cleaning_report(rendered: DataFrame, by: str) -> DataFrame:
    """(by, pages, warnings, tags_left, states) of rendered pages."""
    return rendered.groupBy(by).agg(F.count("*").alias("pages"), F.sum(F.size("warnings")).alias("warnings"), F.sum(tag_count(F.coalesce("text", F.lit("")))).alias("tags_left"), F.sum(F.size("feature_states")).alias("states"))


def warning_counts(rendered: DataFrame) -> DataFrame:
    """(warning, pages): how often each warning came up, most frequent first."""
    return rendered.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "warning")
