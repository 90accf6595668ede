"""Queries over the corpus: deduplication, statistics, chunking, URLs, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import shortcodes
from loomspark.functions import text as T
from loomspark.operators import chunking, dedupe, pages
from loomspark.operators.rows import latest
from loomspark.plans.catalog import CHUNKS, SECTIONS, query
from loomspark.session import table

_VK = "list_transform(string_split(version, '.'), lambda p: CAST(p AS INT))"
_FIRST = f"SELECT key, arg_min(struct_pack(content_hash := content_hash, kind := kind, n := n_tokens), ord_key) AS f, list_sort(list(DISTINCT {_VK})) AS vs, count(*) AS occurrences FROM (SELECT *, sha256(coalesce(text, '')) AS key, struct_pack(v := {_VK}, o := ord, c := chunk_id) AS ord_key FROM {CHUNKS}) GROUP BY key"
_JOINED = "array_to_string(list_transform(vs, lambda v: array_to_string(list_transform(v, lambda p: CAST(p AS VARCHAR)), '.')), ',')"


def chunks(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """The chunks without redeliveries, with the columns that a query needs (all, if none are named)."""
    return latest(table(spark, d, "chunks"), "chunk_id", keep=keep or None)


@query("dedupe_contents", f"SELECT key, f.content_hash AS content_hash, f.kind AS kind, f.n AS n_tokens, {_JOINED} AS versions, occurrences FROM ({_FIRST})")
def dedupe_contents(spark: SparkSession, d: str) -> DataFrame:
    c = dedupe.contents_of(chunks(spark, d, "version", "ord", "content_hash", "kind", "text", "n_tokens"), F.col("text"))
    return c.select("key", "content_hash", "kind", "n_tokens", F.array_join("versions", ",").alias("versions"), "occurrences")


@query("dedupe_occurrences", f"SELECT sha256(coalesce(text, '')) AS key, chunk_id, version, url, title, array_to_string(heading_path, ' > ') AS path, content_type FROM {CHUNKS}")
def dedupe_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "text", "version", "url", "title", "heading_path", "content_type").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "chunk_id", "version", "url", "title", F.array_join("heading_path", " > ").alias("path"), "content_type")


@query("breadcrumb_dedupe", f"SELECT sha256(concat(array_to_string(heading_path, ' > '), chr(10), chr(10), text)) AS key, count(*) AS occurrences, min(chunk_id) AS first_chunk FROM {CHUNKS} GROUP BY 1")
def breadcrumb_dedupe(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(T.breadcrumb(F.coalesce("heading_path", F.array().cast("array<string>")), F.coalesce("text", F.lit(""))), 256)
    return chunks(spark, d, "heading_path", "text").groupBy(key.alias("key")).agg(F.count("*").alias("occurrences"), F.min("chunk_id").alias("first_chunk"))


@query(
    "dedupe_report",
    f"""WITH c AS (SELECT *, sha256(coalesce(text, '')) AS key, coalesce(n_tokens, 0) AS n FROM {CHUNKS}),
    k AS (SELECT key, min(n) AS n, count(*) AS occ, count(DISTINCT version || '|' || record_id) AS pages FROM c GROUP BY key),
    m AS (SELECT key, max(pages) AS most FROM (SELECT key, version, count(DISTINCT record_id) AS pages FROM c GROUP BY key, version) GROUP BY key)
    SELECT (SELECT count(*) FROM c) AS chunks, count(*) AS contents, round(count(*) / (SELECT count(*) FROM c), 3) AS content_ratio, CAST((SELECT sum(n) FROM c) AS BIGINT) AS tokens_before, CAST(sum(k.n) AS BIGINT) AS tokens_after,
    CAST(count(*) FILTER (most > 1) AS BIGINT) AS on_several_pages, CAST(count(*) FILTER (occ > pages) AS BIGINT) AS repeated_in_a_page FROM k JOIN m USING (key)""",
)
def dedupe_report(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "text", "version", "record_id", "n_tokens").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "version", "record_id", F.coalesce("n_tokens", F.lit(0)).alias("n"))
    per_version = c.groupBy("key", "version").agg(F.count("*").alias("occ"), F.countDistinct("record_id").alias("pages"), F.min("n").alias("least"), F.sum("n").alias("all"))
    per_key = per_version.groupBy("key").agg(F.sum("occ").alias("occ"), F.max("pages").alias("most"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.sum("all").alias("all"))
    return per_key.agg(
        F.sum("occ").alias("chunks"), F.count("*").alias("contents"), F.round(F.count("*") / F.sum("occ"), 3).alias("content_ratio"), F.sum("all").alias("tokens_before"), F.sum(F.col("least").cast("long")).alias("tokens_after"),
        F.count_if(F.col("most") > 1).alias("on_several_pages"), F.count_if(F.col("occ") > F.col("pages")).alias("repeated_in_a_page"),
    )


@query("version_set_histogram", f"SELECT {_JOINED} AS versions, count(*) AS contents FROM ({_FIRST}) GROUP BY 1")
def version_set_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = dedupe.contents_of(chunks(spark, d, "version", "ord", "content_hash", "kind", "text", "n_tokens"), F.col("text"))
    return c.groupBy(F.array_join("versions", ",").alias("versions")).agg(F.count("*").alias("contents")).orderBy(F.desc("contents"), "versions")


@query(
    "metadata_differs",
    f"""SELECT key, count(*) AS versions, count(DISTINCT meta) AS variants FROM (SELECT sha256(coalesce(text, '')) AS key, version, string_agg(DISTINCT to_json(struct_pack(content_type := content_type, title := title)), ';' ORDER BY to_json(struct_pack(content_type := content_type, title := title))) AS meta
    FROM {CHUNKS} GROUP BY 1, 2) GROUP BY key HAVING count(DISTINCT meta) > 1""",
)
def metadata_differs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.metadata_differs(chunks(spark, d, "text", "version", "title", "content_type"), F.sha2(F.coalesce("text", F.lit("")), 256), ["title", "content_type"])


@query(
    "token_percentiles",
    f"""WITH n AS (SELECT version, list_sort(list(array_length(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')))) AS xs FROM {CHUNKS} WHERE text IS NOT NULL GROUP BY version)
    SELECT version, CAST(len(xs) AS BIGINT) AS chunks, CAST(xs[least(len(xs), CAST(floor(len(xs) * 0.5) AS INT) + 1)] AS BIGINT) AS p50, CAST(xs[least(len(xs), CAST(floor(len(xs) * 0.9) AS INT) + 1)] AS BIGINT) AS p90, CAST(xs[least(len(xs), CAST(floor(len(xs) * 0.99) AS INT) + 1)] AS BIGINT) AS p99, CAST(xs[len(xs)] AS BIGINT) AS most, round(list_avg(xs), 4) AS mean FROM n""",
)
def token_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The element at int(n * p), counted from 0, of the sorted word counts; by a histogram, as counts repeat while chunks grow."""
    n = chunks(spark, d, "version", "text").where("text is not null").groupBy("version", T.word_count(F.col("text")).cast("long").alias("w")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("version").orderBy("w")
    run = n.withColumn("upto", F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(Window.partitionBy("version")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * p), F.col("all") - 1), F.col("w")))
    return run.groupBy("version").agg(F.max("all").alias("chunks"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("w").alias("most"), F.round(F.sum(F.col("w") * F.col("c")) / F.max("all"), 4).alias("mean"))


@query(
    "chunk_stats",
    f"""SELECT version, kind, count(*) AS chunks, CAST(count(*) FILTER (n > 300) AS BIGINT) AS over_limit, CAST(count(*) FILTER (n < 64) AS BIGINT) AS under_least, count(DISTINCT content_hash) AS contents, CAST(count(*) FILTER (content_hash <> sha256(text)) AS BIGINT) AS wrong_hash, CAST(count(*) FILTER (n_tokens IS NULL OR n_tokens <= 0) AS BIGINT) AS no_count
    FROM (SELECT *, array_length(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM {CHUNKS}) GROUP BY version, kind""",
)
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "version", "kind", "text", "content_hash", "n_tokens").withColumn("n", T.word_count(F.col("text")))
    return c.groupBy("version", "kind").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("n") > 300).alias("over_limit"), F.count_if(F.col("n") < 64).alias("under_least"), F.countDistinct("content_hash").alias("contents"),
        F.count_if(F.col("content_hash") != F.sha2("text", 256)).alias("wrong_hash"), F.count_if(F.expr("n_tokens is null or n_tokens <= 0")).alias("no_count"),
    )


@query(
    "chunk_fixed_windows",
    """WITH w AS (SELECT id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM contents WHERE text IS NOT NULL), s AS (SELECT id, words, unnest(range(0, greatest(len(words) - 16, 1), 112)) AS first_word FROM w WHERE len(words) > 0)
    SELECT id, CAST(first_word / 112 AS INT) AS window_no, CAST(first_word AS INT) AS first_word, md5(array_to_string(words[first_word + 1 : first_word + 128], ' ')) AS digest FROM s""",
)
def chunk_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "contents"), "id", F.col("text"), 128, 16).select("id", "window_no", "first_word", F.md5("text").alias("digest"))


@query(
    "line_islands",
    """WITH l AS (SELECT t.id, CAST(u.o - 1 AS INT) AS n, u.line FROM contents t, unnest(string_split(t.text, chr(10))) WITH ORDINALITY u(line, o)),
    f AS (SELECT *, CAST(regexp_matches(line, '^[ \\t]*(```|~~~)') AS INT) AS is_fence FROM l), g AS (SELECT *, sum(is_fence) OVER (PARTITION BY id ORDER BY n) AS fences FROM f),
    s AS (SELECT *, CAST(fences % 2 = 1 OR is_fence = 1 AS INT) AS is_code FROM g), b AS (SELECT *, CAST(is_code = 0 AND trim(line) = '' AS INT) AS blank FROM s),
    p AS (SELECT *, CASE WHEN (is_fence = 1 AND fences % 2 = 1) OR coalesce(lag(CAST(is_fence = 1 AND fences % 2 = 0 AS INT)) OVER (PARTITION BY id ORDER BY n), 0) = 1 THEN 1 WHEN is_code = 0 AND coalesce(lag(blank) OVER (PARTITION BY id ORDER BY n), 1) = 1 THEN 1 ELSE 0 END AS starts FROM b),
    i AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY id ORDER BY n) AS BIGINT) AS island FROM p)
    SELECT id, island, max(is_code) AS is_code, count(*) AS lines, min(n) AS first_line FROM i WHERE blank = 0 GROUP BY id, island""",
)
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_islands(table(spark, d, "contents"), "id", F.col("text"))


@query(
    "pack_batches",
    """WITH RECURSIVE s AS (SELECT index_name, id, CAST(length(text) AS BIGINT) AS size, id // 1000 AS block, row_number() OVER (PARTITION BY index_name, id // 1000 ORDER BY id) AS n FROM contents WHERE text IS NOT NULL),
    t(index_name, block, n, id, size, bin, used, items) AS (SELECT index_name, block, n, id, size, CAST(0 AS BIGINT), size, CAST(1 AS BIGINT) FROM s WHERE n = 1 UNION ALL
    SELECT s.index_name, s.block, s.n, s.id, s.size, CASE WHEN t.items + 1 > 16 OR t.used + s.size > 12000 THEN t.bin + 1 ELSE t.bin END, CASE WHEN t.items + 1 > 16 OR t.used + s.size > 12000 THEN s.size ELSE t.used + s.size END, CASE WHEN t.items + 1 > 16 OR t.used + s.size > 12000 THEN 1 ELSE t.items + 1 END
    FROM t JOIN s ON s.index_name = t.index_name AND s.block = t.block AND s.n = t.n + 1) SELECT index_name, id, bin FROM t""",
)
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    """Bins within blocks of 1,000 ids of an index, so that the fold's work stays bounded however large an index is."""
    rows = table(spark, d, "contents").where("text is not null").select(F.concat_ws(":", "index_name", F.floor(F.col("id") / 1000)).alias("block"), "index_name", "id", F.length("text").cast("long").alias("size"))
    return chunking.packed(rows, "block", F.col("id"), F.col("size"), 16, 12_000).select("index_name", "id", "bin")


@query(
    "heading_anchor",
    f"""WITH s AS (SELECT section_id, record_id, ord, regexp_replace(regexp_replace(lower(regexp_replace(coalesce(title, ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {SECTIONS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id, slug ORDER BY ord) - 1 AS n FROM s) SELECT section_id, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor FROM r""",
)
def heading_anchor(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "sections"), "section_id", keep=("record_id", "ord", "title"))
    return chunking.anchors(s, "record_id", "ord", "title", T.anchor(F.coalesce("title", F.lit("")))).select("section_id", "anchor")


@query(
    "section_paths",
    f"""WITH s AS (SELECT section_id, record_id, ord, level, coalesce(title, '') AS title FROM {SECTIONS}),
    a AS (SELECT b.section_id, h.ord, h.title, h.level FROM s b JOIN s h ON h.record_id = b.record_id AND h.ord <= b.ord AND (h.level < b.level OR h.ord = b.ord)
    WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.record_id = b.record_id AND x.ord > h.ord AND x.ord <= b.ord AND x.level <= h.level))
    SELECT section_id, string_agg(title, ' > ' ORDER BY ord) AS path FROM a GROUP BY section_id""",
)
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    s = latest(table(spark, d, "sections"), "section_id", keep=("record_id", "ord", "level", "title")).withColumn("title", F.coalesce("title", F.lit("")))
    return chunking.heading_paths(s, "record_id", "ord", "level", "title").select("section_id", F.array_join("path", " > ").alias("path"))


@query("url_page_identity", "SELECT chunk_id, CASE WHEN regexp_replace(p, '\\?.*$', '') IN ('/docs/reference/toggle-register/') THEN l ELSE p END AS page, regexp_extract(url, '#(.*)$', 1) AS fragment FROM (SELECT chunk_id, url, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS l, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS p FROM " + CHUNKS + ")")
def url_page_identity(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "url").select("chunk_id", T.page_identity(F.col("url")).alias("page"), T.fragment(F.col("url")).alias("fragment"))


@query(
    "source_url_paths",
    f"SELECT chunk_id, '/' || regexp_extract(i, '^(.*/)?[^/]*$', 1) || CASE WHEN regexp_extract(i, '([^/]*)$', 1) IN ('_index', 'index') THEN '' ELSE regexp_extract(i, '([^/]*)$', 1) || '/' END AS path FROM (SELECT chunk_id, regexp_replace(regexp_replace(source_path, '^(?:.*/)?content/', ''), '\\.(?:md|html)$', '') AS i FROM {CHUNKS})",
)
def source_url_paths(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "source_path").select("chunk_id", T.url_path(F.col("source_path")).alias("path"))


@query(
    "page_titles",
    f"SELECT chunk_id, coalesce(nullif(trim(title), ''), nullif(trim(regexp_extract(text, '(?m)^#{{1,6}}[ \\t]+(.+?)[ \\t]*$', 1)), ''), nullif(trim(regexp_extract(source_path, '([^/]+?)(?:\\.[^./]*)?$', 1)), '')) AS title FROM {CHUNKS}",
)
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "title", "text", "source_path").select("chunk_id", T.page_title(F.col("title"), F.lit(None).cast("string"), F.col("text"), F.col("source_path")).alias("title"))


@query("chunks_per_page", f"SELECT version, regexp_replace(url, '#.*$', '') AS page, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters FROM {CHUNKS} GROUP BY 1, 2")
def chunks_per_page(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "version", "url", "text").groupBy("version", T.page_identity(F.col("url"), ()).alias("page")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


@query(
    "passage_search",
    f"SELECT c.chunk_id, CAST(u.o - 1 AS INT) AS line_no, u.line FROM {CHUNKS} c, unnest(string_split(c.text, chr(10))) WITH ORDINALITY u(line, o) WHERE regexp_matches(u.line, '(?i)drains? (?:a|the) ')",
)
def passage_search(spark: SparkSession, d: str) -> DataFrame:
    lines = chunks(spark, d, "text").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike("(?i)drains? (?:a|the) "))


@query(
    "tag_counts",
    "SELECT id, CAST(len(regexp_extract_all(text, '(?i)</?(?:a|b|br|code|div|em|h[1-6]|i|img|label|li|ol|p|pre|span|strong|sub|sup|table|tbody|td|th|thead|tr|ul)\\b[^>]*>')) AS BIGINT) AS tags FROM contents WHERE text IS NOT NULL AND contains(text, '<')",
)
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contents").where(F.contains("text", F.lit("<")))
    return c.select("id", T.tag_count(F.col("text")).cast("long").alias("tags"))


@query(
    "tidied_texts",
    """WITH l AS (SELECT t.id, u.o AS n, u.line FROM contents t, unnest(string_split(t.text, chr(10))) WITH ORDINALITY u(line, o) WHERE t.text IS NOT NULL), f AS (SELECT *, CAST(regexp_matches(line, '^[ \\t]*(```|~~~)') AS INT) AS fence FROM l),
    g AS (SELECT *, sum(fence) OVER (PARTITION BY id ORDER BY n) AS upto FROM f), s AS (SELECT *, CASE WHEN fence = 1 AND upto % 2 = 0 THEN upto - 1 ELSE upto END AS part, fence = 1 OR upto % 2 = 1 AS code FROM g),
    p AS (SELECT id, part, code, min(n) AS first, string_agg(line || chr(10), '' ORDER BY n) AS t FROM s GROUP BY id, part, code), c AS (SELECT id, string_agg(CASE WHEN code THEN t ELSE regexp_replace(t, '(?s)<!--.*?-->', '', 'g') END, '' ORDER BY first) AS text FROM p GROUP BY id)
    SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10)) AS digest FROM c""",
)
def tidied_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the comments of their prose and without needless space; the SQL goes line by line."""
    return table(spark, d, "contents").where("text is not null").select("id", F.md5(T.tidy(F.col("text"))).alias("digest"))


@query(
    "feature_gate_history",
    f"SELECT s.feature_gate AS gate, s.state AS state, min(s.since) AS since, count(DISTINCT c.version) AS versions, count(*) AS chunks FROM {CHUNKS} c, unnest(c.feature_states) AS u(s) GROUP BY 1, 2",
)
def feature_gate_history(spark: SparkSession, d: str) -> DataFrame:
    s = chunks(spark, d, "version", "feature_states").select("version", F.explode("feature_states").alias("s"))
    return s.groupBy(F.col("s.feature_gate").alias("gate"), F.col("s.state").alias("state")).agg(F.min("s.since").alias("since"), F.countDistinct("version").alias("versions"), F.count("*").alias("chunks"))


@query(
    "document_contexts",
    f"SELECT chunk_id, concat('URL: ', url, chr(10), 'Version: ', version, CASE WHEN len(feature_states) > 0 THEN chr(10) || 'Feature state: ' || array_to_string(list_transform(feature_states, lambda s: coalesce(s.feature_gate || ': ', '') || s.state || coalesce(' since ' || s.since, '')), '; ') ELSE '' END) AS context FROM {CHUNKS}",
)
def document_contexts(spark: SparkSession, d: str) -> DataFrame:
    states = F.when(F.size("feature_states") > 0, F.concat(F.lit("\nFeature state: "), T.state_label(F.col("feature_states")))).otherwise("")
    return chunks(spark, d, "url", "version", "feature_states").select("chunk_id", F.concat(F.lit("URL: "), "url", F.lit("\nVersion: "), "version", states).alias("context"))


@query(
    "glossary_lookup",
    """WITH g AS (SELECT row_id, version, id, title, trim(string_split(body, chr(10) || chr(10))[1]) AS short, unnest(list_concat([lower(id)], list_transform(coalesce(aka, []), lambda a: lower(a)))) AS name FROM glossary_terms WHERE id IS NOT NULL)
    SELECT version, name, min(row_id) AS row_id, count(*) AS terms FROM g WHERE short <> '' GROUP BY version, name""",
)
def glossary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Terms by lower-cased id or other name; the short text is the first paragraph, and a term without one isn't found."""
    g = table(spark, d, "glossary_terms").where("id is not null").withColumn("short", F.trim(F.split("body", "\n\n")[0])).where("short <> ''")
    names = g.select("row_id", "version", F.explode(F.concat(F.array(F.lower("id")), F.transform(F.coalesce("aka", F.array().cast("array<string>")), F.lower))).alias("name"))
    return names.groupBy("version", "name").agg(F.min("row_id").alias("row_id"), F.count("*").alias("terms"))


@query("file_inventory", f"SELECT version, split_part(source_path, '/', 2) AS class, count(DISTINCT source_path) AS files FROM {CHUNKS} GROUP BY 1, 2")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "version", "source_path").groupBy("version", F.split_part("source_path", F.lit("/"), F.lit(2)).alias("class")).agg(F.countDistinct("source_path").alias("files"))


@query("heading_chunks")
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the pages that were parsed and not chunked yet: a page's sections, put together in their order, through the heading chunker."""
    s = latest(table(spark, d, "sections"), "section_id", keep=("record_id", "ord", "level", "title", "blocks", "feature_states"))
    body = F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")
    head = F.when((F.col("level") > 0) & F.col("title").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level") + 1), F.lit(" "), "title", F.lit("\n\n"))).otherwise("")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(head, body).alias("t")))), lambda x: x["t"])  # a page's sections
    one_page = s.groupBy("record_id").agg(F.min_by("title", "ord").alias("title"), F.array_join(ordered, "\n\n").alias("text"))
    return pages.chunk_pages(one_page, "record_id", "title", "text", most=256, least=32)


@query("html_converted")
def html_converted(spark: SparkSession, d: str) -> DataFrame:
    return pages.convert_html(table(spark, d, "contents"), "id", "text")


@query("rendered_terms")
def rendered_terms(spark: SparkSession, d: str) -> DataFrame:
    """Glossary bodies as short and long definitions through the renderer: a term's text by its id."""
    g = table(spark, d, "glossary_terms").where("id is not null and trim(body) <> ''")
    site = shortcodes.Site("1.43", "1.44", labels={"note": "Note:"})
    calls = g.select("row_id", F.concat(F.lit("{{< note >}}"), "body", F.lit(" Since {{< skew currentVersion >}}.{{< /note >}}")).alias("t"))
    return pages.render_pages(calls, "row_id", "t", site).select("row_id", "text", F.size("warnings").alias("warnings"))


@query(
    "page_skip_reasons",
    f"SELECT CASE WHEN starts_with(source_path, 'content/docs/contribute/') OR starts_with(source_path, 'content/docs/setup/') THEN 'excluded' WHEN title IS NULL THEN 'headless' WHEN coalesce(n_tokens = 0, false) THEN 'draft' WHEN content_type IS NULL THEN 'not rendered' WHEN trim(coalesce(text, '')) = '' THEN 'empty' END AS skip, count(*) AS chunks FROM {CHUNKS} GROUP BY 1",
)
def page_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why pages are left out. The tables have no front matter: a page without a title stands for a headless one, without counted tokens for a draft, without a content type for one that isn't rendered."""
    rows = chunks(spark, d, "source_path", "title", "n_tokens", "content_type", "text").select(F.col("source_path").alias("path"), F.col("title").isNull().alias("headless"), (F.col("n_tokens") == 0).alias("draft"), F.col("content_type").isNotNull().alias("rendered"), "text")
    return pages.skip_reasons(rows, ("content/docs/contribute/", "content/docs/setup/")).groupBy("skip").agg(F.count("*").alias("chunks"))


_PAGE_SECTIONS = f"""S AS (SELECT record_id, ord, least(coalesce(level, 0), 5) + 1 AS lv, coalesce(nullif(trim(title), ''), 'Untitled') AS t, row_number() OVER (PARTITION BY record_id ORDER BY ord) AS n FROM {SECTIONS} WHERE record_id IS NOT NULL), T AS (SELECT record_id, t AS page FROM S WHERE n = 1),
    H AS (SELECT * FROM S WHERE NOT (n = 1 AND lv = 1)), G AS (SELECT *, regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM H), A AS (SELECT record_id, n, slug, row_number() OVER (PARTITION BY record_id, slug ORDER BY n) - 1 AS k FROM G),
    P AS (SELECT b.record_id, b.n, string_agg(h.t, ' > ' ORDER BY h.n) AS path FROM H b JOIN H h ON h.record_id = b.record_id AND h.n <= b.n AND (h.lv < b.lv OR h.n = b.n) WHERE NOT EXISTS (SELECT 1 FROM H x WHERE x.record_id = b.record_id AND x.n > h.n AND x.n <= b.n AND x.lv <= h.lv) GROUP BY 1, 2)"""


@query(
    "heading_chunk_paths",
    f"WITH {_PAGE_SECTIONS} SELECT S.record_id, CAST(S.n - 1 AS INT) AS ord, concat(T.page, coalesce(' > ' || P.path, '')) AS path, CASE WHEN A.slug IS NULL THEN '' WHEN A.k = 0 THEN A.slug ELSE A.slug || '-' || A.k END AS anchor FROM S JOIN T ON T.record_id = S.record_id LEFT JOIN P ON P.record_id = S.record_id AND P.n = S.n LEFT JOIN A ON A.record_id = S.record_id AND A.n = S.n",
)
def heading_chunk_paths(spark: SparkSession, d: str) -> DataFrame:
    """The heading chunker over pages of headings alone, without limits: a chunk a section, with its path and anchor, which SQL can tell from the sections."""
    s = latest(table(spark, d, "sections"), "section_id", keep=("record_id", "ord", "level", "title")).where("record_id is not null")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    line = F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(0)), F.lit(5)) + 1), F.lit(" "), title)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"])  # a page's sections
    one_page = s.groupBy("record_id").agg(F.min_by(title, "ord").alias("title"), F.array_join(ordered, "\n\n").alias("text"))
    return pages.chunk_pages(one_page, "record_id", "title", "text", most=1 << 30, least=0).select(F.col("id").alias("record_id"), "ord", F.array_join("heading_path", " > ").alias("path"), "anchor")


@query("html_tables", "SELECT row_id, concat('- `', id, '` (required): ', title, chr(10), '- ', 'See: [', title, '](', coalesce(full_link, '/'), ')') AS text FROM glossary_terms WHERE id IS NOT NULL AND title IS NOT NULL")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the glossary as an HTML table each, converted: what the table becomes is known from the columns."""
    g = table(spark, d, "glossary_terms").where("id is not null and title is not null")
    markup = F.concat(F.lit("<table class='x'><tbody>\n<tr><td><code>"), "id", F.lit("</code>&nbsp;<strong>*</strong></td>\n<td><p>"), "title", F.lit("</p></td></tr><tr><td>See<td><a href=\""), F.coalesce("full_link", F.lit("/")), F.lit("\"><span>"), "title", F.lit("</span></a></table>"))
    return pages.convert_html(g.select("row_id", markup.alias("t")), "row_id", "t").select("row_id", F.trim(F.regexp_replace("text", r"^\n|\n$", "")).alias("text"))


@query("rendered_calls", "SELECT row_id, concat('**Note:** ', title, ' since 1.43, not 1.42.', chr(10), chr(10), '# Also', chr(10), chr(10), '[', id, '](', coalesce(full_link, '/'), ') {{< kept >}}', chr(10)) AS text, CAST(1 AS INT) AS warnings FROM glossary_terms WHERE id IS NOT NULL AND title IS NOT NULL")
def rendered_calls(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the glossary as calls: paired and single ones, values in quotes, an escaped and an unknown one."""
    g = table(spark, d, "glossary_terms").where("id is not null and title is not null")
    site = shortcodes.Site("1.43", "1.44", labels={"note": "Note:", "also_heading": "Also"})
    text = F.concat(F.lit("{{< note >}}\n{{< glossary_tooltip text=\""), "title", F.lit("\" term_id=\"x\" >}} since {{< skew currentVersion >}}, not {{< skew currentVersionAddMinor -1 >}}.\n{{< /note >}}\n\n\n# {{% heading \"also\" %}}<!-- gone -->\n\n{{< link text=`"), "id", F.lit("` url=\""), F.coalesce("full_link", F.lit("/")), F.lit("\" >}} {{</* kept */>}}{{< unknown >}}"))
    return pages.render_pages(g.select("row_id", text.alias("t")), "row_id", "t", site).select("row_id", "text", F.size("warnings").alias("warnings"))
