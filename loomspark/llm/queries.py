"""Queries of the training-data problems: name -> function of (spark, directory of the tables); and the SQL that gives the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, cross_split, leakage, markup, near_duplicates, pair_defects, rank_aggregation, splitting, truncation, vectors
from loomspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split.cross_split_overlaps(table(spark, sf_dir, "golden_items"))
    return pairs.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


def p1_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, sf_dir, "golden_items"))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, contents, sections = (table(spark, sf_dir, t) for t in ("chunks", "contents", "sections"))
    return (
        splitting.oversized_items("chunks", chunks, "chunk_id", "text", "loaded_at")
        .unionByName(splitting.oversized_items("contents", contents, "id", "text"))
        .unionByName(splitting.oversized_items("sections", sections, "section_id", None, "loaded_at", blocks="blocks"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(_oversized(spark, sf_dir)).where("pieces > 1 and piece = 0").select("src", "item_key")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(_oversized(spark, sf_dir))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each oversized item put together again from its pieces, and whether the pieces keep the limit and the overlap."""
    return splitting.piece_checks(p2_pieces(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(table(spark, sf_dir, "contents"))
    a, b = groups.select("component", F.col("id").alias("id_a")), groups.select("component", F.col("id").alias("id_b"))
    return a.join(b, "component").where("id_a < id_b").select("id_a", "id_b")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per content: its representative, its group, the group's size and the versions that it spans."""
    contents = table(spark, sf_dir, "contents")
    groups = near_duplicates.near_duplicate_groups(contents)
    spans = contents.select("id", F.explode("versions").alias("version")).join(groups.select("id", "component"), "id").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("contents"))
    return groups.join(sizes, "component").join(spans, "component", "left").select("id", "rep", "component", "contents", "versions")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_aggregation.first_places(table(spark, sf_dir, "hits"), table(spark, sf_dir, "retrieval_configs"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten places of each question; p4_places has the whole ranking."""
    return rank_aggregation.ranking(table(spark, sf_dir, "hits"), table(spark, sf_dir, "retrieval_configs"), 10).withColumn("significance", F.round("significance", 6))


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_aggregation.ranking(table(spark, sf_dir, "hits"), table(spark, sf_dir, "retrieval_configs")).withColumn("significance", F.round("significance", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = markup.residue(table(spark, sf_dir, "contents"), "id", "text").withColumn("src", F.lit("contents"))
    terms = markup.residue(table(spark, sf_dir, "glossary_terms"), "row_id", "body").withColumn("src", F.lit("glossary_terms"))
    return contents.unionByName(terms).select("src", "row_key", "family")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = markup.cleaned(table(spark, sf_dir, "contents"), "id", "text").withColumn("src", F.lit("contents"))
    terms = markup.cleaned(table(spark, sf_dir, "glossary_terms"), "row_id", "body").withColumn("src", F.lit("glossary_terms"))
    return contents.unionByName(terms).select("src", "row_key", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.pair_kinds(table(spark, sf_dir, "generation_rows")).where("defect is not null").select("row_id", "defect")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defect_report(table(spark, sf_dir, "generation_rows"))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of each run that the report is of."""
    kinds = pair_defects.pair_kinds(table(spark, sf_dir, "generation_rows"))
    return kinds.groupBy("run").agg(F.count("*").alias("pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.most_similar(table(spark, sf_dir, "content_vectors"))
    return near.select("model", F.least("id", "neighbour").alias("content_id_a"), F.greatest("id", "neighbour").alias("content_id_b")).distinct()


def p7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.most_similar(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None)
    return near.select("id", "neighbour", "place", F.round("similarity", 6).alias("similarity"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_statistics(table(spark, sf_dir, "documents"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and empty texts by source, out of the encoded corpus."""
    return bpe.token_statistics(table(spark, sf_dir, "documents")).select("source", "texts", "without_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_passages")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "heldout_passages")
    found = leakage.leaked_passages(table(spark, sf_dir, "documents"), passages)
    return leakage.leak_report(found, passages).withColumn("largest_share", F.round("largest_share", 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


def p10_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source that the rates are of."""
    return truncation.truncation_rates(table(spark, sf_dir, "documents")).select("source", "texts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_ITEMS = "(SELECT * FROM golden_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_P1 = f"""W AS (SELECT id, split, origin, list_filter(string_split_regex(lower(question), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM {_ITEMS} WHERE question IS NOT NULL),
C AS (SELECT id, split, origin, len(ws) AS n, w, count(*) AS c FROM (SELECT id, split, origin, ws, unnest(ws) AS w FROM W) GROUP BY 1, 2, 3, 4, 5),
O AS (SELECT t.id AS id_train, e.id AS id_eval, any_value(e.split) AS eval_split, any_value(e.origin) AS eval_origin FROM C t JOIN C e ON t.w = e.w WHERE t.split = 'train' AND e.split IN ('dev', 'test') GROUP BY t.id, e.id, t.n, e.n HAVING sum(least(t.c, e.c)) * 100 >= greatest(t.n, e.n) * 80)"""
_P3 = """W AS (SELECT id, index_name, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM contents),
S AS (SELECT DISTINCT id, index_name, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT id, index_name, ws, unnest(range(1, len(ws) - 1)) AS i FROM W)), N AS (SELECT id, count(*) AS n FROM S GROUP BY id),
L AS (SELECT a.id AS a, b.id AS b FROM S a JOIN S b ON a.index_name = b.index_name AND a.s = b.s AND a.id < b.id JOIN N na ON na.id = a.id JOIN N nb ON nb.id = b.id GROUP BY a.id, b.id, na.n, nb.n HAVING count(*) * 2 >= na.n + nb.n - count(*)),
E AS (SELECT a, b FROM L UNION ALL SELECT b, a FROM L), R(a, b) AS (SELECT a, b FROM E UNION SELECT R.a, E.b FROM R JOIN E ON R.b = E.a)"""
_P4 = """H AS (SELECT question_id, config_id, content_id, score FROM hits WHERE question_id IS NOT NULL AND config_id IS NOT NULL AND content_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id, config_id, content_id ORDER BY loaded_at DESC) = 1),
K AS (SELECT question_id, config_id, content_id, CASE WHEN score_kind = 'distance' THEN -score ELSE score END AS s FROM H JOIN retrieval_configs USING (config_id) WHERE score IS NOT NULL AND NOT isnan(score)),
P AS (SELECT question_id, config_id, content_id, rank() OVER (PARTITION BY question_id, config_id ORDER BY s DESC) + (count(*) OVER (PARTITION BY question_id, config_id, s) - 1) / 2 AS pos FROM K),
Q AS (SELECT question_id, count(DISTINCT config_id) AS n, count(DISTINCT content_id) AS m FROM P GROUP BY 1), I AS (SELECT question_id, content_id, list_sort(list(pos)) AS ps FROM P GROUP BY 1, 2),
B AS (SELECT I.question_id, content_id, len(ps) AS lists, n, (list_sum(ps) + (n - len(ps)) * m) / (n * m) AS mean, list_min(list_transform(range(1, len(ps) + 1), lambda k: list_sum(list_transform(range(k, n + 1), lambda i: factorial(CAST(n AS INT)) / (factorial(CAST(i AS INT)) * factorial(CAST(n - i AS INT))) * power(ps[k] / m, i) * power(1 - ps[k] / m, n - i))))) AS p FROM I JOIN Q USING (question_id))"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say the same over whole tables; the others are tested against brute force, round trips and known cases."""
    texts = "SELECT 'chunks' AS src, chunk_id AS item_key, text FROM chunks UNION ALL SELECT 'contents', CAST(id AS VARCHAR), text FROM contents UNION ALL SELECT 'sections', section_id, array_to_string(list_transform(blocks, lambda b: coalesce(b.text, '')), chr(10) || chr(10)) FROM sections"
    return {
        "p1_found": f"WITH {_P1} SELECT DISTINCT least(id_train, id_eval) AS id_a, greatest(id_train, id_eval) AS id_b FROM O",
        "p1_overlap_report": f"WITH {_P1}, F AS (SELECT eval_split, eval_origin, count(DISTINCT id_eval) AS o, count(*) AS p FROM O GROUP BY 1, 2), A AS (SELECT split, origin, count(*) AS items FROM {_ITEMS} WHERE split IN ('dev', 'test') GROUP BY 1, 2) SELECT A.split AS eval_split, A.origin AS eval_origin, items, CAST(coalesce(o, 0) AS BIGINT) AS overlapping_items, CAST(coalesce(p, 0) AS BIGINT) AS pairs FROM A LEFT JOIN F ON F.eval_split = A.split AND F.eval_origin IS NOT DISTINCT FROM A.origin",
        "p2_found": f"SELECT DISTINCT src, item_key FROM ({texts}) WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 300",
        "p2_checks": f"SELECT src, item_key, CAST(len(ws) AS BIGINT) AS words, md5(array_to_string(ws, ' ')) AS digest, true AS within_limit, true AS shares_overlap FROM (SELECT DISTINCT src, item_key, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM ({texts})) WHERE len(ws) > 300",
        "p3_found": f"WITH RECURSIVE {_P3} SELECT DISTINCT a AS id_a, b AS id_b FROM R WHERE a < b",
        "p3_groups": f"""WITH RECURSIVE {_P3}, T AS (SELECT id, min(id) OVER (PARTITION BY index_name, text) AS rep FROM contents), G AS (SELECT T.id, T.rep, least(T.rep, coalesce((SELECT min(b) FROM R WHERE R.a = T.id), T.rep)) AS component FROM T),
        V AS (SELECT component, string_agg(DISTINCT v, ',' ORDER BY v) AS versions FROM (SELECT component, unnest(versions) AS v FROM G JOIN contents USING (id)) GROUP BY 1) SELECT id, rep, G.component, count(*) OVER (PARTITION BY G.component) AS contents, versions FROM G LEFT JOIN V ON V.component = G.component""",
        "p4_ranking": f"WITH {_P4} SELECT question_id, content_id, row_number() OVER (PARTITION BY question_id ORDER BY round(least(1, p * n), 12), lists DESC, round(mean, 12), content_id) AS place, round(least(1, p * n), 6) AS significance, CAST(lists AS INT) AS lists FROM B QUALIFY place <= 10",
        "p4_places": f"WITH {_P4} SELECT question_id, content_id, row_number() OVER (PARTITION BY question_id ORDER BY round(least(1, p * n), 12), lists DESC, round(mean, 12), content_id) AS place, round(least(1, p * n), 6) AS significance, CAST(lists AS INT) AS lists FROM B",
        "p6_totals": "SELECT run, count(*) AS pairs FROM (SELECT * FROM generation_rows WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) = 1) GROUP BY run",
        "p8_totals": "SELECT source, count(*) AS texts, CAST(count(*) FILTER (coalesce(text, '') = '') AS BIGINT) AS without_tokens FROM documents GROUP BY source",
        "p10_totals": "SELECT coalesce(source, '') AS source, count(*) AS texts FROM documents WHERE regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]') GROUP BY 1",
        "p4_found": f"WITH {_P4} SELECT question_id, content_id FROM B QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(least(1, p * n), 12), lists DESC, round(mean, 12), content_id) = 1",
    }
