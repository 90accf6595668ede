"""Queries of evaluation: answers, citations, resampling, agreement, sampling, validation of the golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import requests as R
from loomspark.functions import text as T
from loomspark.operators import metrics, validation
from loomspark.operators.rows import latest
from loomspark.plans.catalog import ANSWERS, CHUNKS, ITEMS, query
from loomspark.plans.search import _FACTS, _NORM, _PAGE_KEYED
from loomspark.session import table

SEED, SAMPLES, DISPLAY_SAMPLES = 7, 10_000, 2_000


def answers(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "id", "category", "answerable", "found", "stop_reason", "sources", "retrieved", "citation_hit", "citation_precision", "usage", "usd"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "golden_items"), "id", keep=("split", "question", "version", "category", "answerable", "reference_answer", "evidence", "notes"))


_RATE = "round(avg(CASE WHEN {0} THEN CAST(NOT coalesce(found, false) AS INT) END), 4)"


@query("refusal_rates", f"SELECT run, count(*) AS answers, {_RATE.format('answerable')} AS false_refusals, {_RATE.format('NOT answerable AND category = ' + chr(39) + 'unanswerable' + chr(39))} AS declined_unanswerable, {_RATE.format('category = ' + chr(39) + 'false_premise' + chr(39))} AS declined_false_premise FROM {ANSWERS} GROUP BY run")
def refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of answers not found, over three populations; a null flag counts as not found."""
    refused = (~F.coalesce("found", F.lit(False))).cast("int")
    rate = lambda c, name: F.round(F.avg(F.when(F.expr(c), refused)), 4).alias(name)
    return answers(spark, d).groupBy("run").agg(F.count("*").alias("answers"), rate("answerable", "false_refusals"), rate("not answerable and category = 'unanswerable'", "declined_unanswerable"), rate("category = 'false_premise'", "declined_false_premise"))


@query(
    "generation_summary",
    f"""SELECT run, coalesce(category, 'all') AS category, count(*) AS answers, round(avg(CASE WHEN answerable THEN CAST(citation_hit AS INT) END), 4) AS citation_hit_answerable, round(avg(CAST(citation_hit AS INT)), 4) AS citation_hit_flagged, round(CAST(sum(CASE WHEN isnan(citation_precision) THEN NULL ELSE CAST(citation_precision AS DECIMAL(18,6)) END) AS DOUBLE) / nullif(count(CASE WHEN isnan(citation_precision) THEN NULL ELSE citation_precision END), 0), 4) AS citation_precision,
    CAST(sum(usage.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(usage.output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CAST(usd AS DECIMAL(18,6))) AS DOUBLE) AS usd FROM {ANSWERS} GROUP BY GROUPING SETS ((run, category), (run))""",
)
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    """By run and category and over each run; the hit rate over answerable items and over all items with a flag, which differ."""
    a = answers(spark, d)
    hit = F.col("citation_hit").cast("int")
    out = a.rollup("run", "category").agg(
        F.count("*").alias("answers"), F.round(F.avg(F.when(F.col("answerable"), hit)), 4).alias("citation_hit_answerable"), F.round(F.avg(hit), 4).alias("citation_hit_flagged"), F.round(F.expr("sum(cast(nullif(citation_precision, double('NaN')) as decimal(18,6)))").cast("double") / F.expr("nullif(count(nullif(citation_precision, double('NaN'))), 0)"), 4).alias("citation_precision"),
        F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"), F.sum(F.col("usd").cast("decimal(18,6)")).cast("double").alias("usd"),
    )
    return out.where("run is not null").withColumn("category", F.coalesce("category", F.lit("all")))


@query("stop_reason_histogram", f"SELECT run, coalesce(stop_reason, 'unknown') AS stop_reason, count(*) AS answers FROM {ANSWERS} GROUP BY 1, 2")
def stop_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).groupBy("run", F.coalesce("stop_reason", F.lit("unknown")).alias("stop_reason")).agg(F.count("*").alias("answers"))


@query(
    "citation_numbering",
    f"""WITH s AS (SELECT a.row_id, CAST(u.o - 1 AS INT) AS pos, u.s.url AS url FROM {ANSWERS} a, unnest(a.sources) WITH ORDINALITY u(s, o)), f AS (SELECT row_id, url, min(pos) AS first FROM s GROUP BY 1, 2),
    n AS (SELECT row_id, url, row_number() OVER (PARTITION BY row_id ORDER BY first) AS number FROM f) SELECT s.row_id, s.pos, s.url, n.number FROM s JOIN n ON n.row_id = s.row_id AND n.url IS NOT DISTINCT FROM s.url""",
)
def citation_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Different URLs of an answer numbered in the order of first use. Within each row's array, so nothing is shuffled."""
    a = answers(spark, d).where(F.size("sources") > 0).withColumn("urls", F.array_distinct(F.transform("sources", lambda s: s["url"])))
    return a.select("row_id", "urls", F.posexplode("sources").alias("pos", "s")).select("row_id", "pos", F.col("s.url").alias("url"), F.array_position("urls", F.col("s.url")).alias("number"))


_CITED = f"""S AS (SELECT a.row_id, a.run, a.id, u.o AS pos, {_PAGE_KEYED.format('u.s.url')} AS page, c.text FROM {ANSWERS} a, unnest(a.sources) WITH ORDINALITY u(s, o) LEFT JOIN {CHUNKS} c ON c.chunk_id = u.s.chunk_id), F AS {_FACTS},
H AS (SELECT DISTINCT S.row_id, S.pos FROM S JOIN F ON F.id = S.id AND F.page = S.page AND length({_NORM.format('F.quote')}) > 0 AND contains({_NORM.format('S.text')}, {_NORM.format('F.quote')}))"""


@query(
    "citation_hit_precision",
    f"""WITH {_CITED}, P AS (SELECT row_id, count(*) AS sources FROM S GROUP BY 1), N AS (SELECT row_id, count(*) AS covering FROM H GROUP BY 1)
    SELECT a.row_id, CASE WHEN len(i.evidence) > 0 THEN coalesce(N.covering, 0) > 0 END AS hit, CASE WHEN len(i.evidence) > 0 AND P.sources > 0 THEN round(coalesce(N.covering, 0) / P.sources, 6) END AS precision
    FROM {ANSWERS} a LEFT JOIN {ITEMS} i ON i.id = a.id LEFT JOIN P ON P.row_id = a.row_id LEFT JOIN N ON N.row_id = a.row_id""",
)
def citation_hit_precision(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cited source covers a fact of the item, and the share of sources that do; null where an item has no evidence, and the precision also without sources."""
    a = answers(spark, d).select("row_id", "id", "sources")
    golden = items(spark, d)
    text = latest(table(spark, d, "chunks"), "chunk_id", keep=("text",))
    cited = a.select("row_id", "id", F.posexplode("sources").alias("pos", "s")).select("row_id", "id", "pos", T.page_identity(F.col("s.url")).alias("page"), F.col("s.chunk_id").alias("chunk_id")).join(text, "chunk_id", "left")
    facts = metrics.facts_of(golden)
    covering = cited.join(facts, ["id", "page"]).where(T.contains_quote(F.col("text"), F.col("quote"))).select("row_id", "pos").distinct().groupBy("row_id").agg(F.count("*").alias("covering"))
    has = golden.select("id", (F.size("evidence") > 0).alias("has_evidence"))
    rows = a.join(has, "id", "left").join(covering, "row_id", "left").withColumn("covering", F.coalesce("covering", F.lit(0)))
    return rows.select("row_id", F.when(F.col("has_evidence"), F.col("covering") > 0).alias("hit"), F.when(F.col("has_evidence") & (F.size("sources") > 0), F.round(F.col("covering") / F.size("sources"), 6)).alias("precision"))


def _bootstrap_sql(values: str, group: str, samples: int = SAMPLES) -> str:
    bits, draws = metrics.BITS, metrics.DRAWS
    weight = " ".join(f"WHEN d < {limit!r} THEN {k}" for k, limit in metrics.poisson_limits())
    return f"""V AS ({values}), Z AS (SELECT {group}, q, x, CAST(('0x' || substr(h, 1, {bits})) AS BIGINT) AS a, CAST(('0x' || substr(h, {bits + 1}, {bits})) AS BIGINT) AS b FROM (SELECT {group}, q, x, md5(concat_ws(':', '{SEED}', q, unit)) AS h FROM V, range({-(-samples // draws)}) r(q))),
    D AS (SELECT {group}, {draws} * q + p AS s, x, CASE {weight} ELSE 7 END AS w FROM (SELECT {group}, q, p, x, (CASE WHEN p < {draws // 2} THEN a ELSE b END >> CAST({bits} * (p % {draws // 2}) AS INT)) & {(1 << bits) - 1} AS d FROM Z, range({draws}) t(p)) WHERE {draws} * q + p < {samples}), B AS (SELECT {group}, s, sum(w * x) / sum(w) AS m FROM D GROUP BY 1, 2 HAVING sum(w) > 0), L AS (SELECT {group}, list_sort(list(m)) AS ms FROM B GROUP BY 1),
    O AS (SELECT {group}, count(*) AS n, round(avg(x) + 1e-9, 4) AS mean FROM V GROUP BY 1) SELECT O.{group}, n, mean, round(ms[greatest(CAST(floor(len(ms) * 0.025) AS INT) + 1, 1)] + 1e-9, 4) AS low, round(ms[greatest(CAST(floor(len(ms) * 0.975) AS INT), 1)] + 1e-9, 4) AS high, round(len(list_filter(ms, lambda m: m <= 0)) / len(ms), 4) AS share_not_above_0 FROM O JOIN L ON L.{group} = O.{group}"""


@query("bootstrap_ci", "WITH " + _bootstrap_sql(f"SELECT run, row_id AS unit, citation_precision AS x FROM {ANSWERS} WHERE citation_precision IS NOT NULL AND NOT isnan(citation_precision)", "run"))
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).select("run", F.col("row_id").alias("unit"), F.expr("nullif(citation_precision, double('NaN'))").alias("x"))
    return metrics.bootstrap(a, "run", "unit", "x", SAMPLES, SEED)


_PER_ID = f"(SELECT run, id, avg(CASE WHEN isnan(citation_precision) THEN NULL ELSE citation_precision END) AS v FROM {ANSWERS} GROUP BY 1, 2)"


@query("paired_diff", "WITH " + _bootstrap_sql(f"SELECT a.run, a.id AS unit, a.v - b.v AS x FROM {_PER_ID} a JOIN {_PER_ID} b ON a.id = b.id AND b.run = 'baseline' AND a.run <> 'baseline' WHERE a.v - b.v IS NOT NULL", "run"))
def paired_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each run against the baseline on the items both have."""
    per = answers(spark, d).groupBy("run", "id").agg(F.avg(F.expr("nullif(citation_precision, double('NaN'))")).alias("v"))
    base = per.where("run = 'baseline'").select("id", F.col("v").alias("b"))
    diffs = per.where("run <> 'baseline'").join(base, "id").select("run", F.col("id").alias("unit"), (F.col("v") - F.col("b")).alias("x"))
    return metrics.bootstrap(diffs, "run", "unit", "x", SAMPLES, SEED)


_GRADE = "CASE WHEN v >= 0.8 THEN 2 WHEN v >= 0.4 THEN 1 ELSE 0 END"
_PAIRS = f"(SELECT a.id, {_GRADE.replace('v', 'a.v')} AS a, {_GRADE.replace('v', 'b.v')} AS b FROM {_PER_ID} a JOIN {_PER_ID} b ON a.id = b.id AND a.run = 'baseline' AND b.run = 'default' WHERE a.v IS NOT NULL AND b.v IS NOT NULL)"


def rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Grades 0 to 2 of two runs on the items both have, as two raters."""
    per = answers(spark, d).groupBy("run", "id").agg(F.avg(F.expr("nullif(citation_precision, double('NaN'))")).alias("v")).where("v is not null")
    grade = F.when(F.col("v") >= 0.8, 2).when(F.col("v") >= 0.4, 1).otherwise(0)
    one = lambda run, name: per.where(F.col("run") == run).select("id", grade.alias(name))
    return one("baseline", "a").join(one("default", "b"), "id")


@query("confusion_matrix", f"SELECT a, b, count(*) AS n FROM {_PAIRS} GROUP BY a, b")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(rater_pairs(spark, d), "a", "b")


@query(
    "cohen_kappa",
    f"""WITH p AS (SELECT a, b FROM {_PAIRS}), n AS (SELECT count(*) AS n FROM p), ma AS (SELECT a, count(*) AS c FROM p GROUP BY a), mb AS (SELECT b, count(*) AS c FROM p GROUP BY b),
    o AS (SELECT count(*) FILTER (a <> b) AS d, sum(power(a - b, 2)) AS w FROM p), e AS (SELECT sum(CASE WHEN a <> b THEN ma.c * mb.c ELSE 0 END) / max(n) AS d, sum(ma.c * mb.c * power(a - b, 2)) / max(n) AS w FROM ma, mb, n)
    SELECT n, round(1 - o.d / n, 6) AS agreement, round(CASE WHEN e.d = 0 THEN 1 ELSE 1 - o.d / e.d END, 6) AS kappa, round(CASE WHEN e.w = 0 THEN 1 ELSE 1 - o.w / e.w END, 6) AS weighted_kappa FROM n, o, e WHERE n.n > 0""",
)
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kappa(rater_pairs(spark, d), "a", "b", 3)


@query("agreement", f"SELECT id, a, b FROM {_PAIRS} WHERE abs(a - b) >= 1")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """The disagreements, for a second look."""
    return rater_pairs(spark, d).where("abs(a - b) >= 1")


@query(
    "stratified_sample",
    f"""WITH i AS (SELECT id, category FROM {ITEMS}), q AS (SELECT category, greatest(1, least(100, CAST(round_even(count(*) * 100 / (SELECT count(*) FROM i), 0) AS INT))) AS quota FROM i GROUP BY category)
    SELECT i.id, i.category FROM i JOIN q ON q.category = i.category QUALIFY row_number() OVER (PARTITION BY i.category ORDER BY md5('7:' || i.id), i.id) <= max(q.quota) OVER (PARTITION BY i.category)""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stratified(items(spark, d), "id", "category", 100, SEED)


@query("quota_sample", f"SELECT id, category FROM {ITEMS} QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('7:' || id), id) <= CASE category WHEN 'fact' THEN 20 WHEN 'howto' THEN 15 ELSE 5 END")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("category").orderBy(F.md5(F.concat(F.lit("7:"), "id")), "id")
    quota = F.when(F.col("category") == "fact", 20).when(F.col("category") == "howto", 15).otherwise(5)
    return items(spark, d).select("id", "category").withColumn("r", F.row_number().over(order)).where(F.col("r") <= 20).where(F.col("r") <= quota).select("id", "category")


QUOTAS = {"fact": 40, "howto": 30, "version": 25, "multihop": 20, "unanswerable": 20, "false_premise": 10}


@query("split_quotas", f"SELECT CAST(sum(q) AS BIGINT) AS dev, CAST(sum(n) AS BIGINT) AS items, CAST(0 AS BIGINT) AS torn_pairs FROM (SELECT count(*) AS n, least(count(*), CASE category WHEN 'fact' THEN 40 WHEN 'howto' THEN 30 WHEN 'version' THEN 25 WHEN 'multihop' THEN 20 WHEN 'unanswerable' THEN 20 WHEN 'false_premise' THEN 10 ELSE 0 END) AS q FROM {ITEMS} GROUP BY category)")
def split_quotas(spark: SparkSession, d: str) -> DataFrame:
    """What the assignment comes to: dev holds exactly its quotas (a pair counts for the category of its first item), and no pair is torn apart."""
    assigned = validation.assign_splits(items(spark, d), QUOTAS, SEED)
    tags = items(spark, d).select("id", F.regexp_extract(F.coalesce("notes", F.lit("")), r"pair:([\w.-]+)", 1).alias("tag"))
    torn = assigned.join(tags.where("tag <> ''"), "id").groupBy("tag").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn_pairs"))
    return assigned.agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count("*").alias("items")).crossJoin(torn)  # one row each


@query("split_assignment")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Items of each category go to dev up to a quota and else to test; items that share a pair tag stay together."""
    return validation.assign_splits(items(spark, d), QUOTAS, SEED)


_TARGETS = "(VALUES ('fact', 0.30), ('howto', 0.22), ('version', 0.18), ('multihop', 0.12), ('unanswerable', 0.12), ('false_premise', 0.06)) t(category, target)"


@query("category_mix", f"WITH c AS (SELECT split, category, count(*) AS n FROM {ITEMS} GROUP BY 1, 2), s AS (SELECT split, sum(n) AS total FROM c GROUP BY 1) SELECT s.split, t.category, CAST(coalesce(c.n, 0) AS BIGINT) AS items, round(coalesce(c.n, 0) / s.total, 4) AS share, round(t.target, 4)::DOUBLE AS target FROM s CROSS JOIN {_TARGETS} LEFT JOIN c ON c.split = s.split AND c.category = t.category")
def category_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = {"fact": 0.30, "howto": 0.22, "version": 0.18, "multihop": 0.12, "unanswerable": 0.12, "false_premise": 0.06}
    c = items(spark, d).groupBy("split", "category").agg(F.count("*").alias("n"))
    totals = c.groupBy("split").agg(F.sum("n").alias("total"))
    wanted = totals.select("split", "total", F.explode(F.create_map(*[F.lit(x) for p in targets.items() for x in p])).alias("category", "target"))
    return wanted.join(c, ["split", "category"], "left").select("split", "category", F.coalesce("n", F.lit(0)).alias("items"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 4).alias("share"), "target")


@query("leakage_check", f"SELECT {_NORM.format('lower(question)')} AS question, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS items FROM {ITEMS} WHERE question IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    q = items(spark, d).where("question is not null").groupBy(T.normalised(F.lower("question")).alias("question")).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("items"))
    return q.where(F.contains("splits", F.lit(",")))


@query("duplicate_questions", f"SELECT md5({_NORM.format('lower(question)')}) AS question, count(*) AS items, min(id) AS first_id FROM {ITEMS} WHERE question IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_questions(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where("question is not null").groupBy(F.md5(T.normalised(F.lower("question"))).alias("question")).agg(F.count("*").alias("items"), F.min("id").alias("first_id")).where("items > 1")


@query(
    "schema_rules",
    f"""SELECT id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(id, '^(train|dev|test)-\\d{{8}}$') THEN 'id' END, CASE WHEN split_part(id, '-', 1) <> split THEN 'split' END, CASE WHEN version IS NULL OR NOT regexp_matches(version, '^\\d+\\.\\d+$') THEN 'version' END, CASE WHEN length(trim(question)) < 10 THEN 'question' END,
    CASE WHEN answerable AND len(evidence) = 0 THEN 'answerable without evidence' END, CASE WHEN NOT answerable AND category = 'fact' THEN 'fact not answerable' END, CASE WHEN answerable AND trim(reference_answer) = '' THEN 'no reference answer' END], lambda e: e IS NOT NULL), '; ') AS errors FROM {ITEMS}
    WHERE NOT regexp_matches(id, '^(train|dev|test)-\\d{{8}}$') OR split_part(id, '-', 1) <> split OR version IS NULL OR NOT regexp_matches(version, '^\\d+\\.\\d+$') OR length(trim(question)) < 10 OR (answerable AND len(evidence) = 0) OR (NOT answerable AND category = 'fact') OR (answerable AND trim(reference_answer) = '')""",
)
def schema_rules(spark: SparkSession, d: str) -> DataFrame:
    return validation.broken_rules(
        items(spark, d), "id",
        {
            "id": "not id rlike '^(train|dev|test)-\\\\d{8}$'", "split": "split_part(id, '-', 1) <> split", "version": "version is null or not version rlike '^\\\\d+\\\\.\\\\d+$'", "question": "length(trim(question)) < 10",
            "answerable without evidence": "answerable and size(evidence) = 0", "fact not answerable": "not answerable and category = 'fact'", "no reference answer": "answerable and trim(reference_answer) = ''",
        },
    )


_EVIDENCE = f"""F AS (SELECT DISTINCT id, fact, {_PAGE_KEYED.format('w.url')} AS page, {_NORM.format('w.quote')} AS quote, regexp_extract(w.url, '#(.*)$', 1) AS section FROM (SELECT i.id, CAST(u.o - 1 AS INT) AS fact, unnest(list_concat([struct_pack(url := u.e.url, quote := u.e.quote)], coalesce(u.e.alternatives, []))) AS w FROM {ITEMS} i, unnest(i.evidence) WITH ORDINALITY u(e, o))),
    C AS (SELECT {_PAGE_KEYED.format('url')} AS page, anchor, {_NORM.format('text')} AS text, record_id, ord, chunk_id FROM {CHUNKS})"""


@query(
    "evidence_check",
    f"""WITH {_EVIDENCE}, P AS (SELECT DISTINCT page FROM C), A AS (SELECT DISTINCT page, anchor FROM C),
    H AS (SELECT F.page, F.quote, F.section, bool_or(true) AS held, bool_or(C.anchor = F.section) AS here FROM (SELECT DISTINCT page, quote, section FROM F) F JOIN C ON C.page = F.page AND length(F.quote) > 0 AND contains(C.text, F.quote) GROUP BY 1, 2, 3)
    SELECT F.id, F.fact, F.page, CASE WHEN P.page IS NULL THEN 'page missing' WHEN H.held IS NULL THEN 'quote missing' WHEN F.section <> '' AND A.page IS NULL THEN 'section missing' WHEN F.section <> '' AND NOT coalesce(H.here, false) THEN 'quote not in section' ELSE 'ok' END AS result, count(*) AS ways
    FROM F LEFT JOIN P ON P.page = F.page LEFT JOIN A ON A.page = F.page AND A.anchor = F.section LEFT JOIN H ON H.page = F.page AND H.quote = F.quote AND H.section = F.section GROUP BY 1, 2, 3, 4""",
)
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each way to state a fact breaks: its page must exist, a chunk of the page must hold its quote, and where the URL names a section, the section must exist and hold it."""
    return validation.check_evidence(_ways(spark, d), _passages(spark, d))


def _ways(spark: SparkSession, d: str) -> DataFrame:
    return metrics.facts_of(items(spark, d), section=True).select("id", "fact", "page", T.normalised(F.col("quote")).alias("quote"), "section").distinct()


def _passages(spark: SparkSession, d: str) -> DataFrame:
    c = latest(table(spark, d, "chunks"), "chunk_id", keep=("url", "anchor", "text", "record_id", "ord"))
    return c.select(T.page_identity(F.col("url")).alias("page"), "anchor", T.normalised(F.col("text")).alias("text"), "record_id", "ord", "chunk_id")


@query(
    "straddling_quotes",
    f"""WITH {_EVIDENCE}, N AS (SELECT page, text, lead(text) OVER (PARTITION BY record_id ORDER BY ord, chunk_id) AS after FROM C), Q AS (SELECT DISTINCT page, quote FROM F WHERE quote <> ''), H AS (SELECT DISTINCT Q.page, Q.quote FROM Q JOIN C ON C.page = Q.page AND contains(C.text, Q.quote)), S AS (SELECT DISTINCT Q.page, Q.quote FROM Q JOIN N ON N.page = Q.page AND contains(N.text || ' ' || N.after, Q.quote))
    SELECT F.id, F.fact, F.page, F.quote FROM F JOIN S ON S.page = F.page AND S.quote = F.quote WHERE NOT EXISTS (SELECT 1 FROM H WHERE H.page = F.page AND H.quote = F.quote)""",
)
def straddling_quotes(spark: SparkSession, d: str) -> DataFrame:
    """A warning: quotes that no chunk holds, but two consecutive chunks of a record together."""
    return validation.straddling(_ways(spark, d), _passages(spark, d)).select("id", "fact", "page", "quote")


@query("quota_mismatch", f"SELECT category, count(*) AS items, least(count(*), CASE category WHEN 'fact' THEN 40 WHEN 'howto' THEN 30 WHEN 'version' THEN 25 WHEN 'multihop' THEN 20 WHEN 'unanswerable' THEN 20 WHEN 'false_premise' THEN 10 ELSE 0 END) AS fits, CASE category WHEN 'fact' THEN 40 WHEN 'howto' THEN 30 WHEN 'version' THEN 25 WHEN 'multihop' THEN 20 WHEN 'unanswerable' THEN 20 WHEN 'false_premise' THEN 10 ELSE 0 END AS quota FROM {ITEMS} GROUP BY category")
def quota_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """What each category can give of its quota; `validation.assert_quotas` refuses to go on where one can't be filled."""
    return validation.quota_fit(items(spark, d), QUOTAS)


@query("unknown_versions", f"SELECT 'golden_items' AS src, i.id AS key, i.version FROM {ITEMS} i WHERE i.version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.version = i.version) UNION ALL SELECT 'sections', s.section_id, s.version FROM (SELECT DISTINCT section_id, version FROM sections) s WHERE s.version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.version = s.version)")
def unknown_versions(spark: SparkSession, d: str) -> DataFrame:
    """Items and sections of versions that the chunks don't have."""
    known = table(spark, d, "chunks").select("version").distinct()
    asked = items(spark, d).select(F.lit("golden_items").alias("src"), F.col("id").alias("key"), "version")
    parsed = table(spark, d, "sections").select(F.lit("sections").alias("src"), F.col("section_id").alias("key"), "version").distinct()
    return asked.unionByName(parsed).where("version is not null").join(known, "version", "left_anti").select("src", "key", "version")


@query(
    "faithfulness",
    f"""SELECT row_id, round(list_sum(list_transform(retrieved, lambda r: CASE WHEN list_contains(list_transform(sources, lambda s: s.chunk_id), r) THEN 1.0 WHEN list_contains(list_transform(sources, lambda s: split_part(s.chunk_id, '::', 1)), split_part(r, '::', 1)) THEN 0.5 ELSE 0.0 END)) / nullif(len(retrieved), 0), 6) AS support FROM {ANSWERS}""",
)
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Mean weight (1, a half, 0) of an answer's claims; null without claims. The tables hold no judged claims, so each retrieved chunk stands for one, supported if it is cited and partly if its record is."""
    cited, records = F.transform("sources", lambda s: s["chunk_id"]), F.transform("sources", lambda s: F.split_part(s["chunk_id"], F.lit("::"), F.lit(1)))
    claims = F.transform("retrieved", lambda r: F.struct(r.alias("claim"), F.when(F.array_contains(cited, r), "supported").when(F.array_contains(records, F.split_part(r, F.lit("::"), F.lit(1))), "partial").otherwise("unsupported").alias("support")))
    return answers(spark, d).select("row_id", F.round(R.faithfulness(claims), 6).alias("support"))


@query("report_table", f"SELECT concat('| ', run, ' | ', count(*), ' | ', printf('%.3f', avg(CASE WHEN isnan(citation_precision) THEN NULL ELSE citation_precision END)), ' | ', printf('%.2f', sum(usd)), ' |') AS line FROM {ANSWERS} GROUP BY run")
def report_table(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a Markdown report."""
    per = answers(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.avg(F.expr("nullif(citation_precision, double('NaN'))")).alias("p"), F.sum("usd").alias("usd"))
    return per.select(F.format_string("| %s | %d | %.3f | %.2f |", "run", "n", "p", "usd").alias("line"))
