"""Queries of judged runs: summaries, score maps, comparisons and intervals for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import metrics
from loomspark.operators.rows import latest
from loomspark.plans.catalog import ANSWERS, CHUNKS, ITEMS, query
from loomspark.plans.evaluation import DISPLAY_SAMPLES, SEED, _bootstrap_sql, answers
from loomspark.plans.search import _METRICS, covered
from loomspark.session import table

#: The tables hold no judge's grades: an answer's precision stands for its grade, 2 from 0.8 on, 1 from 0.4 on, else 0; its cited share of what was retrieved for its faithfulness.
_GRADE = "CASE WHEN citation_precision IS NULL OR isnan(citation_precision) THEN NULL WHEN citation_precision >= 0.8 THEN 2 WHEN citation_precision >= 0.4 THEN 1 ELSE 0 END"
_SUPPORT = "len(sources) / nullif(len(retrieved), 0)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "category", "citation_precision", "sources", "retrieved", "created_at"))
    p = F.expr("nullif(citation_precision, double('NaN'))")
    return a.select("row_id", "run", "category", "created_at", F.when(p >= 0.8, 2).when(p >= 0.4, 1).when(p.isNotNull(), 0).alias("grade"), (F.size("sources") / F.nullif(F.size("retrieved"), F.lit(0))).alias("support"))


_JUDGED = "count(*) AS answers, CAST(count(grade) AS BIGINT) AS graded, round(avg(grade), 4) AS correctness, round(avg(CAST(grade = 2 AS INT)), 4) AS fully_correct, round(avg(support), 4) AS faithfulness"


@query("judge_summary", f"SELECT run, coalesce(category, 'all') AS category, {_JUDGED} FROM (SELECT run, category, {_GRADE} AS grade, {_SUPPORT} AS support FROM {ANSWERS}) GROUP BY GROUPING SETS ((run, category), (run))")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """A judge's block of a run, overall and by category; ungraded answers count for none of the means."""
    return _summary(judged(spark, d).rollup("run", "category")).where("run is not null").withColumn("category", F.coalesce("category", F.lit("all")))


def _summary(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("answers"), F.count("grade").alias("graded"), F.round(F.avg("grade"), 4).alias("correctness"), F.round(F.avg(F.expr("int(grade = 2)")), 4).alias("fully_correct"), F.round(F.avg("support"), 4).alias("faithfulness"))


@query(
    "runs_with_latest_judge",
    f"""WITH j AS (SELECT run, run || '.judge-' || strftime(created_at, '%Y%m') AS name, {_JUDGED} FROM (SELECT run, created_at, {_GRADE} AS grade, {_SUPPORT} AS support FROM {ANSWERS}) WHERE run <> 'baseline' GROUP BY 1, 2)
    SELECT s.run, s.answers, j.name AS judge, j.correctness FROM (SELECT run, count(*) AS answers FROM {ANSWERS} GROUP BY run) s LEFT JOIN (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY run ORDER BY name DESC) = 1) j ON j.run = s.run""",
)
def runs_with_latest_judge(spark: SparkSession, d: str) -> DataFrame:
    """Every run with its latest judge summary, the last by name; one run was never judged. A month's answers stand for what a judge saw."""
    rows = judged(spark, d)
    judges = _summary(rows.where("run <> 'baseline'").withColumn("name", F.concat("run", F.lit(".judge-"), F.date_format("created_at", "yyyyMM"))).groupBy("run", "name"))
    last = judges.groupBy("run").agg(F.max_by(F.struct("name", "correctness"), "name").alias("j"))
    return rows.groupBy("run").agg(F.count("*").alias("answers")).join(last, "run", "left").select("run", "answers", F.col("j.name").alias("judge"), F.col("j.correctness").alias("correctness"))


_MAPPED = ("recall_5", "recall_10", "recall_20", "hit_10", "mrr", "ndcg_10")


@query("retrieval_score_map", f"WITH {_METRICS} SELECT config_id, id, metric, CAST(value AS DOUBLE) AS value FROM (SELECT config_id, id, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in _MAPPED) + f" FROM M) UNPIVOT (value FOR metric IN ({', '.join(_MAPPED)}))")
def retrieval_score_map(spark: SparkSession, d: str) -> DataFrame:
    """An item's scores under each config, metrics as rows, for comparisons of runs."""
    m = metrics.retrieval_metrics(covered(spark, d), ["config_id"])
    return m.select("config_id", "id", *[F.col(c).cast("double").alias(c) for c in _MAPPED]).unpivot(["config_id", "id"], list(_MAPPED), "metric", "value")


_GENERATION = ("found", "citation_hit", "citation_precision", "correctness", "faithfulness", "usd")
_SCORES = f"SELECT row_id, run, CAST(found AS DOUBLE) AS found, CAST(citation_hit AS DOUBLE) AS citation_hit, CASE WHEN isnan(citation_precision) THEN NULL ELSE citation_precision END AS citation_precision, CAST({_GRADE} AS DOUBLE) AS correctness, round({_SUPPORT}, 6) AS faithfulness, usd FROM {ANSWERS}"


@query("generation_score_map", f"SELECT row_id, run, metric, value FROM ({_SCORES}) UNPIVOT (value FOR metric IN ({', '.join(_GENERATION)}))")
def generation_score_map(spark: SparkSession, d: str) -> DataFrame:
    """An answer's six scores as rows; a score that isn't there has no row."""
    a = answers(spark, d).join(judged(spark, d).select("row_id", F.col("grade").alias("g"), "support"), "row_id")
    wide = a.select("row_id", "run", F.col("found").cast("double").alias("found"), F.col("citation_hit").cast("double").alias("citation_hit"), F.expr("nullif(citation_precision, double('NaN'))").alias("citation_precision"), F.col("g").cast("double").alias("correctness"), F.round("support", 6).alias("faithfulness"), "usd")
    return wide.unpivot(["row_id", "run"], list(_GENERATION), "metric", "value").where("value is not null")


@query("display_intervals", "WITH " + _bootstrap_sql(f"SELECT run, row_id AS unit, CAST(citation_hit AS DOUBLE) AS x FROM {ANSWERS} WHERE citation_hit IS NOT NULL", "run", DISPLAY_SAMPLES))
def display_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Listed results with their interval, of as many resamples as a page waits for."""
    a = answers(spark, d).select("run", F.col("row_id").alias("unit"), F.col("citation_hit").cast("double").alias("x"))
    return metrics.bootstrap(a, "run", "unit", "x", DISPLAY_SAMPLES, SEED)


_DIFF = ("citation_precision", "citation_hit", "usd")
_PAIRED = f"""SELECT a.run || '|' || a.metric AS pair, a.id AS unit, a.v - b.v AS x FROM (SELECT run, metric, id, avg(value) AS v FROM (SELECT run, id, CASE WHEN isnan(citation_precision) THEN NULL ELSE citation_precision END AS citation_precision, CAST(citation_hit AS DOUBLE) AS citation_hit, usd FROM {ANSWERS}) UNPIVOT (value FOR metric IN ({', '.join(_DIFF)})) GROUP BY 1, 2, 3) a
JOIN (SELECT metric, id, avg(value) AS v FROM (SELECT run, id, CASE WHEN isnan(citation_precision) THEN NULL ELSE citation_precision END AS citation_precision, CAST(citation_hit AS DOUBLE) AS citation_hit, usd FROM {ANSWERS} WHERE run = 'baseline') UNPIVOT (value FOR metric IN ({', '.join(_DIFF)})) GROUP BY 1, 2) b ON a.metric = b.metric AND a.id = b.id WHERE a.run <> 'baseline'"""


@query("run_comparison", "WITH " + _bootstrap_sql(_PAIRED, "pair", DISPLAY_SAMPLES))
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every run against the baseline in every metric: mean difference on shared items, interval, and how often it isn't above 0."""
    a = answers(spark, d).select("run", "id", F.expr("nullif(citation_precision, double('NaN'))").alias("citation_precision"), F.col("citation_hit").cast("double").alias("citation_hit"), "usd")
    per = a.unpivot(["run", "id"], list(_DIFF), "metric", "value").where("value is not null").groupBy("run", "metric", "id").agg(F.avg("value").alias("v"))
    base = per.where("run = 'baseline'").select("metric", "id", F.col("v").alias("b"))
    diffs = per.where("run <> 'baseline'").join(base, ["metric", "id"]).select(F.concat("run", F.lit("|"), "metric").alias("pair"), F.col("id").alias("unit"), (F.col("v") - F.col("b")).alias("x"))
    return metrics.bootstrap(diffs, "pair", "unit", "x", DISPLAY_SAMPLES, SEED)


@query(
    "calibration_export",
    f"""WITH p AS (SELECT row_id, run, id, category, question, answer, sources FROM {ANSWERS} QUALIFY row_number() OVER (PARTITION BY run, category ORDER BY md5('{SEED}:' || row_id), row_id) <= 5)
    SELECT p.row_id, p.run, p.category, p.question, coalesce(i.reference_answer, '') AS reference, p.answer, md5(coalesce((SELECT string_agg(coalesce(c.text, '(missing)'), chr(10) ORDER BY u.o) FROM unnest(p.sources) WITH ORDINALITY u(s, o) LEFT JOIN {CHUNKS} c ON c.chunk_id = u.s.chunk_id), '')) AS sources_digest FROM p LEFT JOIN {ITEMS} i ON i.id = p.id""",
)
def calibration_export(spark: SparkSession, d: str) -> DataFrame:
    """Five answers of each run and category for a person to grade, with reference and sources, without the judge's grade."""
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "id", "category", "question", "answer", "sources"))
    order = Window.partitionBy("run", "category").orderBy(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("row_id").cast("string"))), "row_id")
    picked = a.withColumn("r", F.row_number().over(order)).where("r <= 5")
    texts = latest(table(spark, d, "chunks"), "chunk_id", keep=("text",))
    cited = picked.select("row_id", F.posexplode("sources.chunk_id").alias("pos", "chunk_id")).join(texts, "chunk_id", "left")
    gathered = cited.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("(missing)")).alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    i = latest(table(spark, d, "golden_items"), "id", keep=("reference_answer",))
    return picked.join(i, "id", "left").join(gathered, "row_id", "left").select("row_id", "run", "category", "question", F.coalesce("reference_answer", F.lit("")).alias("reference"), "answer", F.md5(F.coalesce("t", F.lit(""))).alias("sources_digest"))


@query("missing_answers", f"SELECT r.run, i.id FROM (SELECT DISTINCT run FROM {ANSWERS}) r CROSS JOIN (SELECT id FROM {ITEMS} WHERE split IN ('dev', 'test')) i WHERE NOT EXISTS (SELECT 1 FROM {ANSWERS} a WHERE a.run = r.run AND a.id = i.id)")
def missing_answers(spark: SparkSession, d: str) -> DataFrame:
    """Items that a run has no answer to; runs are a handful."""
    a = answers(spark, d).select("run", "id").distinct()
    i = latest(table(spark, d, "golden_items"), "id", keep=("split",)).where("split in ('dev', 'test')").select("id")
    return i.crossJoin(F.broadcast(a.select("run").distinct())).join(a, ["run", "id"], "left_anti").select("run", "id")


