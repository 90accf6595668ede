"""Queries of money: costs by token class, checks with refusals, reservations and what stands booked, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import billing
from loomspark.operators.rows import latest
from loomspark.plans.catalog import ANSWERS, query
from loomspark.session import table

# Prices per million tokens by model. One run's model has no price.
PRICES = {"baseline": (1.0, 5.0, 0.1, 1.25), "default": (1.0, 5.0, 0.1, 1.25), "e5-rerank": (3.0, 15.0, 0.3, 3.75), "e7-hyde": (3.0, 15.0, 0.3, 3.75)}
_PRICES = "(VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE, {r}::DOUBLE, {w}::DOUBLE)" for m, (i, o, r, w) in PRICES.items()) + ") p(run, i, o, r, w)"
#: The tables count two classes of tokens; of the input tokens a tenth stands for cache reads and a fifth for cache writes.
_CLASSES = "usage.input_tokens AS input, usage.output_tokens AS output, usage.input_tokens // 10 AS reads, usage.input_tokens // 5 AS writes"
_CALLS = f"(SELECT row_id, run, id, {_CLASSES}, row_id % 2 = 0 AS batch FROM {ANSWERS})"


def prices(spark: SparkSession) -> DataFrame:
    rows = [(m, {"input": i, "output": o, "cache_read": r, "cache_write": w}) for m, (i, o, r, w) in PRICES.items()]
    return F.broadcast(spark.createDataFrame(rows, "model string, prices struct<input:double,output:double,cache_read:double,cache_write:double>"))  # one row a model


def calls(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "id", "usage", "stop_reason"))
    usage = F.struct("usage.input_tokens", "usage.output_tokens", F.expr("usage.input_tokens div 10").alias("cache_read_tokens"), F.expr("usage.input_tokens div 5").alias("cache_write_tokens"))
    return a.select("row_id", F.col("run").alias("model"), "id", F.col("usage.input_tokens").alias("input_tokens"), usage.alias("usage"), (F.col("row_id") % 2 == 0).alias("batch"), "stop_reason")


_COST = "round((input * i + output * o + reads * r + writes * w) / 1000000 * CASE WHEN batch THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 9)"
_WORST = "round((input * greatest(i, w) + 1024 * o) / 1000000, 9)"


@query("call_costs", f"SELECT row_id, {_COST} AS cost FROM {_CALLS} LEFT JOIN {_PRICES} USING (run)")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs by four classes of tokens, half in a batch; null where the model has no price."""
    return calls(spark, d).join(prices(spark), "model", "left").select("row_id", billing.cost(F.col("usage"), F.col("prices"), F.col("batch")).alias("cost"))


@query(
    "call_refusals",
    f"SELECT row_id, {_WORST} AS worst, CASE WHEN i IS NULL THEN 'unknown model' WHEN input > 6000 THEN 'input too long' WHEN 9.99 + {_WORST} > 10 THEN 'over budget' END AS refusal FROM {_CALLS} LEFT JOIN {_PRICES} USING (run)",
)
def call_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Each call against a budget of 10 dollars of which 9.99 are spent."""
    checked = billing.check_calls(calls(spark, d), prices(spark), F.lit(9.99), 10.0, 1024, 6000)
    return checked.select("row_id", "worst", "refusal")


#: A log out of the answers: every call reserves its worst case, those of some rows twice; what was answered is settled, what was refused is released, the rest stays open.
_LOG = f"""L AS (SELECT row_id, {_WORST} AS worst, round({_COST}, 9) AS cost, stop_reason FROM (SELECT c.*, a.stop_reason FROM {_CALLS} c JOIN {ANSWERS} a ON a.row_id = c.row_id) LEFT JOIN {_PRICES} USING (run) WHERE i IS NOT NULL)"""
_TWICE = "row_id % 7 = 0"


def billing_log(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).join(prices(spark), "model").withColumn("worst", billing.worst_case(F.col("input_tokens"), F.lit(1024), F.col("prices"))).withColumn("cost", billing.cost(F.col("usage"), F.col("prices"), F.col("batch")))
    first = billing.entries(c, "row_id", "reserve", F.col("worst"), F.lit(1))
    again = billing.entries(c.where(_TWICE), "row_id", "reserve", F.col("worst"), F.lit(2))
    used = billing.entries(c.where("stop_reason in ('end_turn', 'max_tokens')"), "row_id", "usage", F.col("cost"), F.lit(3))
    given = billing.entries(c.where("stop_reason = 'refusal'"), "row_id", "release", F.col("worst"), F.lit(3))
    return first.unionByName(again).unionByName(used).unionByName(given)


@query(
    "booked_requests",
    f"WITH {_LOG} SELECT row_id AS request_id, CAST(CASE WHEN stop_reason IN ('end_turn', 'max_tokens') THEN cost WHEN stop_reason = 'refusal' THEN 0 WHEN {_TWICE} THEN 2 * worst ELSE worst END AS DOUBLE) AS usd, CASE WHEN stop_reason IN ('end_turn', 'max_tokens') THEN 'settled' WHEN stop_reason = 'refusal' THEN 'released' WHEN {_TWICE} THEN 'unconfirmed' ELSE 'reserved' END AS state FROM L",
)
def booked_requests(spark: SparkSession, d: str) -> DataFrame:
    """What each request stands at; without an answer at its worst case, twice if it was sent twice."""
    return billing.booked(billing_log(spark, d)).withColumn("usd", F.round("usd", 9))


@query("batch_settlement", f"WITH {_LOG} SELECT row_id AS request_id, worst AS reserved, CASE WHEN stop_reason IN ('end_turn', 'max_tokens') THEN cost ELSE 0 END AS used, round(worst - CASE WHEN stop_reason IN ('end_turn', 'max_tokens') THEN cost ELSE 0 END, 9) AS released FROM L")
def batch_settlement(spark: SparkSession, d: str) -> DataFrame:
    log = billing_log(spark, d)
    return billing.settlement(log.where("kind = 'reserve' and seq = 1").select("request_id", F.col("usd").alias("worst")), log.where("kind = 'usage'"))


@query("batch_errors", f"SELECT run, coalesce(CASE WHEN stop_reason = 'refusal' THEN 'errored' WHEN stop_reason IS NULL THEN 'expired' WHEN trim(coalesce(answer, '')) = '' THEN 'unparsed' END, 'succeeded') AS kind, count(*) AS requests FROM {ANSWERS} GROUP BY 1, 2")
def batch_errors(spark: SparkSession, d: str) -> DataFrame:
    """Results of a batch by kind, answers that can't be parsed apart."""
    a = latest(table(spark, d, "generation_rows"), "row_id", keep=("run", "answer", "stop_reason"))
    kind = F.when(F.col("stop_reason") == "refusal", "errored").when(F.col("stop_reason").isNull(), "expired").when(F.trim(F.coalesce("answer", F.lit(""))) == "", "unparsed").otherwise("succeeded")
    return a.groupBy("run", kind.alias("kind")).agg(F.count("*").alias("requests"))
