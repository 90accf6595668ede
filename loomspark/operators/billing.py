"""Money of model calls: what a call may cost, what it did cost, reservations, and whether the next one is allowed; the life of batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.ledger import BATCH_SHARE

#: Input tokens that a single call may have.
INPUT_MOST = 200_000


def cost(usage: Column, prices: Column, batch: Column) -> Column:
    """Dollars of a call: usage has input_tokens, output_tokens, cache_read_tokens and cache_write_tokens, prices a price per million of each (input, output, cache_read, cache_write);
    half of it in a batch, to nine places. Null classes cost nothing; without prices the cost is null."""
    part = lambda tokens, price: F.coalesce(usage[tokens].cast("double"), F.lit(0.0)) * prices[price]
    full = (part("input_tokens", "input") + part("output_tokens", "output") + part("cache_read_tokens", "cache_read") + part("cache_write_tokens", "cache_write")) / 1_000_000
    return F.round(F.when(batch, full * BATCH_SHARE).otherwise(full), 9)


def worst_case(input_tokens: Column, most_output: Column, prices: Column) -> Column:
    return F.round((input_tokens * F.greatest(prices["input"], prices["cache_write"]) + most_output * prices["output"]) / 1_000_000, 9)


def check_calls(calls: DataFrame, prices: DataFrame, spent: Column, budget: float, most_output: int, most_input: int = INPUT_MOST) -> DataFrame:
    """calls(…, model, input_tokens) with worst and refusal: 'unknown model', 'input too long', 'over budget' (what is spent and the call's worst case together), else null.

    prices(model, prices) is joined; a call is judged by itself against what was spent before."""
    rows = calls.join(prices, "model", "left").withColumn("worst", worst_case(F.col("input_tokens"), F.lit(most_output), F.col("prices")))
    refusal = F.when(F.col("prices").isNull(), "unknown model").when(F.col("input_tokens") > most_input, "input too long").when(spent + F.col("worst") > budget, "over budget")
    return rows.withColumn("refusal", refusal).drop("prices")


def booked(log: DataFrame) -> DataFrame:
    """(request_id, usd, state): what each request stands at in an append-only log(request_id, seq, kind, usd) of 'reserve', 'usage' and 'release': settled at its usage, released
    at nothing, else at the worst cases of its reservations since the last answer, being 'unconfirmed' if there are several, as then an earlier one may have been carried out too."""
    answered = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("_round", F.count_if(F.col("kind").isin("usage", "release")).over(answered)).withColumn("usd", F.col("usd").cast("decimal(18,9)"))
    rounds = rows.groupBy("request_id", "_round").agg(F.sum(F.when(F.col("kind") == "reserve", F.col("usd"))).alias("reserved"), F.count_if(F.col("kind") == "reserve").alias("times"), F.max_by("kind", "seq").alias("last"), F.sum(F.when(F.col("kind") == "usage", F.col("usd"))).alias("used"))
    per = rounds.groupBy("request_id").agg(F.max_by(F.struct("last", "reserved", "times"), "_round").alias("r"), F.sum("used").alias("used"))
    state = F.when(F.col("r.last") == "usage", "settled").when(F.col("r.last") == "release", "released").when(F.col("r.times") > 1, "unconfirmed").otherwise("reserved")
    usd = F.coalesce("used", F.lit(0)) + F.when(F.col("r.last") == "reserve", F.col("r.reserved")).otherwise(F.lit(0))
    return per.select("request_id", usd.cast("double").alias("usd"), state.alias("state"))


def entries(df: DataFrame, request: str, kind: str, usd: Column, seq: Column) -> DataFrame:
    """Rows for the log: a reservation at the worst case, the usage, or a release, which is written with a negative sign."""
    sign = -1.0 if kind == "release" else 1.0
    return df.select(F.col(request).alias("request_id"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), F.round(usd * sign, 9).alias("usd"))


def guarded(count: Callable[[], int], allowed: Callable[[int], str | None], send: Callable[[], Any], record: Callable[[Any], None]) -> Any:
    """One guarded call: its tokens are counted, the check may refuse it, it is sent, and its usage is recorded whatever comes of the answer."""
    reason = allowed(count())
    if reason:
        raise PermissionError(reason)
    answer = send()
    record(answer)
    return answer


def with_back_off(call: Callable[[], Any], limited: type[Exception] | tuple[type[Exception], ...], tries: int = 5, wait: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; after a rate limit it is tried again, the wait doubling up to `most`, or as long as the error's retry_after says; the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except limited as e:
            if n == tries - 1:
                raise
            sleep(min(most, getattr(e, "retry_after", None) or wait * 2**n))
    raise ValueError("no tries")


def collected(results: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, errors by kind) of a batch's results(custom_id, type, text, error): the last result of a request counts; requests without any are 'missing'."""
    last = results.groupBy("custom_id").agg(F.max_by(F.struct("type", "text", "error"), F.coalesce("seq", F.lit(0)) if "seq" in results.columns else F.struct("type", "text", "error")).alias("r")).select("custom_id", "r.*")
    rows = requests.select("custom_id").distinct().join(last, "custom_id", "left")
    kind = F.when(F.col("type") == "succeeded", F.lit(None)).when(F.col("type").isNull(), "missing").otherwise(F.coalesce("error", "type"))
    errors = rows.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("requests"))
    return rows.where("type = 'succeeded'").select("custom_id", "text"), errors


def settlement(requests: DataFrame, usage: DataFrame) -> DataFrame:
    """(request_id, reserved, used, released) when a batch ends: requests(request_id, worst) give back what their usage(request_id, usd) left over; those without usage all of it."""
    used = usage.groupBy("request_id").agg(F.sum(F.col("usd").cast("decimal(18,9)")).cast("double").alias("used"))
    return requests.join(used, "request_id", "left").select("request_id", F.col("worst").alias("reserved"), F.coalesce("used", F.lit(0.0)).alias("used"), F.round(F.col("worst") - F.coalesce("used", F.lit(0.0)), 9).alias("released"))
