"""Running balances, budgets, costs and rate limits over event logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the price in a batch.
BATCH_SHARE = 0.5


def running_balance(events: DataFrame, account: str, order: list[str], amount: Column) -> DataFrame:
    """events with balance: the sum of an account's amounts up to and with each event, exact in decimals.

    Accounts are split by day: each day is summed on its own, the days' totals are accumulated per account, and a day's events add their own
    running sum, so that the longest window is one account's day and not its whole history."""
    rows = events.withColumn("_amount", amount.cast("decimal(18,6)")).withColumn("_day", F.to_date(order[0]))
    per_day = rows.groupBy(account, "_day").agg(F.sum("_amount").alias("_total"))
    before = per_day.withColumn("_before", F.coalesce(F.sum("_total").over(Window.partitionBy(account).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(28,6)"))).drop("_total")
    own = F.sum("_amount").over(Window.partitionBy(account, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.join(before, [account, "_day"])
    return joined.withColumn("balance", (F.col("_before") + own).cast("decimal(28,6)")).drop("_amount", "_day", "_before")


def over_budget(balanced: DataFrame, budget: float) -> DataFrame:
    return balanced.where(F.col("balance") > F.lit(budget).cast("decimal(28,6)"))


def usage_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, batch: Column) -> Column:
    """Cost in dollars of tokens at prices per million, half of it in a batch, to nine places."""
    full = (input_tokens * input_price + output_tokens * output_price) / 1_000_000
    return F.round(F.when(batch, full * BATCH_SHARE).otherwise(full), 9)


def worst_case(input_tokens: Column, most_output: Column, input_price: Column, cache_price: Column, output_price: Column) -> Column:
    """What a request can cost at most: its input at the dearer of both input prices, and as much output as allowed."""
    return F.round((input_tokens * F.greatest(input_price, cache_price) + most_output * output_price) / 1_000_000, 9)


def requests_in_window(requests: DataFrame, client: str, ts: str, seconds: int) -> DataFrame:
    """requests with n: how many the client made in the `seconds` up to and with each, itself included.

    A client's time is cut into blocks of many windows; the last rows of a block are lent to the next one, so that the longest
    sort is one client's block, whatever share of all rows a client has."""
    block = max(3600, 10 * seconds)
    t = F.col(ts).cast("timestamp").cast("double")
    rows = requests.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / block))
    lent = F.when(F.col("_t") >= (F.col("_b") + 1) * block - seconds, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))
    spread_ = rows.withColumn("_in", F.explode(F.coalesce(lent, F.array(F.lit(None).cast("bigint")))))
    over = Window.partitionBy(client, "_in").orderBy("_t").rangeBetween(-seconds, 0)
    return spread_.withColumn("n", F.count("*").over(over)).where(F.col("_in").eqNullSafe(F.col("_b"))).drop("_t", "_b", "_in")


def admitted(requests: DataFrame, client: str, ts: str, id: str, most: int, seconds: int) -> DataFrame:
    """(client, id, admitted): a request is admitted while fewer than `most` admitted ones lie in the `seconds` before it.

    Sequential per client by its meaning; only the last `most` admitted times of a client are held, and a task reads its clients' requests
    in order as a stream, however many there are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = object(), deque()
        for pdf in batches:
            flags = []
            for who, t in zip(pdf[client], pdf["_t"]):
                if who != current:
                    current, recent = who, deque()
                while recent and recent[0] <= t - seconds:
                    recent.popleft()
                ok = len(recent) < most
                if ok:
                    recent.append(t)
                flags.append(ok)
            yield pd.DataFrame({client: pdf[client], id: pdf[id], "admitted": flags})

    rows = requests.where(F.col(client).isNotNull()).select(client, id, F.col(ts).cast("timestamp").cast("double").alias("_t"))
    kinds = dict(requests.dtypes)
    return rows.repartition(client).sortWithinPartitions(client, "_t", id).mapInPandas(work, f"{client} {kinds[client]}, {id} {kinds[id]}, admitted boolean")


def sessions(events: DataFrame, who: str, ts: str, gap_seconds: int) -> DataFrame:
    """(who, session, events, start, end): a new session begins after more than a gap without events.

    Worked out per day: an event follows the one before it on its day, the first of a day the last of the days before; sessions that begin on
    a day are counted and added up over days. So no sort is longer than one day of one `who`."""
    rows = events.select(who, F.col(ts).cast("timestamp").alias("_t")).where("_t is not null").withColumn("_day", F.to_date("_t"))
    days = Window.partitionBy(who).orderBy("_day")
    last = rows.groupBy(who, "_day").agg(F.max("_t").alias("_last")).withColumn("_before", F.lag("_last").over(days)).drop("_last")
    order = Window.partitionBy(who, "_day").orderBy("_t")
    joined = rows.join(last.withColumnsRenamed({who: "_who", "_day": "_d"}), F.col(who).eqNullSafe(F.col("_who")) & (F.col("_day") == F.col("_d"))).drop("_who", "_d")
    previous = F.coalesce(F.lag("_t").over(order), F.col("_before"))
    opened = joined.withColumn("_new", F.when(F.col("_t").cast("double") - previous.cast("double") <= gap_seconds, 0).otherwise(1))
    in_day = opened.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per_day = opened.groupBy(who, "_day").agg(F.sum("_new").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = in_day.join(per_day.withColumnsRenamed({who: "_who", "_day": "_d"}), F.col(who).eqNullSafe(F.col("_who")) & (F.col("_day") == F.col("_d"))).withColumn("session", F.col("_offset") + F.col("_k"))
    return numbered.groupBy(who, "session").agg(F.count("*").alias("events"), F.min("_t").alias("start"), F.max("_t").alias("end"))
