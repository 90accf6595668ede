"""Retrieval metrics, resampling and rater agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import contains_quote, fragment, page_identity

CUTS = (1, 3, 5, 10, 20)
#: Added before a mean is rounded, so that a tie goes up whatever the order of the sum.
TIE = 1e-9


def facts_of(items: DataFrame, section: bool = False) -> DataFrame:
    """(id, fact, page, quote): a row per fact and way to state it; alternatives share their fact's number. With `section`, the URL's fragment too."""
    facts = items.select("id", F.posexplode("evidence").alias("fact", "e"))
    ways = F.concat(F.array(F.struct(F.col("e.url").alias("url"), F.col("e.quote").alias("quote"))), F.coalesce(F.col("e.alternatives"), F.array().cast("array<struct<url:string,quote:string>>")))
    rows = facts.select("id", "fact", F.explode(ways).alias("w"))
    return rows.select("id", "fact", page_identity(F.col("w.url")).alias("page"), F.col("w.quote").alias("quote"), *([fragment(F.col("w.url")).alias("section")] if section else []))


def first_covering_rank(ranked: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, fact, rank): the smallest rank at which a fact's page and quote are found together, null where never.

    ranked: keys, id, rank, page, text. The join is an equi-join on item and page; the quote is its residual. Each fact counts once, at
    its first rank, so repeated chunks earn nothing."""
    runs = ranked.select(*keys, "id").distinct()
    hit = ranked.join(facts, ["id", "page"]).where(contains_quote(F.col("text"), F.col("quote"))).groupBy(*keys, "id", "fact").agg(F.min("rank").alias("rank"))
    return runs.join(facts.select("id", "fact").distinct(), "id").join(hit, [*keys, "id", "fact"], "left")


def retrieval_metrics(covered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, facts, recall_k, hit_k, mrr, ndcg_10) from one row per fact with its first covering rank."""
    aggregates = [F.count("*").alias("facts"), F.min("rank").alias("_first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_gain")]
    aggregates += [F.count_if(F.col("rank") <= k).alias(f"_n{k}") for k in CUTS]
    ideal = F.element_at(F.array(*[F.lit(sum(1 / math.log2(r + 1) for r in range(1, n + 1))) for n in range(1, 11)]), F.least(F.col("facts"), F.lit(10)).cast("int"))
    out = covered.groupBy(*keys, "id").agg(*aggregates)
    return out.select(
        *keys, "id", "facts",
        *[F.round(F.col(f"_n{k}") / F.col("facts"), 6).alias(f"recall_{k}") for k in CUTS], *[(F.col(f"_n{k}") > 0).cast("int").alias(f"hit_{k}") for k in CUTS],
        F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("_gain") / ideal, 6).alias("ndcg_10"),
    )


#: Bits of a draw, and draws that one hash gives.
BITS, DRAWS = 15, 8


def poisson_limits(most: int = 7) -> list[tuple[int, float]]:
    """(k, limit): a draw of BITS bits below the limit, and none before, is k; one below none is `most`. So values are drawn as often as in a resample of a large set."""
    cdf, p, out = 0.0, math.exp(-1), []
    for k in range(most):
        cdf += p
        out.append((k, cdf * (1 << BITS)))
        p /= k + 1
    return out


def poisson_weight(draw: Column, most: int = 7) -> Column:
    weight = F.lit(most)
    for k, limit in reversed(poisson_limits(most)):
        weight = F.when(draw < limit, k).otherwise(weight)
    return weight


def bootstrap(values: DataFrame, group: str, unit: str, value: str, samples: int, seed: int) -> DataFrame:
    """(group, n, mean, low, high, share_not_above_0): Poisson bootstrap of means.

    A value's weight in a sample comes from a hash of seed, sample and unit (one hash for DRAWS samples), so nothing is indexed or sorted per group: resamples are sums
    with map-side combine, of DRAWS samples side by side. low and high are the sorted means at int(0.025 S) and int(0.975 S) - 1. Null values don't count; a group without values is left out."""
    rows = values.where(F.col(value).isNotNull()).select(group, unit, F.col(value).cast("double").alias("_x"))
    hashed = rows.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // DRAWS)))).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "_q", F.col(unit).cast("string"))))
    halves = hashed.select(group, "_x", "_q", *[F.conv(F.substring("_h", at, BITS), 16, 10).cast("long").alias(name) for at, name in ((1, "_a"), (BITS + 1, "_b"))])
    weights = [poisson_weight(F.shiftright("_a" if i < DRAWS // 2 else "_b", BITS * (i % (DRAWS // 2))).bitwiseAND(F.lit((1 << BITS) - 1))).alias(f"_w{i}") for i in range(DRAWS)]
    summed = halves.select(group, "_x", "_q", *weights).groupBy(group, "_q").agg(*[F.sum(F.col(f"_w{i}") * F.col("_x")).alias(f"_t{i}") for i in range(DRAWS)], *[F.sum(f"_w{i}").alias(f"_n{i}") for i in range(DRAWS)])
    samples_ = summed.select(group, "_q", F.posexplode(F.array(*[F.struct(F.col(f"_t{i}").alias("t"), F.col(f"_n{i}").alias("w")) for i in range(DRAWS)])).alias("_p", "_s"))
    means = samples_.where((F.col("_q") * DRAWS + F.col("_p") < samples) & (F.col("_s.w") > 0)).select(group, (F.col("_s.t") / F.col("_s.w")).alias("m"))
    sorted_ = means.groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # `samples` numbers a group
    at = lambda share, less: F.element_at("ms", F.greatest(F.floor(F.size("ms") * share) + 1 - less, F.lit(1)).cast("int"))
    overall = rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg("_x") + TIE, 4).alias("mean"))
    ends = sorted_.select(group, F.round(at(0.025, 0) + TIE, 4).alias("low"), F.round(at(0.975, 1) + TIE, 4).alias("high"), F.round(F.size(F.filter("ms", lambda m: m <= 0)) / F.size("ms"), 4).alias("share_not_above_0"))
    return overall.join(ends, group)


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, a: str, b: str, labels: int) -> DataFrame:
    """(n, agreement, kappa, weighted_kappa): Cohen's kappa, plain and with quadratic weights, over labels 0 to labels - 1; where
    no disagreement is expected it is 1. The grid has labels squared cells, so it is compared on one row."""
    grid = confusion(pairs, a, b).groupBy().agg(
        F.sum("n").alias("n"),
        *[F.coalesce(F.sum(F.when(F.col(a) == i, F.col("n"))), F.lit(0)).alias(f"a{i}") for i in range(labels)],
        *[F.coalesce(F.sum(F.when(F.col(b) == i, F.col("n"))), F.lit(0)).alias(f"b{i}") for i in range(labels)],
        F.coalesce(F.sum(F.when(F.col(a) != F.col(b), F.col("n"))), F.lit(0)).alias("do"), F.coalesce(F.sum(F.col("n") * F.pow(F.col(a) - F.col(b), 2.0)), F.lit(0.0)).alias("dow"),
    )
    expected = sum((F.col(f"a{i}") * F.col(f"b{j}") for i in range(labels) for j in range(labels) if i != j), F.lit(0)) / F.col("n")
    expected_w = sum((F.col(f"a{i}") * F.col(f"b{j}") * (i - j) ** 2 for i in range(labels) for j in range(labels) if i != j), F.lit(0)) / F.col("n")
    one = lambda o, e: F.round(F.when(e == 0, 1.0).otherwise(1 - F.col(o) / e), 6)
    return grid.where("n > 0").select("n", F.round(1 - F.col("do") / F.col("n"), 6).alias("agreement"), one("do", expected).alias("kappa"), one("dow", expected_w).alias("weighted_kappa"))


def stratified(df: DataFrame, id: str, stratum: str, n: int, seed: int) -> DataFrame:
    """(id, stratum): about n rows in proportion to the strata, at least one of each, by hash order. A map task keeps at most n rows of a stratum."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_all"))
    quota = sizes.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("_st"), F.greatest(F.lit(1), F.least(F.lit(n), F.bround(F.col("_size") * n / F.col("_all")).cast("int"))).alias("_quota"))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))), id)
    ranked = df.select(id, stratum).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("_st"))).where("_r <= _quota").select(id, stratum)
