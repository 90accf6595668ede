"""Rules over records, and assignment of splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broken_rules(df: DataFrame, id: str, rules: dict[str, str]) -> DataFrame:
    """(id, errors): the names of the rules whose condition is true, joined in the order given; rows that break none are left out. A null condition breaks nothing."""
    errors = F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in rules.items()]))
    return df.select(id, errors.alias("e")).where(F.size("e") > 0).select(id, F.array_join("e", "; ").alias("errors"))


#: Parts into which the passages of a page are spread, each of which gets the page's quotes, so that a page with a tenth of all passages isn't one task's work.
SALTS = 16


def _meet(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """quotes(page, quote, …) joined with the passages(page, text, …) of their page that hold them; both are normalised, an empty quote is held by none."""
    left = quotes.where(F.length("quote") > 0).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = passages.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    return left.join(right, ["page", "_salt"]).where(F.contains("text", F.col("quote"))).drop("_salt")


def check_evidence(ways: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, fact, page, result, ways): the first rule that each way(id, fact, page, quote, section) to state a fact breaks, over passages(page, anchor, text, chunk_id)."""
    pages = passages.select("page").distinct().withColumn("known", F.lit(True))
    sections = passages.select("page", F.col("anchor").alias("section")).distinct().withColumn("there", F.lit(True))
    held = _meet(ways.select("page", "quote", "section").distinct(), passages).groupBy("page", "quote", "section").agg(F.lit(True).alias("held"), F.coalesce(F.bool_or(F.col("anchor") == F.col("section")), F.lit(False)).alias("here"))
    named = F.col("section") != ""
    result = F.when(F.col("known").isNull(), "page missing").when(F.col("held").isNull(), "quote missing").when(named & F.col("there").isNull(), "section missing").when(named & ~F.col("here"), "quote not in section").otherwise("ok")
    rows = ways.join(pages, "page", "left").join(sections, ["page", "section"], "left").join(held, ["page", "quote", "section"], "left")
    return rows.withColumn("result", result).groupBy("id", "fact", "page", "result").agg(F.count("*").alias("ways"))


def straddling(ways: DataFrame, passages: DataFrame) -> DataFrame:
    """The ways whose quote no passage of the page holds, but two that follow each other in a record, put together."""
    order = Window.partitionBy("record_id").orderBy("ord", "chunk_id")
    pairs = passages.withColumn("text", F.concat_ws(" ", "text", F.lead("text").over(order))).select("page", "text", "chunk_id")
    quotes = ways.select("page", "quote").distinct()
    open_ = quotes.join(_meet(quotes, passages).select("page", "quote").distinct(), ["page", "quote"], "left_anti")
    return ways.join(_meet(open_, pairs).select("page", "quote").distinct(), ["page", "quote"], "left_semi")


def quota_fit(items: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(category, items, fits, quota): how many items each category has, and how many of its quota they fill."""
    quota = F.coalesce(*[F.when(F.col("category") == c, q) for c, q in quotas.items()], F.lit(0))
    return items.groupBy("category").agg(F.count("*").alias("items")).select("category", "items", F.least("items", quota).alias("fits"), quota.alias("quota"))


def assert_quotas(items: DataFrame, quotas: dict[str, int]) -> None:
    """Raises where a category has fewer items than its quota, or none at all."""
    short = {r.category: r["items"] for r in quota_fit(items, quotas).where("fits < quota").collect()}  # at most one row a category
    known = {r.category for r in items.select("category").distinct().collect()}
    short |= {c: 0 for c, q in quotas.items() if q and c not in known}
    if short:
        raise ValueError(f"too few items for the quotas of {sorted(short)}")


def target_spec(text: str) -> dict[str, int]:
    """'fact=17,howto=12' as quotas."""
    return {k.strip(): int(v) for k, _, v in (part.partition("=") for part in text.split(",") if part.strip())}


def _fill(quotas: dict[str, int]):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left = quotas[pdf["category"].iloc[0]]
        taken = []
        for unit, size in pdf.sort_values(["h", "unit"])[["unit", "size"]].itertuples(index=False):
            if size <= left:
                taken.append(unit)
                left -= size
        return pd.DataFrame({"unit": taken})

    return work


def assign_splits(items: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """(id, category, split): dev takes units of each category in hash order while they fit its quota, test the rest.

    A unit is an item, or all items whose notes share a tag pair:<tag>, in the category of the smallest of them. Only as many units as
    a quota could need (quota + 1 by hash order, and single items to fill a last place) reach the task that fills it, however many items
    a category has. Categories without a quota go to test.
    """
    tag = F.regexp_extract(F.coalesce("notes", F.lit("")), r"pair:([\w.-]+)", 1)
    rows = items.select("id", "category", F.when(tag != "", F.concat(F.lit("pair:"), tag)).otherwise(F.col("id")).alias("unit"))
    units = rows.groupBy("unit").agg(F.count("*").alias("size"), F.min_by("category", "id").alias("category"))
    most = max(quotas.values(), default=0) + 1
    order = Window.partitionBy("category", F.col("size") == 1).orderBy("h", "unit")
    near = units.where(F.col("category").isin(*quotas)).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "unit"))).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    dev = near.select("category", "unit", "size", "h").groupBy("category").applyInPandas(_fill(quotas), "unit string").withColumn("split", F.lit("dev"))
    return rows.join(dev, "unit", "left").select("id", "category", F.coalesce("split", F.lit("test")).alias("split"))
