"""Incremental load of an index: what to insert, keep and delete, with stable ids; caches of vectors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync_plan(existing: DataFrame, incoming: DataFrame, key: str = "key", id: str = "id") -> DataFrame:
    """(key, id, action): 'keep' with its old id, 'insert' with a new one after the largest old id in key order, 'delete' with its old id.

    existing: key, id; incoming: key. Repeated keys count once. New ids come from per-range counts, not from one sorted partition: keys
    are ranged by their first two hex digits, and a small table of range sizes gives each range its offset.
    """
    old = existing.groupBy(key).agg(F.min(id).alias("old"))
    new = incoming.select(key).where(F.col(key).isNotNull()).distinct().withColumn("new", F.lit(True))
    both = old.join(new, key, "full_outer")
    fresh = both.where("old is null").withColumn("_range", F.substring(F.md5(key), 1, 2))
    sizes = fresh.groupBy("_range").agg(F.count("*").alias("c"))
    offset = sizes.withColumn("before", F.sum("c").over(Window.orderBy("_range")) - F.col("c")).select("_range", "before")  # 256 rows at most
    last = existing.agg(F.coalesce(F.max(id), F.lit(0)).alias("last"))  # one row
    inserted = fresh.join(F.broadcast(offset), "_range").crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("before") + F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    kept = both.where("old is not null").select(key, F.col("old").alias("id"), F.when(F.col("new"), "keep").otherwise("delete").alias("action"))
    return kept.unionByName(inserted.select(key, F.col("id").cast("long").alias("id"), F.lit("insert").alias("action")))


def sync_stats(plan: DataFrame, occurrences: DataFrame | None = None, key: str = "key") -> DataFrame:
    """(action, contents, and with occurrences(key) how many of them the contents have)."""
    if occurrences is None:
        return plan.groupBy("action").agg(F.count("*").alias("contents"))
    counts = occurrences.groupBy(key).agg(F.count("*").alias("_n"))
    return plan.join(counts, key, "left").groupBy("action").agg(F.count("*").alias("contents"), F.sum(F.coalesce("_n", F.lit(0))).alias("occurrences"))


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Writes rows over the partitions that they belong to, wholesale; other partitions, as of other indexes or versions, are left as they are. A partition is only replaced when its new files are complete."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a temporary view for SQL, as a bulk load stages them."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def surviving(rows: DataFrame, plan: DataFrame, id: str) -> DataFrame:
    """Rows of which the content stays: what a cascade of the deletes leaves."""
    return rows.join(plan.where("action <> 'delete'").select(F.col("id").alias(id)), id, "left_semi")


def cache_split(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found with the last written value, missing) of the wanted keys; the cache is append-only, with a column seq."""
    last = cache.groupBy(key).agg(F.max_by("value", "seq").alias("value"))
    return wanted.join(last, key), wanted.join(last, key, "left_anti")


def apply_snapshot(spark, plan: DataFrame, rows: DataFrame, path: str, key: str = "key") -> str:
    """Writes the rows that stay or are new into a new snapshot folder below path and points CURRENT at it; readers of the old one aren't disturbed."""
    import os
    import uuid

    target = f"{path}/snapshot-{uuid.uuid4().hex}"
    rows.join(plan.where("action <> 'delete'").select(key, "id"), key).write.parquet(target)
    spark.createDataFrame([(target,)], "path string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "CURRENT"))
    return target


def read_snapshot(spark, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/CURRENT").first()[0])
