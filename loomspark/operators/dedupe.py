"""Deduplication of identical texts across versions, with what differs per occurrence kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import version_key


def contents_of(chunks: DataFrame, embed_text: Column) -> DataFrame:
    """(key, content_hash, kind, text, embed_text, n_tokens, versions, occurrences): one row per different embed text.

    Attributes come from the first occurrence by version (as numbers) and ord; versions are sorted as numbers. One shuffle on the key,
    and only the first row's attributes, not all occurrences, travel beyond the map side. Null texts count as empty.
    """
    order = F.struct(F.coalesce(version_key(F.col("version")), F.array().cast("array<int>")).alias("v"), F.coalesce("ord", F.lit(-1).cast("long")).alias("ord"), "chunk_id")
    rows = chunks.withColumn("embed_text", F.coalesce(embed_text, F.lit(""))).withColumn("key", F.sha2("embed_text", 256))
    grouped = rows.groupBy("key").agg(
        F.min_by(F.struct("content_hash", "kind", "text", "embed_text", "n_tokens"), order).alias("first"),
        F.collect_set("version").alias("seen"),  # at most one entry per version
        F.count("*").alias("occurrences"),
    )
    versions = F.transform(F.array_sort(F.transform("seen", lambda v: F.struct(version_key(v).alias("k"), v.alias("v")))), lambda s: s["v"])
    return grouped.select("key", "first.*", versions.alias("versions"), "occurrences")


def metadata_differs(chunks: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """(key, versions, variants): contents of which the metadata, as a set per version, differ between versions. Metadata are compared as JSON with sorted names."""
    per_version = chunks.withColumn("key", key).groupBy("key", "version").agg(F.array_join(F.array_sort(F.collect_set(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))), ";").alias("meta"))
    return per_version.groupBy("key").agg(F.count("*").alias("versions"), F.countDistinct("meta").alias("variants")).where("variants > 1")
