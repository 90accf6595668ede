"""Where records live: hosts and URLs by version, ids, branches, and counts of tokens."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loomspark.functions.text import version_key


def base_url(version: Column, latest: Column, host: str) -> Column:
    """The canonical host for the newest version, else one that names the version: v1-43.docs.host."""
    return F.when(version == latest, F.lit(f"https://{host}")).otherwise(F.concat(F.lit("https://v"), F.replace(version, F.lit("."), F.lit("-")), F.lit(f".docs.{host}")))


def record_id(version: Column, path: Column) -> Column:
    return F.concat(F.lit("v"), version, F.lit(":"), path)


def chunk_url(base: Column, path: Column, anchor: Column, record_anchor: Column | None = None) -> Column:
    """The page with the anchor of the chunk's first section, else the record's own, else none."""
    own = F.coalesce(F.nullif(anchor, F.lit("")), *([F.nullif(record_anchor, F.lit(""))] if record_anchor is not None else []))
    return F.concat(base, F.regexp_replace(path, "#.*$", ""), F.coalesce(F.concat(F.lit("#"), own), F.lit("")))


def newest(versions: Column) -> Column:
    """The newest of an array of versions, as numbers."""
    return F.element_at(F.array_sort(F.transform(versions, lambda v: F.struct(version_key(v).alias("k"), v.alias("v")))), -1)["v"]


def branches(versions: DataFrame, refs: DataFrame, main: str = "main") -> DataFrame:
    """(version, branch): release-<version> where the repository has it, else the main branch."""
    known = refs.select(F.col("name").alias("branch")).distinct()
    return versions.withColumn("branch", F.concat(F.lit("release-"), "version")).join(known.withColumn("_has", F.lit(True)), "branch", "left").select("version", F.when(F.col("_has"), F.col("branch")).otherwise(main).alias("branch"))


def checked_version(df: DataFrame, expected: Column, found: Column) -> DataFrame:
    """df, of which reading fails at a row whose site says another version than expected."""
    return df.where(F.assert_true(found.eqNullSafe(expected), F.concat(F.lit("expected version "), expected, F.lit(", found "), F.coalesce(found, F.lit("none")))).isNull())


def token_counter(path: str) -> Callable[[Column], Column]:
    """Counts of BPE tokens by a tokenizer file that every executor has; null counts as 0. Needs the tokenizers library."""
    import tokenizers  # noqa: F401  fails here rather than in a worker

    held: list = []

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        import tokenizers

        if not held:
            held.append(tokenizers.Tokenizer.from_file(path))
        return pd.Series([len(e.ids) for e in held[0].encode_batch([t or "" for t in texts], add_special_tokens=False)], dtype="int32")

    return count
