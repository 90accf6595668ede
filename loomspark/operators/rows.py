"""Rows of redelivered records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, *key: str, loaded: str = "loaded_at", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per key: the last loaded, with the columns `keep` (all, if none are named; only these are read and moved). Null keys form a key of their own; repeated
    rows with one load time are one of them. An aggregate with map-side combine, so a key that holds a third of all rows is reduced before it moves."""
    rest = [c for c in (df.columns if keep is None else keep) if c not in key]
    time = F.coalesce(F.col(loaded), F.lit("1970-01-01").cast("timestamp"))
    if not rest:
        return df.select(*key).distinct()
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), time).alias("_row"))
    return picked.select(*[c if c in key else F.col("_row")[c].alias(c) for c in (df.columns if keep is None else (*key, *rest))])
