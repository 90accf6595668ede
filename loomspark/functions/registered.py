"""Functions for SQL: registered by name on a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from loomspark.functions import html, sections


@F.pandas_udf(StringType())
def html_to_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.convert(t) if t is not None else None)


@F.pandas_udf(DoubleType())
def weighted_median(values: pd.Series, weights: pd.Series) -> float:
    """A group's value at half of its weight; null for a group without weight. The group lies in one task, so it is for groups of a known size."""
    kept = pd.DataFrame({"v": values, "w": weights}).dropna()
    kept = kept[kept["w"] > 0].sort_values("v", kind="stable")
    if kept.empty:
        return None
    return float(kept["v"].to_numpy()[(kept["w"].cumsum().to_numpy() >= kept["w"].sum() / 2).argmax()])


@F.udtf(returnType="ord int, anchor string, heading_path array<string>, text string, n_tokens int")
class ChunkText:
    """chunk_text(title, text, most, least): the chunks of a page, for LATERAL joins."""

    def eval(self, title: str, text: str, most: int, least: int) -> Iterator[tuple]:
        if text is not None:
            for c in sections.chunk(title or "", text, None, most, least):
                yield c["ord"], c["anchor"], c["heading_path"], c["text"], c["n_tokens"]


def register(spark: SparkSession) -> None:
    spark.udf.register("html_to_markdown", html_to_markdown)
    spark.udf.register("weighted_median", weighted_median)
    spark.udtf.register("chunk_text", ChunkText)
