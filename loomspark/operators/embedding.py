"""Embedding of what has no vector yet, with a cache, and the registry of embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name -> function of a list of texts that gives a (texts, dimension) array. Models of one's own are put in by name.
EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


class _Hashes(dict):
    """word -> hash, filled as words come; emptied when it grows large, as a value can always be made again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_bag(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed word hashes summed up, of length 1: deterministic, and needs no model."""
    hashes = _Hashes()

    def embed(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        get = hashes.__getitem__
        h = np.fromiter((x for w in words for x in map(get, w)), np.uint64, sum(map(len, words)))
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        out = np.bincount(row * dim + (h % np.uint64(dim)).astype(np.int64), sign, len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


EMBEDDERS["hashed-64"] = hashed_bag(64)


def embed_texts(df: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """(key, model, embedding) of every row, batch by batch. Null texts count as empty."""
    embed = EMBEDDERS[model]
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = embed([t or "" for t in b.column("t").to_pylist()])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([b.column(key), pa.array([model] * len(x), pa.string()), values], names=[key, "model", "embedding"])

    return df.select(key, F.col(text).alias("t")).mapInArrow(work, f"{key} {kind}, model string, embedding array<float>")


def verified(embedded: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """embedded, after a check that every different key of the contents has a vector of its model's length; raises with the number that lack one."""
    lack = contents.select(key).distinct().join(embedded.where("size(embedding) > 0").select(key), key, "left_anti").count()
    if lack:
        raise ValueError(f"{lack} contents without a vector")
    return embedded


def with_cache(rows: DataFrame, cache: DataFrame, key: str, value: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(value of every row's key, what is new and has to be added to the cache): keys that the append-only cache(key, value, seq) lacks are made, once each; the last write of a key counts."""
    last = cache.groupBy(key).agg(F.max_by(value, "seq").alias(value))
    made = make(rows.dropDuplicates([key]).join(last, key, "left_anti")).select(key, value)
    return rows.join(last.unionByName(made), key), made


def embed_missing(contents: DataFrame, cache: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """(key, model, embedding) for all contents: out of the cache where the model has the key, else made, once per key."""
    wanted = contents.groupBy(key).agg(F.first(text).alias(text))
    known = cache.where(F.col("model") == model).groupBy(key).agg(F.first("embedding").alias("embedding"))
    made = embed_texts(wanted.join(known, key, "left_anti"), key, text, model)
    return wanted.select(key).join(known, key).select(key, F.lit(model).alias("model"), "embedding").unionByName(made)
