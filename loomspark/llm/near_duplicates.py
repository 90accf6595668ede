"""Problem 3: groups of near-duplicate records, by a multi-index Hamming join over b-bit min-hash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bucket_join import ROW, candidate_pairs, mix
from loomspark.llm.words import hashed, shingles
from loomspark.operators.components import connected_components
from loomspark.session import written

#: A signature has CHUNKS * CHUNK symbols of 16 bits. With one allowed error in a chunk, two signatures that differ in at most
#: 2 * CHUNKS - 1 = 31 of 64 symbols must agree on some chunk up to one error (pigeonhole), and so share a key.
CHUNKS, CHUNK = 16, 4
SYMBOLS = CHUNKS * CHUNK
#: Sketch of two bits a symbol: at a similarity s, a symbol agrees with probability s + (1 - s) / 4.
_LOW = np.uint64(0x5555555555555555)

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit min-hash symbols, (texts, SYMBOLS); the texts must have a run each."""
    out = np.empty((len(offsets) - 1, SYMBOLS), np.uint16)
    for j, factor in enumerate(_FACTORS):
        low = np.minimum.reduceat((h * factor) >> np.uint64(16), offsets[:-1])
        out[:, j] = mix(low) >> np.uint64(48)
    return out


def keys_of(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(texts, 64) bucket keys: of each chunk, its symbols with one left out, for each that can be the wrong one; within a group."""
    s = symbols.astype(np.uint64).reshape(len(symbols), CHUNKS, CHUNK)
    out = np.empty((len(symbols), CHUNKS, CHUNK), np.uint64)
    for drop in range(CHUNK):
        a, b, c = (s[:, :, i] for i in range(CHUNK) if i != drop)
        packed = (a << np.uint64(32)) | (b << np.uint64(16)) | c
        tag = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(drop + 1)) << np.uint64(48)
        out[:, :, drop] = mix(packed | tag) ^ group[:, None]
    return mix(out.reshape(len(symbols), SYMBOLS))


def _sketch(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = (symbols & np.uint16(3)).astype(np.uint64)
    shift = np.arange(32, dtype=np.uint64) * np.uint64(2)
    half = lambda x: np.bitwise_or.reduce(x << shift, axis=1).view(np.int64)
    return half(two[:, :32]), half(two[:, 32:])


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of 32 two-bit symbols, how many are equal."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return 32 - np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).astype(np.int64)


def _keep(least: int):
    def keep(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = agreements(rows["x1"][i], rows["x1"][j]) + agreements(rows["x2"][i], rows["x2"][j])
        return (rows["id"][i] != rows["id"][j]) & (same >= least)

    return keep


def _key_rows(runs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                flat, at = hashed(part.column("text").to_pylist())
                full = np.diff(at) > 0
                if not full.any():
                    continue
                h, at = shingles(flat, np.r_[at[:-1][full], at[-1]], runs)
                ids = part.column("rep").to_numpy()[full]
                group = part.column("grp").to_numpy()[full].view(np.uint64)
                symbols = signatures(h, at)
                keys = keys_of(symbols, group).view(np.int64)
                x1, x2 = _sketch(symbols)
                wide = lambda x: pa.array(np.repeat(x, SYMBOLS))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.zeros(keys.size, np.int32)), wide(ids), wide(x1), wide(x2)], names=["k", "side", "id", "x1", "x2"])

    return work


def _verified(runs: int, share: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ta, tb = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
                h, at = shingles(*hashed(ta + tb), runs)
                sets = [np.unique(h[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
                n = part.num_rows
                ok = np.zeros(n, bool)
                for k in range(n):
                    a, b = sets[k], sets[n + k]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok[k] = both >= share * (len(a) + len(b) - both)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return work


def classes_of(df: DataFrame, group: str, id: str, text: str) -> DataFrame:
    """(grp, rep, text): one row per different text of a group; rep is its smallest id. Null ids are left out."""
    base = df.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(group), F.lit(""))).alias("grp"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    return base.groupBy("grp", F.md5("text").alias("digest")).agg(F.min("id").alias("rep"), F.first("text").alias("text")).select("grp", "rep", "text")


def near_links(classes: DataFrame, runs: int = 3, share: float = 0.5, slack: float = 3.4) -> DataFrame:
    """(a, b): representatives of one group of which the different runs of `runs` words have a Jaccard similarity of `share` or more.

    Candidates come from the multi-index Hamming join over 64 symbols of 16 bits; a two-bit sketch drops chance collisions
    (a pair at exactly `share` lies `slack` standard deviations above its limit); the exact similarity decides.
    """
    p = share + (1 - share) / 4
    least = int(np.floor(SYMBOLS * p - slack * np.sqrt(SYMBOLS * p * (1 - p))))
    rows = classes.select("grp", "rep", "text").mapInArrow(_key_rows(runs), ROW)
    pairs = candidate_pairs(rows, _keep(least))
    texts = classes.select("rep", "text")
    wide = pairs.join(texts.withColumnsRenamed({"rep": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"rep": "b", "text": "text_b"}), "b")
    return wide.select("a", "b", "text_a", "text_b").mapInArrow(_verified(runs, share), "a long, b long")


def near_duplicate_groups(df: DataFrame, group: str = "index_name", id: str = "id", text: str = "text", runs: int = 3, share: float = 0.5) -> DataFrame:
    """(id, rep, component): for every row with an id its representative (smallest id with the same text in the group) and the
    smallest id of all representatives linked with it.

    Two texts are linked when their different runs of three words have a Jaccard similarity of a half or more; links join transitively.
    Null texts count as empty; empty texts have no runs and stay alone, but for exact copies of each other, which share a representative.
    A text of one or two words counts as one run. Null groups form a group. Repeated ids count once, under their smallest representative.
    Other columns are ignored. No rows give no rows.
    """
    classes = written(classes_of(df, group, id, text))
    links = written(near_links(classes, runs, share))
    components = connected_components(links)
    base = df.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(group), F.lit(""))).alias("grp"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest")).where("id is not null")
    reps = classes.select("grp", F.md5("text").alias("digest"), "rep")
    members = base.join(reps, ["grp", "digest"]).groupBy("id").agg(F.min("rep").alias("rep"))
    return members.join(components.withColumnsRenamed({"node": "rep"}), "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component"))
