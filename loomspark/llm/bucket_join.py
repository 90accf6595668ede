"""Pairs of rows that share a bucket key, found in sorted runs inside Arrow batches, with hot buckets spread over block pairs.

Rows reach a task hash-partitioned and sorted by key, as a stream. Runs of equal keys are paired vector-wise: at distance d in
the sorted order, row i meets row i + d while both keys are equal. No run is ever held as a Python list of pairs, and none is
cut short: a run of over HOT rows is not paired where it lies but sent on in blocks, of which every two meet in a task of their own.
The number of blocks grows with the root of the key's rows, which are counted where they lie, so that neither the copies nor a task's block grow in line with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key beyond which its pairs are spread over g * (g + 1) / 2 block pairs; g is GRID at least.
HOT = 4096
GRID = 8


def grid(rows: np.ndarray | int) -> np.ndarray:
    """Blocks of a hot key with so many rows: twice the root of what it has in units of HOT."""
    return np.maximum(GRID, np.ceil(2 * np.sqrt(np.asarray(rows) / HOT))).astype(np.int64)


#: Pairs held before they are reduced to distinct ones.
FLUSH = 1 << 20

ROW = "k long, side int, id long, x1 long, x2 long"
_OUT = pa.schema([("k", pa.int64()), ("role", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())])
_OUT_DDL = "k long, role int, side int, id long, other long, x1 long, x2 long"

Keep = Callable[[dict, np.ndarray, np.ndarray], np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's), so that keys spread over partitions."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


class _Pairs:
    def __init__(self, keep: Keep):
        self.keep, self.a, self.b, self.n = keep, [], [], 0

    def run(self, rows: dict) -> None:
        """All pairs inside runs of equal k; rows are sorted by k."""
        key, n = rows["k"], len(rows["k"])
        at = np.arange(n - 1)
        d = 1
        while len(at):
            at = at[at + d < n]
            at = at[key[at + d] == key[at]]
            if not len(at):
                break
            ok = self.keep(rows, at, at + d)
            i, j = at[ok], at[ok] + d
            a, b = rows["id"][i], rows["id"][j]
            self.a.append(np.minimum(a, b))
            self.b.append(np.maximum(a, b))
            self.n += len(i)
            if self.n > FLUSH:
                self.shrink()
            d += 1

    def shrink(self) -> None:
        a, b = _distinct(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.n = [a], [b], len(a)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        self.shrink()
        a, b = self.a[0], self.b[0]
        self.a, self.b, self.n = [], [], 0
        return a, b


def _columns(batch: pa.RecordBatch) -> dict:
    return {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}


def _emit(**columns: np.ndarray) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.record_batch([pa.array(columns[f.name] if f.name in columns else np.zeros(n, f.type.to_pandas_dtype()), f.type) for f in _OUT], schema=_OUT)


def _pair_rows(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        yield _emit(k=mix(mix(x.view(np.uint64)) ^ y.view(np.uint64)).view(np.int64), id=x, other=y)


def _blocks(rows: dict) -> Iterator[pa.RecordBatch]:
    """Rows of hot keys, sent to every block pair that their block takes part in; role 3 meets its own kind, 1 meets 2."""
    g = grid(rows["n"])
    block = (mix(rows["id"].view(np.uint64)) % g.astype(np.uint64)).astype(np.int64)
    for t in range(int(g.max())):
        some = t < g
        own = block[some]
        low, high = np.minimum(own, t), np.maximum(own, t)
        k = mix(mix(rows["k"][some].view(np.uint64)) ^ (low * g[some] + high + 1).view(np.uint64)).view(np.int64)
        role = np.where(own == t, 3, np.where(own < t, 1, 2)).astype(np.int32)
        yield _emit(k=k, role=role, side=rows["side"][some], id=rows["id"][some], x1=rows["x1"][some], x2=rows["x2"][some])


def _first(keep: Keep) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = _Pairs(keep), None
        for batch in batches:
            rows = _columns(batch)
            if not len(rows["k"]):
                continue
            is_hot = rows["n"] > HOT
            if is_hot.any():
                yield from _blocks({c: v[is_hot] for c, v in rows.items()})
                rows = {c: v[~is_hot] for c, v in rows.items()}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
                held = None
            key = rows["k"]
            if not len(key):
                continue
            open_run = key == key[-1]  # the last run may go on in the next batch
            if not open_run.all():
                pairs.run({c: v[~open_run] for c, v in rows.items()})
            held = {c: v[open_run] for c, v in rows.items()}
            if pairs.n > FLUSH // 2:
                yield from _pair_rows(*pairs.drain())
        if held is not None:
            pairs.run(held)
        yield from _pair_rows(*pairs.drain())

    return work


def _second(keep: Keep) -> Callable:
    def both(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (rows["role"][i] == 3) | (rows["role"][i] != rows["role"][j])
        ok[ok] = keep(rows, i[ok], j[ok])
        return ok

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = _Pairs(both), []

        def gathered() -> None:
            if held:
                pairs.run({c: np.concatenate([h[c] for h in held]) for c in held[0]})
                held.clear()

        for batch in batches:
            rows = _columns(batch)
            is_pair = rows["role"] == 0
            if is_pair.any():
                yield from _pair_rows(rows["id"][is_pair], rows["other"][is_pair])
            if is_pair.all():
                continue
            rows = {c: v[~is_pair] for c, v in rows.items()}
            last = rows["k"] == rows["k"][-1]
            if held and held[0]["k"][0] == rows["k"][0] and last.all():
                held.append(rows)
                continue
            whole = {c: v[~last] for c, v in rows.items()}
            if held:  # the run held ends in this batch
                held.append(whole)
                gathered()
            elif not last.all():
                pairs.run(whole)
            held.append({c: v[last] for c, v in rows.items()})
            if pairs.n > FLUSH // 2:
                yield from _pair_rows(*pairs.drain())
        gathered()
        yield from _pair_rows(*pairs.drain())

    return work


def candidate_pairs(rows: DataFrame, keep: Keep) -> DataFrame:
    """Distinct (a, b), a < b, of ids whose rows share a key and pass keep.

    rows: k long, side int, id long, x1 long, x2 long, without nulls. keep(rows, i, j) gets the columns and two index arrays
    and says which pairs to keep; it must drop pairs of a row with itself where an id can repeat under one key.
    Two shuffles: by key, where the rows of each key are counted too, and by pair (together with the block rows of hot keys); an empty input gives no pairs.
    """
    counted = rows.repartition("k").withColumn("n", F.count("*").over(Window.partitionBy("k")))
    first = counted.sortWithinPartitions("k").mapInArrow(_first(keep), _OUT_DDL)
    second = first.repartition("k").sortWithinPartitions("k").mapInArrow(_second(keep), _OUT_DDL)
    return second.selectExpr("id as a", "other as b").distinct()
