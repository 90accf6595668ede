"""Problem 7: the k most similar vectors for every vector, by navigable small-world graphs of shards whose results are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.bucket_join import mix
from loomspark.llm.hnsw import BATCH, EF_SEARCH, Hnsw
from loomspark.session import written

#: Vectors a shard should hold (each vector lies in PROBES shards or more), the most a shard may hold before it is split, and the most centres, which are sent (25 MB of 96 numbers each).
#: Up to CENTRES_MOST * CELL_MOST / PROBES, about a billion vectors of a model, shards grow from CELL to CELL_MOST and the work in line with the vectors.
CELL, CELL_MOST, CENTRES_MOST = 800, 48_000, 1 << 16
#: Centres that are compared one by one; more are found by way of centres of centres.
FLAT = 1024
#: A vector's search of so many vectors of a model costs about as much as that of one more shard of its own.
EVERYWHERE = 8000
#: Shards that a vector belongs to, those of its nearest centres: at least PROBES, and as many as bring TARGET of a query sample's true
#: neighbours into a common shard, up to PROBES_MOST. Vectors that need more don't cluster; they are spread by hash and all shards searched.
PROBES, PROBES_MOST, TARGET = 3, 12, 0.98
#: Vectors of a model, and of a shard, whose exact neighbours tell the recall; the widest beam tried before a shard is searched exactly.
PROBED, CHECKED, EF_MOST = 200, 64, 80
#: Vectors of a model that the centres are fitted on: SAMPLE, or as many as SAMPLE_EACH times the centres if these are more (at most 8 * 65,536, 200 MB on the driver).
SAMPLE, SAMPLE_EACH = 20_000, 8
_UNIT = "model string, id long, v binary"


def _unit(dims):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, ids, column = batch.column("model").to_pylist(), batch.column("id").to_numpy(), batch.column("embedding")
            sizes = column.value_lengths().fill_null(0).to_numpy()
            want = np.array([dims.value.get(m, -1) for m in models])
            out: tuple[list, list, list] = ([], [], [])
            for size in np.unique(want[want > 0]).tolist():
                at = np.flatnonzero((sizes == size) & (want == size))
                if not len(at):
                    continue
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                    x = (x / norm[:, None]).astype(np.float32)
                ok = np.isfinite(norm) & (norm > 0) & np.isfinite(x).all(1)
                out[0].extend(models[i] for i in at[ok])
                out[1].extend(ids[at[ok]].tolist())
                out[2].extend(row.tobytes() for row in x[ok])
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["model", "id", "v"])

    return work


def unit_vectors(df: DataFrame, id: str, embedding: str, model: str | None) -> DataFrame:
    """(model, id, v): one vector of length 1 per model and id, as float32 bytes. The last loaded counts; null, zero and not finite vectors and
    those not of their model's length, which is the most frequent one, take no part; nor do null ids or models."""
    name = F.col(model).cast("string") if model else F.lit("all")
    loaded = F.coalesce(F.col("loaded_at").cast("long"), F.lit(-1)) if "loaded_at" in df.columns else F.lit(0).cast("long")
    rows = df.where(F.col(id).isNotNull()).select(name.alias("model"), F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("embedding"), loaded.alias("t")).where("model is not null")
    one = rows.groupBy("model", "id").agg(F.max_by("embedding", "t").alias("embedding"))
    sizes = rows.where("size(embedding) > 0").groupBy("model", F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    dims = {r.model: r.d for r in sizes.groupBy("model").agg(F.max_by("d", F.struct("n", "d")).alias("d")).collect()}  # one row per model
    return one.where("embedding is not null").mapInArrow(_unit(df.sparkSession.sparkContext.broadcast(dims)), _UNIT)


def _centres(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, begun at evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        by = np.argsort(near, kind="stable")
        start = np.flatnonzero(np.r_[True, near[by][1:] != near[by][:-1]])
        c[near[by][start]] = np.add.reduceat(x[by], start)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Centres:
    """Unit vectors, of which the nearest ones are looked up: all of them, or the children of the nearest `tops`, whose leaves lie one after the other."""

    def __init__(self, leaves: np.ndarray, tops: np.ndarray | None = None, offsets: np.ndarray | None = None):
        self.leaves, self.tops, self.offsets = leaves, leaves[:0] if tops is None else tops, offsets

    def __len__(self) -> int:
        return len(self.leaves)

    @staticmethod
    def fit(x: np.ndarray, count: int) -> Centres:
        """k-means; for more than FLAT centres in two levels: of the vectors, and of the vectors of each of the first ones."""
        if count <= FLAT:
            return Centres(_centres(x, count))
        tops = _centres(x, int(np.sqrt(count)))
        near = np.concatenate([(x[i : i + 4096] @ tops.T).argmax(1) for i in range(0, len(x), 4096)])
        parts = [_centres(x[near == t], max(1, int(count * (near == t).mean()))) if (near == t).any() else tops[t : t + 1] for t in range(len(tops))]
        return Centres(np.concatenate(parts), tops, np.r_[0, np.cumsum([len(p) for p in parts])])

    def nearest(self, x: np.ndarray, width: int) -> np.ndarray:
        """(vectors, width) numbers of the nearest leaves, best first."""
        if not len(self.tops):
            out = [_best(x[i : i + 4096] @ self.leaves.T, width) for i in range(0, len(x), 4096)]
            return np.concatenate(out) if out else np.empty((0, width), np.int64)
        looked = min(len(self.tops), 8 + width)
        branches = np.concatenate([_best(x[i : i + 4096] @ self.tops.T, looked) for i in range(0, len(x), 4096)]) if len(x) else np.empty((0, looked), np.int64)
        best, sims = np.full((len(x), width), -1, np.int64), np.full((len(x), width), -np.inf, np.float32)
        for t in np.unique(branches):  # the vectors that look into a branch, with its leaves
            rows = np.flatnonzero((branches == t).any(1))
            low, high = self.offsets[t], self.offsets[t + 1]
            s = x[rows] @ self.leaves[low:high].T
            k = min(width, high - low)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            all_ids = np.concatenate([best[rows], at + low], 1)
            all_sims = np.concatenate([sims[rows], np.take_along_axis(s, at, 1)], 1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            best[rows], sims[rows] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
        return np.take_along_axis(best, np.argsort(-sims, axis=1, kind="stable"), 1)


def _best(s: np.ndarray, width: int) -> np.ndarray:
    at = np.argpartition(-s, width - 1, axis=1)[:, :width]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)


def _needs(asked, centres, k: int):
    """Rows (model, a, sim, probes): for every asked vector its k most similar ones of a batch, exactly, and the number of nearest cells at which
    the two first share one (PROBES_MOST + 1 if they don't by then)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, ids, raw = np.array(batch.column("model").to_pylist(), object), batch.column("id").to_numpy(), batch.column("v")
            for m in dict.fromkeys(models.tolist()):
                if m not in asked.value:
                    continue
                own, q = asked.value[m]
                at = np.flatnonzero(models == m)
                x = np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), np.float32).reshape(len(at), -1)
                s = q @ x.T
                s[own[:, None] == ids[at][None, :]] = -np.inf
                near = np.argpartition(-s, min(k, len(at)) - 1, axis=1)[:, :k]
                sims = np.take_along_axis(s, near, 1)
                c = centres[m]
                width = min(PROBES_MOST, len(c))
                a, b = c.nearest(q, width), c.nearest(x[near.ravel()], width).reshape(len(q), -1, width)
                place = np.maximum(np.arange(width)[:, None], np.arange(width)[None, :]) + 1
                need = np.where(a[:, None, :, None] == b[:, :, None, :], place, PROBES_MOST + 1).min((2, 3))
                r, col = np.nonzero(np.isfinite(sims))
                yield pa.record_batch([pa.array([m] * len(r), pa.string()), pa.array(own[r]), pa.array(sims[r, col].astype(float)), pa.array(need[r, col].astype(np.int32))], names=["model", "a", "sim", "probes"])

    return work


def _placed(rows: DataFrame, picked: dict[str, np.ndarray], ids: dict[str, np.ndarray], centres: dict[str, Centres], counts: dict[str, int], k: int) -> dict[str, tuple[Centres, int]]:
    """model -> its centres and the shards a vector belongs to, by the recall measured on PROBED vectors against all; one centre where every shard is to be searched."""
    spark = rows.sparkSession
    asked = {}
    for m, c in centres.items():
        if len(c) > PROBES:
            at = np.unique(np.linspace(0, len(picked[m]) - 1, PROBED).astype(int))
            asked[m] = (ids[m][at], picked[m][at])
    out = {m: (c, PROBES) for m, c in centres.items()}
    if not asked:
        return out
    best = Window.partitionBy("model", "a").orderBy(F.col("sim").desc(), "probes")
    needs = rows.mapInArrow(_needs(spark.sparkContext.broadcast(asked), {m: centres[m] for m in asked}, k), "model string, a long, sim double, probes int")
    measured: dict[str, list] = {m: [] for m in asked}
    for r in needs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("model", "probes").collect():  # PROBED * k rows a model
        measured[r.model].append(r.probes)
    for m, need in measured.items():
        enough = [p for p in range(PROBES, min(PROBES_MOST, len(centres[m])) + 1) if np.mean(np.array(need) <= p) >= TARGET]
        everywhere = -(-counts[m] // EVERYWHERE)
        out[m] = (centres[m], enough[0]) if enough and enough[0] <= max(PROBES, everywhere) else (Centres(centres[m].leaves[:1]), 1)
    return out


def _cells(centres, subs):
    """Rows (model, cell, sub, part, role, id, v): a vector in as many nearest cells as its model needs. A cell of several sub-shards holds it in one of them and
    searches the others for it; as these guests may be many, they come in parts, each with its copy of the sub-shard. role: 2 held and searched for, 1 held only, 0 guest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = subs.value if subs is not None else None
        for batch in batches:
            models, ids, raw = np.array(batch.column("model").to_pylist(), object), batch.column("id").to_numpy(), batch.column("v")
            for m in dict.fromkeys(models.tolist()):
                at = np.flatnonzero(models == m)
                c, probes = centres.value[m]
                values = raw.take(pa.array(at))
                x = np.frombuffer(b"".join(values.to_pylist()), np.float32).reshape(len(at), -1)
                width = min(probes, len(c))
                cell = c.nearest(x, width).astype(np.int64)
                row, cell = np.repeat(np.arange(len(at)), width), cell.ravel()
                if split is None:
                    yield pa.record_batch([pa.array([m] * len(cell), pa.string()), pa.array(cell)], names=["model", "cell"])
                    continue
                shards = np.array([split.get((m, k), 1) for k in cell.tolist()])
                parts = -(-shards // 6)
                home = (mix(ids[at][row].view(np.uint64)) % shards.astype(np.uint64)).astype(np.int64)
                guest_part = (mix(ids[at][row].view(np.uint64) ^ np.uint64(0xABCDEF)) % parts.astype(np.uint64)).astype(np.int64)
                copies = shards * parts
                rep = np.repeat(np.arange(len(row)), copies)
                each = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
                sub, part = each // parts[rep], each % parts[rep]
                held = home[rep] == sub
                wanted = held | (part == guest_part[rep])
                rep, sub, part, held = rep[wanted], sub[wanted], part[wanted], held[wanted]
                role = np.where(held, np.where(part == 0, 2, 1), 0).astype(np.int32)
                for i in range(0, len(rep), 20_000):
                    r = rep[i : i + 20_000]
                    yield pa.record_batch([pa.array([m] * len(r), pa.string()), pa.array(cell[r]), pa.array(sub[i : i + 20_000]), pa.array(part[i : i + 20_000]), pa.array(role[i : i + 20_000]), pa.array(ids[at][row[r]]), values.take(pa.array(row[r]))], names=["model", "cell", "sub", "part", "role", "id", "v"])

    return work


def _exact(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar rows of x for each query, best first (-1 where there are fewer), without the row own that a query is itself."""
    ids, sims = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf, np.float32)
    width = min(k, len(x))
    for i in range(0, len(q), BATCH):
        s = q[i : i + BATCH] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + BATCH]] = -np.inf
        at = np.argpartition(-s, width - 1, axis=1)[:, :width]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)
        got = np.take_along_axis(s, at, 1)
        ids[i : i + BATCH, :width], sims[i : i + BATCH, :width] = np.where(np.isfinite(got), at, -1), got
    return ids, sims


def _nearest(graph: Hnsw, q: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The graph's answer if TARGET of the true neighbours of CHECKED queries are in it, else that of a wider beam, else the exact one."""
    near, sims = graph.nearest(q, k, own)
    at = np.unique(np.linspace(0, len(q) - 1, CHECKED).astype(int)) if len(q) else np.empty(0, int)
    mine = own[at] if own is not None else None
    true = _exact(graph.x, q[at], k, mine)[1]
    held = np.isfinite(true)
    missed = lambda got: (held & (got < true - 1e-6)).sum() > (1 - TARGET) * held.sum()
    if not missed(sims[at]):
        return near, sims
    ef = 2 * EF_SEARCH
    while ef <= EF_MOST and missed(graph.nearest(q[at], k, mine, ef)[1]):
        ef *= 2
    return graph.nearest(q, k, own, ef) if ef <= EF_MOST else _exact(graph.x, q, k, own)


def _search(k: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")  # the same graph whatever order the shuffle brought
        x = np.frombuffer(b"".join(pdf["v"].tolist()), np.float32).reshape(len(pdf), -1)
        ids, role = pdf["id"].to_numpy(), pdf["role"].to_numpy()
        members, asked, guests = np.flatnonzero(role > 0), np.flatnonzero(role[role > 0] == 2), np.flatnonzero(role == 0)
        graph = Hnsw(np.ascontiguousarray(x[members]), ids[members])
        near, sims = _nearest(graph, graph.x[asked], k, asked)
        a = [np.repeat(ids[members][asked], k)]
        b, s = [near.ravel()], [sims.ravel()]
        if len(guests) and len(members):
            near, sims = _nearest(graph, x[guests], k, None)
            a.append(np.repeat(ids[guests], k))
            b.append(near.ravel())
            s.append(sims.ravel())
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        ok = b >= 0
        return pd.DataFrame({"model": pdf["model"].iloc[0], "a": a[ok], "b": ids[members][b[ok]], "sim": s[ok].astype(float)})

    return work


def most_similar(df: DataFrame, id: str = "content_id", embedding: str = "embedding", model: str | None = "model", k: int = 5) -> DataFrame:
    """(model, id, neighbour, place, similarity): for every vector the k most similar ones (cosine) of the same model, approximately.

    Centres are fitted on a bounded sample of a model's vectors; every vector is indexed in the shards of its nearest centres, each
    shard builds a graph and searches it for all of its vectors, and the shards' results are merged. How many centres, and how wide a beam, follows
    from the recall measured on vectors whose exact neighbours are known; a model that doesn't cluster has shards by hash, which are all searched. A shard with more than CELL_MOST vectors,
    as of one huge group of copies, is split into sub-shards, which are all searched. Ties go to the smaller id; a vector isn't its own neighbour; copies are neighbours.
    """
    spark = df.sparkSession
    rows = written(unit_vectors(df, id, embedding, model))
    counts = {r.model: r.n for r in rows.groupBy("model").agg(F.count("*").alias("n")).collect()}  # one row per model
    share = F.create_map(*[v for m, n in counts.items() for v in (F.lit(m), F.lit(min(1.0, max(SAMPLE, SAMPLE_EACH * min(n // CELL, CENTRES_MOST)) / n)))]) if counts else None
    centres, vectors_of, ids_of = {}, {}, {}
    if counts:
        sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("model")])
        picked: dict[str, list] = {m: [] for m in counts}
        for r in sample.orderBy("model", "id").toLocalIterator():  # as many rows a model as the sample's bound, give or take the hash
            picked[r.model].append((r.id, np.frombuffer(r.v, np.float32)))
        for m, vectors in picked.items():
            if not vectors:  # a hash that picks none of a handful
                vectors = [(r.id, np.frombuffer(r.v, np.float32)) for r in rows.where(F.col("model") == m).orderBy("id").limit(100).collect()]
            x = vectors_of[m] = np.array([v for _, v in vectors])
            ids_of[m] = np.array([i for i, _ in vectors], np.int64)
            centres[m] = Centres.fit(x, max(1, min(len(x) // 4, counts[m] // CELL, CENTRES_MOST)))
    sent = spark.sparkContext.broadcast(_placed(rows, vectors_of, ids_of, centres, counts, k))
    # A model that is searched everywhere has shards by hash, small enough for many tasks; of others only cells that grew too large are split.
    limit = {m: CELL_MOST if len(c) > 1 else min(CELL_MOST, EVERYWHERE * 3 // 2) for m, (c, _) in sent.value.items()}
    sizes = rows.mapInArrow(_cells(sent, None), "model string, cell long").groupBy("model", "cell").agg(F.count("*").alias("n")).where(F.col("n") > min(limit.values(), default=0))
    subs = {(r.model, r.cell): -(-r.n // (limit[r.model] * 2 // 3)) for r in sizes.collect() if r.n > limit[r.model]}  # at most CENTRES_MOST a model
    shards = rows.mapInArrow(_cells(sent, spark.sparkContext.broadcast(subs)), "model string, cell long, sub long, part long, role int, id long, v binary")
    found = shards.groupBy("model", "cell", "sub", "part").applyInPandas(_search(k), "model string, a long, b long, sim double")
    pairs = found.where("a <> b").repartition("model", "a").groupBy("model", "a", "b").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("model", "a").orderBy(F.col("sim").desc(), "b")
    return pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("model", F.col("a").alias("id"), F.col("b").alias("neighbour"), "place", F.col("sim").alias("similarity"))
