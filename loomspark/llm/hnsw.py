"""A hierarchical navigable small-world graph over unit vectors, kept as flat neighbour arrays, built and searched by whole batches."""

from __future__ import annotations

import numpy as np

from loomspark.llm.bucket_join import mix

#: Neighbours of a node in an upper and in the lowest layer, and beam widths while building and searching.
M, M0, EF_BUILD, EF_SEARCH = 8, 12, 16, 20
SEED, BATCH = 256, 1024


class Hnsw:
    """x: unit vectors (n, d). Layer l holds the nodes of level l and above; graph[l] is an (n, width) array of node numbers, -1 for none.

    Nodes enter by level, highest first, in batches no larger than the graph so far: a batch is searched for in the graph as it stands,
    meets itself directly, and its links are pruned to diverse neighbours, in both directions.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, n = x, len(x)
        uniform = (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) / (1 << 53)
        level = np.minimum(np.floor(-np.log(np.maximum(uniform, 1e-12)) / np.log(M0)).astype(int), 6) if n else np.empty(0, int)
        self.order = np.argsort(-level, kind="stable")
        top = int(level.max()) if n else 0
        self.graph = [np.full((n, M0 if k == 0 else M), -1, np.int32) for k in range(top + 1)]
        self.entry = self.order[:1]
        for k in range(top, -1, -1):
            self._layer(k, self.order[: int((level >= k).sum())])

    def _layer(self, k: int, nodes: np.ndarray) -> None:
        first = nodes[:SEED]
        self._link(k, first, *self._mutual(first, first, min(len(first), 2 * self.graph[k].shape[1])))
        done = len(first)
        while done < len(nodes):
            batch = nodes[done : done + min(BATCH, done)]
            q = self.x[batch]
            ids, sims = self.beam(q, k, self.descend(q, k, nodes[0]), EF_BUILD)
            own_ids, own_sims = self._mutual(batch, batch, min(len(batch), 8))
            self._link(k, batch, np.concatenate([ids, own_ids], 1), np.concatenate([sims, own_sims], 1))
            done += len(batch)

    def _mutual(self, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        s = self.x[a] @ self.x[b].T
        s[a[:, None] == b[None, :]] = -np.inf
        at = np.argpartition(-s, width - 1, axis=1)[:, :width]
        sims = np.take_along_axis(s, at, 1)
        return np.where(np.isfinite(sims), b[at], -1), sims

    def _select(self, ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates the diverse ones (nearer to the node than to any neighbour taken before), then the nearest of the rest."""
        by = np.argsort(-sims, axis=1, kind="stable")[:, : width + 16]
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        valid = ids >= 0
        v = self.x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        rows, cols = ids.shape
        taken, near, count = np.zeros((rows, cols), bool), np.full((rows, cols), -np.inf, np.float32), np.zeros(rows, int)
        for j in range(cols):
            ok = valid[:, j] & (sims[:, j] > near[:, j]) & (count < width)
            # A repeated candidate is as near to its first copy as can be, and is dropped by the same test.
            taken[:, j] = ok
            near = np.where(ok[:, None], np.maximum(near, between[:, j]), near)
            count += ok
        repeat = np.zeros((rows, cols), bool)
        for j in range(1, cols):
            repeat[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        rank = np.where(valid & ~repeat, np.where(taken, 0, 1), 2)
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        ok = np.take_along_axis(rank, first, 1) < 2
        return np.where(ok, np.take_along_axis(ids, first, 1), -1), np.where(ok, np.take_along_axis(sims, first, 1), -np.inf)

    def _link(self, k: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        graph, width = self.graph[k], self.graph[k].shape[1]
        chosen, chosen_sims = self._select(ids, sims, width)
        graph[nodes, : chosen.shape[1]] = chosen
        to, of, s = chosen.ravel(), np.repeat(nodes, chosen.shape[1]), chosen_sims.ravel()
        to, of, s = to[to >= 0], of[chosen.ravel() >= 0], s[chosen.ravel() >= 0]
        back = ~(graph[to] == of[:, None]).any(1)
        to, of, s = to[back], of[back], s[back]
        if not len(to):
            return
        by = np.lexsort((-s, to))
        to, of, s = to[by], of[by], s[by]
        start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        place = np.arange(len(to)) - np.repeat(start, np.diff(np.r_[start, len(to)]))
        keep = place < width
        target = to[start]
        row = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(to)]))[keep]
        new, new_sims = np.full((len(start), width), -1, np.int64), np.full((len(start), width), -np.inf, np.float32)
        new[row, place[keep]], new_sims[row, place[keep]] = of[keep], s[keep]
        for i in range(0, len(target), BATCH):
            t, old = target[i : i + BATCH], graph[target[i : i + BATCH]]
            old_sims = np.where(old >= 0, np.matmul(self.x[np.maximum(old, 0)], self.x[t][:, :, None])[:, :, 0], -np.inf)
            got, _ = self._select(np.concatenate([old, new[i : i + BATCH]], 1), np.concatenate([old_sims, new_sims[i : i + BATCH]], 1), width)
            graph[t] = got

    def descend(self, q: np.ndarray, k: int, entry: int) -> np.ndarray:
        """Entry points for layer k: from the top layer down, the best node of each."""
        at = np.full((len(q), 1), entry, np.int64)
        for layer in range(len(self.graph) - 1, k, -1):
            at = self.beam(q, layer, at, 4)[0][:, :1]
        return at

    def beam(self, q: np.ndarray, k: int, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of a beam search of width ef in layer k from each query's entry nodes (-1 for none)."""
        graph, n, rows = self.graph[k], len(self.x), len(q)
        width = entry.shape[1]
        ids, sims = np.full((rows, ef), -1, np.int64), np.full((rows, ef), -np.inf, np.float32)
        expanded, seen = np.zeros((rows, ef), bool), np.zeros((rows, n), bool)
        width = min(width, ef)
        ids[:, :width] = entry[:, :width]
        got = ids[:, :width] >= 0
        sims[:, :width] = np.where(got, np.matmul(self.x[np.maximum(ids[:, :width], 0)], q[:, :, None])[:, :, 0], -np.inf)
        r, c = np.nonzero(got)
        seen[r, ids[r, c]] = True
        active = np.arange(rows)
        while len(active):
            score = np.where(expanded[active], -np.inf, sims[active])
            best = score.argmax(1)
            go = score[np.arange(len(active)), best] > -np.inf
            active, best = active[go], best[go]
            if not len(active):
                break
            expanded[active, best] = True
            near = graph[ids[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            a, b = active[r], near[r, c]
            seen[a, b] = True
            sim = np.einsum("ij,ij->i", self.x[b], q[a])
            good = sim > sims.min(1)[a]  # others don't come into the beam
            if not good.any():
                continue
            r, a, b, sim = r[good], a[good], b[good], sim[good]
            # The rows that change, with their new nodes side by side.
            start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            count = np.diff(np.r_[start, len(r)])
            row, width = np.repeat(np.arange(len(start)), count), int(count.max())
            place = np.arange(len(r)) - np.repeat(start, count)
            rows_ = a[start]
            new_ids, new_sims = np.full((len(start), width), -1, np.int64), np.full((len(start), width), -np.inf, np.float32)
            new_ids[row, place], new_sims[row, place] = b, sim
            all_ids, all_sims = np.concatenate([ids[rows_], new_ids], 1), np.concatenate([sims[rows_], new_sims], 1)
            all_expanded = np.concatenate([expanded[rows_], np.zeros((len(start), width), bool)], 1)
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            at = np.arange(len(start))[:, None]
            ids[rows_], sims[rows_], expanded[rows_] = all_ids[at, keep], all_sims[at, keep], all_expanded[at, keep]
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def nearest(self, q: np.ndarray, k: int, own: np.ndarray | None = None, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar nodes of each query, best first (-1 where there are fewer). own: the node that each query is itself, from which its search starts and which is left out."""
        n = len(self.x)
        out_ids, out_sims = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf, np.float32)
        if not n:
            return out_ids, out_sims
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH]
            at = own[i : i + BATCH, None] if own is not None else self.descend(part, 0, self.entry[0])
            ids, sims = self.beam(part, 0, at, max(ef, k + 1))
            if own is not None:
                sims[ids == at] = -np.inf
                by = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
            out_ids[i : i + BATCH] = np.where(np.isfinite(sims[:, :k]), ids[:, :k], -1)
            out_sims[i : i + BATCH] = sims[:, :k]
        return out_ids, out_sims
