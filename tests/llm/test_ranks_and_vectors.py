"""Rank aggregation (4) and most similar vectors (7)."""

import math
import random

import numpy as np
import pytest

from loomspark.llm import rank_aggregation, vectors
from loomspark.llm.hnsw import Hnsw

HIT = "question_id string, config_id int, content_id long, score double, loaded_at timestamp, rank int"
CONFIG = "config_id int, score_kind string"


def brute(rows, kinds):
    by = {}
    for q, c, i, s, *_ in rows:
        if None not in (q, c, i, s) and s == s and c in kinds:
            by.setdefault(q, {}).setdefault(c, {})[i] = -s if kinds[c] == "distance" else s
    out = {}
    for q, lists in by.items():
        contents, n = {i for x in lists.values() for i in x}, len(lists)
        scored = []
        for i in contents:
            ranks = sorted(sum(v > x[i] for v in x.values()) + (sum(v == x[i] for v in x.values()) + 1) / 2 for x in lists.values() if i in x)
            m = len(contents)
            rho = min(sum(math.comb(n, j) * (r / m) ** j * (1 - r / m) ** (n - j) for j in range(k, n + 1)) for k, r in enumerate(ranks, 1))
            scored.append((round(min(1, rho * n), 12), -len(ranks), round((sum(ranks) + (n - len(ranks)) * m) / (n * m), 12), i))
        out[q] = min(scored)[3]
    return out


def hits(seed=1):
    rng = random.Random(seed)
    rows = []
    for q in range(40):
        for c in rng.sample(range(1, 6), rng.choice([1, 3, 5])):
            for i in rng.sample(range(12), rng.choice([1, 4, 8])):
                score = rng.choice([0.1, 0.2, 0.3, rng.random()]) * 10**c
                rows += [(f"q{q}", c, i, score, None, 0)] * rng.choice([1, 1, 2])
    return rows


KINDS = {1: "similarity", 2: "distance", 3: "similarity", 4: "distance", 5: "similarity"}


def test_first_places_equal_brute_force(spark, monkeypatch):
    rows = hits()
    configs = spark.createDataFrame(list(KINDS.items()), CONFIG)
    df = spark.createDataFrame(rows, HIT)
    want = brute(rows, KINDS)
    assert {r.question_id: r.content_id for r in rank_aggregation.first_places(df, configs).collect()} == want
    monkeypatch.setattr(rank_aggregation, "QUESTION_ROWS", 1)
    assert {r.question_id: r.content_id for r in rank_aggregation.first_places(df, configs).collect()} == want


def test_more_lists_than_factorials(spark, monkeypatch):
    rng = random.Random(4)
    kinds = {c: rng.choice(["similarity", "distance"]) for c in range(1, 26)}
    rows = [(f"q{q}", c, i, rng.choice([0.5, rng.random()]), None, 0) for q in range(6) for c in rng.sample(range(1, 26), rng.choice([1, 22, 25])) for i in rng.sample(range(9), 6)]
    configs, df = spark.createDataFrame(list(kinds.items()), CONFIG), spark.createDataFrame(rows, HIT)
    assert {r.question_id: r.content_id for r in rank_aggregation.first_places(df, configs).collect()} == brute(rows, kinds)
    few = spark.createDataFrame(list(KINDS.items()), CONFIG)
    want = rank_aggregation.aggregate_ranks(spark.createDataFrame(hits(), HIT), few).collect()
    monkeypatch.setattr(rank_aggregation, "FACTORIALS", 2)
    got = rank_aggregation.aggregate_ranks(spark.createDataFrame(hits(), HIT), few).collect()
    key = lambda r: (r.question_id, r.content_id)
    assert all(key(a) == key(b) and abs(a.significance - b.significance) < 1e-9 for a, b in zip(sorted(want, key=key), sorted(got, key=key)))


def test_one_wide_scale_does_not_dominate(spark):
    rows = [("q", 1, 1, 0.9, None, 0), ("q", 1, 2, 0.8, None, 0), ("q", 2, 1, 0.5, None, 0), ("q", 2, 2, 0.4, None, 0), ("q", 3, 2, 9e9, None, 0), ("q", 3, 1, 8e9, None, 0)]
    configs = spark.createDataFrame([(1, "similarity"), (2, "similarity"), (3, "similarity")], CONFIG)
    assert rank_aggregation.first_places(spark.createDataFrame(rows, HIT), configs).first().content_id == 1


def test_rank_edge_cases(spark):
    nan = float("nan")
    rows = [("q", 1, 1, None, None, 0), ("q", 1, 2, nan, None, 0), ("r", 1, 5, 0.5, None, 0), ("r", 1, 4, 0.5, None, 0), (None, 1, 1, 0.5, None, 0), ("s", 9, 1, 0.5, None, 0), ("t", None, 1, 0.5, None, 0), ("u", 2, 1, 3.0, None, 0), ("u", 2, 2, 1.0, None, 0)]
    configs = spark.createDataFrame([(1, "similarity"), (2, "distance"), (None, "distance")], CONFIG)
    df = spark.createDataFrame(rows, HIT)
    assert {r.question_id: r.content_id for r in rank_aggregation.first_places(df, configs).collect()} == {"r": 4, "u": 2}
    assert rank_aggregation.first_places(df.limit(0), configs).count() == 0
    assert [r.place for r in rank_aggregation.ranking(df, configs).where("question_id = 'r'").orderBy("place").collect()] == [1, 2]


def test_ranking_has_every_place(spark, monkeypatch):
    rows = hits(2)
    configs = spark.createDataFrame(list(KINDS.items()), CONFIG)
    df = spark.createDataFrame(rows, HIT)
    want = {(q, i) for q, c, i, *_ in rows if c in KINDS}
    whole = {(r.question_id, r.content_id): r.place for r in rank_aggregation.ranking(df, configs).collect()}
    assert set(whole) == want and max(whole.values()) > 10
    for q in {q for q, _ in want}:
        assert sorted(p for (x, _), p in whole.items() if x == q) == list(range(1, 1 + sum(x == q for x, _ in want)))
    assert {key for key, p in whole.items() if p == 1} == set(brute(rows, KINDS).items())
    monkeypatch.setattr(rank_aggregation, "QUESTION_ROWS", 3)
    assert {(r.question_id, r.content_id): r.place for r in rank_aggregation.ranking(df, configs).collect()} == whole
    assert {(r.question_id, r.content_id): r.place for r in rank_aggregation.ranking(df, configs, 2).collect()} == {key: p for key, p in whole.items() if p <= 2}


def clusters(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, d))
    return (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


def top(x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("n", [1, 2, 7, 300, 3000])
def test_graph_recall(n):
    x = clusters(max(n, 12), 32)[:n]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, sims = Hnsw(x, np.arange(n)).nearest(x, 5, np.arange(n))
    want = top(x)
    assert all(i not in row for i, row in enumerate(got.tolist())) and (np.diff(sims, axis=1)[np.isfinite(np.diff(sims, axis=1))] <= 1e-6).all()
    assert np.mean([len(set(a) & set(b)) / max(1, min(5, n - 1)) for a, b in zip(got, want)]) > 0.95 or n == 1
    others, _ = Hnsw(x, np.arange(n)).nearest(x, 1)
    assert (np.einsum("ij,ij->i", x[others[:, 0]], x) > 0.999).mean() > 0.95


@pytest.mark.parametrize("most", [12_000, 40])
def test_recall_over_shards(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "CELL_MOST", most)
    monkeypatch.setattr(vectors, "CELL", 100)
    x = clusters(900, 24, 3)
    rows = [("m", i, v.tolist(), None, 0) for i, v in enumerate(x)]
    got = vectors.most_similar(spark.createDataFrame(rows, "model string, content_id long, embedding array<float>, loaded_at timestamp, sim int")).collect()
    mine = {(r.id, r.neighbour) for r in got}
    want = {(i, j) for i, row in enumerate(top(x).tolist()) for j in row}
    assert len(mine & want) / len(want) > 0.95 and len(got) == 900 * 5


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("m", 1, [1.0, 0.0], None), ("m", 1, [1.0, 0.0], None), ("m", 2, [2.0, 0.1], None), ("m", 3, None, None), ("m", 4, [], None), ("m", 5, [0.0, 0.0], None), ("m", 6, [nan, 1.0], None), ("m", 7, [inf, 1.0], None), ("m", 8, [1.0], None),
        ("m", None, [1.0, 1.0], None), (None, 9, [1.0, 1.0], None), ("n", 1, [1.0, 2.0, 3.0], None), ("n", 2, [1.0, 2.0, 3.0], None), ("n", 3, [1.0, 2.0, 3.0], None), ("alone", 1, [1.0], None),
    ]
    df = spark.createDataFrame(rows, "model string, content_id long, embedding array<float>, loaded_at timestamp")
    got = {(r.model, r.id, r.neighbour) for r in vectors.most_similar(df).collect()}
    assert got == {("m", 1, 2), ("m", 2, 1)} | {("n", a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert vectors.most_similar(df.limit(0)).count() == 0


def test_recall_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 60)
    monkeypatch.setattr(vectors, "CELL_MOST", 600)
    x = np.random.default_rng(5).normal(size=(1500, 48)).astype(np.float32)  # 25 centres
    got = vectors.most_similar(spark.createDataFrame([("m", i, v.tolist()) for i, v in enumerate(x)], "model string, content_id long, embedding array<float>")).collect()
    mine = {(r.id, r.neighbour) for r in got}
    want = {(i, j) for i, row in enumerate(top(x).tolist()) for j in row}
    assert len(mine & want) / len(want) > 0.95 and len(got) == 1500 * 5


def test_centres_in_two_levels_find_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = vectors.Centres.fit(x, 1500)
    assert 1400 <= len(c) <= 1500 and len(c.tops) > 30
    got, exact = c.nearest(x[:400], 3), vectors.Centres(c.leaves).nearest(x[:400], 3)
    assert np.mean([len(set(a) & set(b)) / 3 for a, b in zip(got.tolist(), exact.tolist())]) > 0.85
    assert (np.diff(np.take_along_axis(x[:400] @ c.leaves.T, got, 1), axis=1) <= 1e-6).all()
