"""Cross-split overlaps (1), near duplicates (3) and the join below both, against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.llm import bucket_join, cross_split, near_duplicates
from loomspark.llm.words import words

WORDS = [f"w{i}" for i in range(60)]
ITEM = "id string, split string, question string, origin string, loaded_at timestamp, k long"


def overlap(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    return sum((x & y).values()) * 100 >= 80 * max(x.total(), y.total()) if x and y else False


def test_words_are_runs_of_letters_or_digits():
    assert words("Éa_b--C3 x") == ["éa", "b", "c3", "x"]
    assert words("A-b_C 9z") == ["a", "b", "c", "9z"]
    assert words(None) == words("") == words("-- _") == []


@pytest.mark.parametrize("sent", [1 << 25, 0])
def test_cross_split_equals_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(cross_split, "SENT_MOST", sent)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        base = rng.sample(WORDS, rng.choice([1, 2, 3, 5, 9, 14]))
        rows.append((f"r{i}", rng.choice(["train", "dev", "test"]), " ".join(base), "o", None, i))
        for j in range(2):
            near = [w for w in base if rng.random() > 0.12] + rng.sample(WORDS, rng.choice([0, 0, 1]))
            rng.shuffle(near)
            rows.append((f"r{i}-{j}", rng.choice(["train", "dev", "test"]), " ".join(near + near[:1] * rng.choice([0, 1])), None, None, i))
    got = cross_split.cross_split_overlaps(spark.createDataFrame(rows, ITEM)).collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == "train" and b[1] in ("dev", "test") and overlap(a[2], b[2])}
    assert {(r.id_train, r.id_eval) for r in got} == want and len(got) == len(want) and len(want) > 50


def test_cross_split_edge_cases(spark):
    rows = [
        ("a", "train", "one two three", "o", None, 0), ("a", "train", "one two three", "o", None, 0), ("b", "dev", "THREE two, one", None, None, 0), ("c", "test", None, "o", None, 0),
        ("d", "dev", "", "o", None, 0), ("e", "other", "one two three", "o", None, 0), (None, "dev", "one two three", "o", None, 0), ("f", "train", None, "o", None, 0), ("g", "dev", "...", "o", None, 0),
        ("h", "test", "x " * 20000, "o", None, 0), ("i", "train", "x " * 19000, "o", None, 0),
    ]
    df = spark.createDataFrame(rows, ITEM)
    got = cross_split.cross_split_overlaps(df).collect()
    assert {(r.id_train, r.id_eval) for r in got} == {("a", "b"), ("i", "h")}
    report = {(r.eval_split, r.eval_origin): (r["items"], r.overlapping_items, r.pairs) for r in cross_split.overlap_report(df).collect()}
    assert report[("dev", None)] == (1, 1, 1) and report[("dev", "o")] == (2, 0, 0)
    assert cross_split.cross_split_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_pairs_and_single_words_lose_nothing(monkeypatch, percent):
    monkeypatch.setattr(cross_split, "PAIRS_MOST", 6)
    rng = random.Random(percent)
    texts = [" ".join(rng.choice(WORDS[:12]) for _ in range(rng.randrange(0, 14))) for _ in range(500)]
    often = np.array([rng.randrange(9) for _ in range(cross_split.COUNT_BUCKETS)])
    index = cross_split._Evaluation(texts[:200], often, percent)
    got = {(a, b) for a, b in zip(*(x.tolist() for x in index.hits(cross_split.records(texts[200:], often))))}
    want = {(a, b) for a, t in enumerate(texts[200:]) for b, e in enumerate(texts[:200]) if cross_split.containment(Counter(words(t)), Counter(words(e)), percent) is not None}
    assert want <= got and len(want) > 5


def test_the_last_loaded_row_counts(spark):
    rows = [("a", "train", "one two three", "o", "2031-01-01"), ("a", "train", "four five", "o", "2031-01-02"), ("b", "dev", "one two three", "o", "2031-01-01"), ("c", "train", "four five", "o", "2031-01-01"), ("c", "dev", "four five", "o", "2031-01-03"), ("d", "test", "one", "o", "2031-01-01"), ("d", "test", None, "o", "2031-01-02"), ("e", "train", "one", "o", "2031-01-01")]
    df = spark.createDataFrame(rows, "id string, split string, question string, origin string, t string").selectExpr("*", "cast(t as timestamp) as loaded_at")
    assert {(r.id_train, r.id_eval) for r in cross_split.cross_split_overlaps(df).collect()} == {("a", "c")}


def brute_groups(rows):
    shingle = {}
    for i, g, t in rows:
        w = words(t)
        shingle[i] = {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, min(len(w), 1)))}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, g, t in rows:
        by.setdefault(g, []).append(i)
    for ids in by.values():
        for a, b in combinations(ids, 2):
            both = len(shingle[a] & shingle[b])
            if both and both * 2 >= len(shingle[a]) + len(shingle[b]) - both:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in parent}


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [out[k], rng.choice(WORDS)]])
    return out


def near_rows(n=30, copies=8):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        base = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(90)]
        for j in range(copies):
            rows.append((len(rows), rng.choice(["p", "q"]), " ".join(edited(rng, base, rng.choice([0, 1, 3, 5]))), f"x{j}"))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "id long, index_name string, text string, rep string")).collect()
    assert {r.id: r.component for r in got} == brute_groups([r[:3] for r in rows])


def test_hot_buckets_are_spread_without_loss(spark, monkeypatch):
    rows = near_rows(3, 60)
    df = spark.createDataFrame(rows, "id long, index_name string, text string, rep string")
    keys = near_duplicates.classes_of(df, "index_name", "id", "text").mapInArrow(near_duplicates._key_rows(3), bucket_join.ROW)
    keep = near_duplicates._keep(20)
    plain = {tuple(r) for r in bucket_join.candidate_pairs(keys, keep).collect()}

    def first(batches):
        bucket_join.HOT = 4
        yield from bucket_join._first(keep)(batches)

    counted = keys.repartition("k").withColumn("n", F.count("*").over(Window.partitionBy("k"))).sortWithinPartitions("k")
    hot = counted.mapInArrow(first, bucket_join._OUT_DDL).repartition("k").sortWithinPartitions("k").mapInArrow(bucket_join._second(keep), bucket_join._OUT_DDL)
    assert {tuple(r) for r in hot.selectExpr("id", "other").collect()} == plain and len(plain) > 100


def test_blocks_of_hot_keys_grow_with_the_root_of_their_rows():
    assert bucket_join.grid(5000) == bucket_join.GRID and 300 <= bucket_join.grid(100_000_000) <= 320


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, "p", None), (2, "p", ""), (3, "p", "only two"), (4, "p", "only two"), (5, "q", "only two"), (6, None, "a b c d"), (7, None, "a b c d"), (8, "p", long), (9, "p", long + " end"), (None, "p", "x y z"), (9, "p", long + " end")]
    df = spark.createDataFrame(rows, "id long, index_name string, text string")
    got = {r.id: r.component for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8}
    assert near_duplicates.near_duplicate_groups(df.limit(0)).count() == 0


def test_signature_guarantee():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, near_duplicates.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:  # any 31 of 64 symbols may differ
        at = rng.choice(near_duplicates.SYMBOLS, 31, replace=False)
        row[at] ^= np.uint16(1) + rng.integers(0, 1000, 31).astype(np.uint16) * np.uint16(2)
    group = np.zeros(200, np.uint64)
    ka, kb = near_duplicates.keys_of(a, group), near_duplicates.keys_of(b, group)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))


@pytest.mark.parametrize("text", ["", "x", "a b", "a b c", "a b c d e"])
def test_shingles_of_short_texts(text):
    from loomspark.llm.words import hashed, shingles

    h, at = shingles(*hashed([text, text]), 3)
    n = len(re.findall(r"\w+", text))
    assert np.diff(at).tolist() == [max(n - 2, min(n, 1))] * 2 and len(h) == at[-1]
