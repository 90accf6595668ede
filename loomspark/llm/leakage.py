"""Problem 9: passages of held-out material inside a corpus, by a Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bucket_join import mix
from loomspark.llm.words import _MEMO
from loomspark.llm.words import words as words_of
from loomspark.session import spread, written

#: A pattern is a window of PATTERN words of a passage, a block its last BLOCK words. Half of a passage of 32 words, one word in ten
#: changed and a remark put in between, still holds such a window whole.
PATTERN, BLOCK = 5, 2
#: A passage counts as leaked when this share of its words stands in the text in order (half, less one changed word in ten) ...
IN_ORDER = 0.45
#: ... and this share in runs of three words, which single phrases in common and frequent words in order don't reach.
IN_RUNS = 0.35
#: Where whole patterns cover less than SEEDED of a passage, or its parts lie farther apart than a window, this share must stand in runs of
#: three that follow each other in order; phrases strewn over a text don't.
SEEDED, ORDERED_RUNS = 0.2, 0.4
#: Words of passages searched for at once (about 70 bytes each in the tables that are sent); more passages are searched for in several rounds over the corpus.
WORDS_A_ROUND = 2_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);|\\[A-Za-z]+|\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_INSIDE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def plain_words(text: str | None) -> list[str]:
    """Words without case, accents, ligatures, invisible characters, tags, entities, commands and link targets."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_INSIDE))
        text = _MARKS.sub("", text)
    if "<" in text or "&" in text or "\\" in text or "](" in text:
        text = _TAG.sub(" ", text)
    return words_of(text)


#: Entries of the shift table, by hash of a block; blocks that share an entry share the smaller shift.
SHIFTS = 1 << 20


def _hashes(words: list[str]) -> np.ndarray:
    get = _MEMO.__getitem__
    return np.fromiter(map(get, words), np.uint64, len(words))


class _Patterns:
    """The windows of `size` words of some passages: the shift table of their blocks, and the patterns sorted by the hash of all their words, as the suffix buckets
    of blocks with shift 0."""

    def __init__(self, size: int, words: np.ndarray, first: np.ndarray, item: np.ndarray, place: np.ndarray):
        """first: where in `words` each pattern begins; item and place: of which passage, and where in it."""
        self.size, self.block = size, min(BLOCK, size)
        self.shift = np.full(SHIFTS, size - self.block + 1, np.uint8)
        for end in range(self.block, size + 1):
            np.minimum.at(self.shift, self._entry(words, first + end), size - end)
        keys = self._key(words, first)
        by = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[by], item[by], place[by]
        self.words = words[first[by][:, None] + np.arange(size)] if len(by) else np.empty((0, size), np.uint64)

    def _entry(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the block that ends before `end`."""
        h = words[end - 1]
        return ((h if self.block == 1 else mix(h + words[end - 2] * np.uint64(3))) % np.uint64(SHIFTS)).astype(np.int64)

    def _key(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        h = np.zeros(len(first), np.uint64)
        for k in range(self.size):
            h = mix(h + words[first + k])
        return h

    def found(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in words, passage, position in it) of all patterns that occur inside of one text."""
        sizes = np.diff(offsets)
        n = np.maximum(sizes - self.size + 1, 0)
        if not n.sum() or not len(self.keys):
            return (np.empty(0, np.int64),) * 3
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
        first = first[self.shift[self._entry(words, first + self.size)] == 0]  # where a block has a shift, no pattern ends
        keys = self._key(words, first)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = np.flatnonzero(high > low)
        n = (high - low)[some]
        at = np.repeat(first[some], n)
        pattern = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
        same = (words[at[:, None] + np.arange(self.size)] == self.words[pattern]).all(1) if len(at) else np.empty(0, bool)  # the comparison, word by word
        return at[same], self.item[pattern[same]], self.place[pattern[same]]


class WuManber:
    """Block shift tables, suffix buckets and direct comparison for all windows of PATTERN words of all passages, and for shorter passages as a whole. The tables are
    flat arrays, made once and sent."""

    def __init__(self, passages: dict[int, list[str]]):
        self.passages = passages
        flat = _hashes([w for words in passages.values() for w in words])
        sizes = np.array([len(w) for w in passages.values()], np.int64)
        offsets = np.cumsum(sizes) - sizes
        items = np.array(list(passages), np.int64)
        self.tables: list[_Patterns] = []
        for size in sorted({min(PATTERN, n) for n in sizes.tolist()} - {0}):
            mine = np.flatnonzero(sizes >= PATTERN if size == PATTERN else sizes == size)
            n = sizes[mine] - size + 1
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.tables.append(_Patterns(size, flat, np.repeat(offsets[mine], n) + place, np.repeat(items[mine], n), place))
        self.bits: dict[int, dict[str, int]] = {}

    def search(self, texts: list[list[str]]) -> list[dict[int, list[tuple[int, int]]]]:
        """Of each text: item -> (position in the passage, position in the text) of every pattern that occurs, in the order of the text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.r_[0, np.cumsum(sizes)]
        words = _hashes([w for t in texts for w in t])
        out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
        for table in self.tables:
            at, items, places = table.found(words, offsets)
            rows = np.searchsorted(offsets, at, "right") - 1
            for row, item, place, start in zip(rows.tolist(), items.tolist(), places.tolist(), (at - offsets[rows]).tolist()):
                out[row].setdefault(item, []).append((place, start))
        return out

    def aligned(self, item: int, window: list[str]) -> float:
        """Share of the passage that is a common subsequence with the window (bit-parallel)."""
        passage = self.passages[item]
        bits = self.bits.get(item)
        if bits is None:
            bits = self.bits[item] = {}
            for i, w in enumerate(passage):
                bits[w] = bits.get(w, 0) | (1 << i)
        full = (1 << len(passage)) - 1
        v = full
        for w in window:
            m = bits.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return (len(passage) - v.bit_count()) / len(passage)

    def in_runs(self, item: int, window: list[str]) -> float:
        passage = self.passages[item]
        runs = set(zip(window, window[1:], window[2:]))
        covered = np.zeros(len(passage), bool)
        for i, run in enumerate(zip(passage, passage[1:], passage[2:])):
            if run in runs:
                covered[i : i + 3] = True
        return covered.mean()

    def in_ordered_runs(self, item: int, window: list[str]) -> float:
        """Share of the passage in the best chain of common runs of three words or more that follow each other in both."""
        passage = self.passages[item]
        at: dict[tuple, list[int]] = defaultdict(list)
        for i, run in enumerate(zip(passage, passage[1:], passage[2:])):
            at[run].append(i)
        best: dict[tuple[int, int], int] = {}
        for j, run in enumerate(zip(window, window[1:], window[2:])):
            for i in at.get(run, ()):
                before = max((v for (q, p), v in best.items() if q + 3 <= j and p + 3 <= i), default=0)
                best[j, i] = max(before + 3, best.get((j - 1, i - 1), 0) + 1)
        return max(best.values(), default=0) / len(passage)

    def leaks(self, words: list[str], found: dict[int, list[tuple[int, int]]] | None = None) -> list[tuple[int, float]]:
        out = []
        for item, hits in (self.search([words])[0] if found is None else found).items():
            n = len(self.passages[item])
            if n < PATTERN:  # a phrase as short as this leaks as a whole only
                out.append((item, 1.0))
                continue
            seeded = len({p + k for p, _ in hits for k in range(PATTERN)}) >= SEEDED * n
            best, reach = 0.0, -1
            for p, at in hits:  # in the order of the text
                if at < reach and best >= 0.5:
                    continue
                around = max(25, n // 2)
                window = words[max(0, at - p - around) : at - p + n + around]
                share = self.aligned(item, window)
                if share > best and share >= IN_ORDER and self.in_runs(item, window) >= IN_RUNS and (seeded or self.in_ordered_runs(item, window) >= ORDERED_RUNS):
                    best = share
                reach = at - p + n
            if not best and len(hits) > 1:  # parts farther apart than a window: from the first seed to the last, with what may stand around them
                first, last = hits[0], hits[-1]
                around = max(25, n // 2)
                window = words[max(0, first[1] - first[0] - around) : last[1] - last[0] + n + around]
                share = self.aligned(item, window)
                if share >= IN_ORDER and self.in_ordered_runs(item, window) >= ORDERED_RUNS:
                    best = share
            if best:
                out.append((item, best))
        return out


def _scan(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [plain_words(t) for t in part.column("text").to_pylist()]
                ids, items, shares = [], [], []
                for doc, words, found in zip(part.column("id").to_pylist(), texts, search.search(texts)):
                    for item, share in search.leaks(words, found) if found else ():
                        ids.append(doc)
                        items.append(item)
                        shares.append(share)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "share"])

    return work


def leaked_passages(docs: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, share): every document that holds at least half of the words of a passage in their order, up to one in ten changed.

    The passages are a stated query set, searched against all texts without a shuffle: their tables are made on the driver from WORDS_A_ROUND words at a time, a
    bound that is checked, and sent. More words take further passes, one after the other, of which the results are written and the tables given up before the next.
    Null and empty texts hold nothing; of passages of fewer than five words only the whole is a case, passages without words are none; null ids of either side are
    left out; repeated passages and documents are searched once per id and give a row each.
    """
    spark = docs.sparkSession
    held = passages.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("t"))
    total = held.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    rounds = max(1, math.ceil(total / WORDS_A_ROUND))
    narrow = spread(docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null"))
    parts = []
    for k in range(rounds):
        mine = held if rounds == 1 else held.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k)
        sent = spark.sparkContext.broadcast(WuManber({r.item: plain_words(r.t) for r in mine.toLocalIterator()}))
        part = narrow.mapInArrow(_scan(sent), "doc_id long, item_id long, share double")
        parts.append(part if rounds == 1 else written(part))
        if rounds > 1:
            sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def leak_report(found: DataFrame, passages: DataFrame, item: str = "item_id") -> DataFrame:
    """Per held-out item: in how many documents it leaked, and the largest share; items without a leak have 0."""
    per = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("largest_share"))
    return passages.select(F.col(item).alias("item_id")).distinct().join(per, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))
