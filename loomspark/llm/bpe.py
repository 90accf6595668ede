"""Problem 8: a corpus as token ids of a public byte-level BPE, by a pair occurrence index over the different pieces of a partition."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The white space of Unicode, and the pieces that a byte-level BPE of this family never merges across.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{digit}+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
PIECE = regex.compile(_PIECES.format(letter=r"\p{L}", digit=r"\p{N}", letters=r"\p{L}", digits=r"\p{N}", space=_SPACE))
#: The same for texts of ASCII characters only, where the standard library's faster engine serves.
ASCII_PIECE = re.compile(_PIECES.format(letter="[A-Za-z]", digit="[0-9]", letters="A-Za-z", digits="0-9", space=r"\t-\r "))

#: Pieces remembered by a worker; beyond, the memory is emptied, as it can always be made again.
MEMORY = 500_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte: itself if printable, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBpe:
    """Encodes many pieces at once: all pieces lie in one list of symbols, an index maps each pair's rank to its positions, and ranks are
    applied in ascending order to all their positions; each merge adds the positions of the two new neighbour pairs to the index."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.byte_ids = [0] * 256
        for letter, byte in _byte_letters().items():
            self.byte_ids[byte] = vocab[letter]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.pairs = list(self.rank)
        self.merged = [vocab[a + b] for a, b in merges]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, offsets of each piece)."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        of_byte = self.byte_ids
        sym = [of_byte[x] for x in b"".join(raw)]
        total = len(sym)
        first = np.cumsum([0] + [len(x) for x in raw])
        # Neighbours inside a piece; `total` stands for none, and -1 is a symbol that no pair has.
        nxt, prv = list(range(1, total + 1)), list(range(-1, total - 1))
        for at in first[1:].tolist():
            if at:
                nxt[at - 1] = total
            if at < total:
                prv[at] = total
        if total:
            prv[0] = total
        sym.append(-1)
        rank_of, merged = self.rank.get, self.merged
        index: dict[int, list[int]] = {}
        for at in range(total):
            r = rank_of((sym[at], sym[nxt[at]]))
            if r is not None:
                index.setdefault(r, []).append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (left, right), new = self.pairs[r], merged[r]
            for at in sorted(index.pop(r)):  # from the left, so that aaa gives (aa)a
                after = nxt[at]
                if sym[at] != left or after == total or sym[after] != right:
                    continue
                sym[at], sym[after] = new, -1
                after = nxt[at] = nxt[after]
                if after != total:
                    prv[after] = at
                    q = rank_of((new, sym[after]))
                    if q is not None:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(at)
                before = prv[at]
                if before != total:
                    q = rank_of((sym[before], new))
                    if q is not None:
                        if q not in index:
                            index[q] = []
                            heapq.heappush(active, q)
                        index[q].append(before)
        ids = np.array(sym[:total], np.int32)
        kept = ids >= 0
        offsets = np.r_[0, np.cumsum(kept)][first]
        return ids[kept], offsets.astype(np.int64)


_LOADED: dict[str, PairIndexBpe] = {}


class _Encoder:
    """The different pieces of a worker's texts, encoded once each, by a block of new ones at a time."""

    def __init__(self, path: str):
        if path not in _LOADED:
            _LOADED[path] = PairIndexBpe(path)
        self.bpe = _LOADED[path]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lists = [(ASCII_PIECE if t.isascii() else PIECE).findall(t) if t else [] for t in texts]
        if len(self.number) > MEMORY:
            self.forget()
        new = {p for x in lists for p in x} - self.number.keys()
        if new:
            fresh = sorted(new)
            ids, offsets = self.bpe.encode(fresh)
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.ids = np.concatenate([self.ids, ids])
        counts = np.array([len(x) for x in lists], np.int64)
        get = self.number.__getitem__
        piece = np.fromiter((n for x in lists for n in map(get, x)), np.int64, int(counts.sum()))
        size = self.offsets[piece + 1] - self.offsets[piece]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.offsets[piece], size)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        per_text = np.r_[0, ends][bounds]
        return self.ids[at], per_text


#: Texts whose new pieces are encoded by one pair occurrence index.
TEXTS = 1000


def _encode(path: str, kept: tuple[str, ...]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                ids, offsets = encoder.batch(part.column("text").to_pylist())
                yield pa.record_batch([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), *[part.column(c) for c in kept]], names=["id", "ids", *kept])

    return work


def encode_texts(df: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, and the columns `keep`): the token ids of each text by a byte-level BPE, without special tokens; one row per input row, no shuffle.

    Null and empty texts give an empty list, never null; white space is encoded like any other text; strings of special tokens are
    ordinary text; rows with a null id and repeated rows are kept. `vocabulary` is the path of the tokenizer's JSON file on every executor.
    The different pieces of TEXTS texts that a worker hasn't met yet are encoded together by one index; what it has met it remembers.
    """
    kept = tuple(f"_{c}" for c in keep)
    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    types = "".join(f", _{c} {dict(df.dtypes)[c]}" for c in keep)
    return spread(narrow).mapInArrow(_encode(vocabulary, kept), f"id long, ids array<int>{types}").withColumnsRenamed({"id": "doc_id"} | dict(zip(kept, keep)))


def token_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", by: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per source: texts, texts without tokens, tokens, most tokens of a text. The source comes along with the scan, so nothing is joined and repeated ids count as often as they occur."""
    encoded = encode_texts(docs, id, text, vocabulary, (by,)).select(by, F.size("ids").alias("n"))
    return encoded.groupBy(by).agg(F.count("*").alias("texts"), F.sum(F.expr("int(n = 0)")).alias("without_tokens"), F.sum("n").alias("tokens"), F.max("n").alias("most_tokens"))
