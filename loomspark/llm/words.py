"""Words of texts as 64-bit hashes in flat numpy arrays. A word is a longest run of letters or digits, lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


class _Memo(dict):
    """word -> hash, filled as words come; emptied when it grows large, as a value can always be made again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MEMO = _Memo()


#: For ASCII texts: letters in lower case, digits as they are, all else a blank.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return text.encode("ascii").translate(_ASCII).decode("ascii").split() if text.isascii() else WORD.findall(text.lower())


def hashed(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after the other, offsets of each text, one more than texts)."""
    lists = [words(t) for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    get = _MEMO.__getitem__
    flat = np.fromiter((h for x in lists for h in map(get, x)), np.uint64, int(offsets[-1]))
    return flat, offsets


def shingles(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of n words, offsets). A text of 1 to n - 1 words has one run of all its words; an empty text none."""
    counts = np.diff(offsets)
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.zeros(len(out_counts) + 1, np.int64)
    np.cumsum(out_counts, out=out[1:])
    if not out[-1]:
        return np.empty(0, np.uint64), out
    at = np.arange(out[-1]) - np.repeat(out[:-1], out_counts) + np.repeat(offsets[:-1], out_counts)
    end = np.repeat(offsets[1:], out_counts)
    h = np.zeros(out[-1], np.uint64)
    for k in range(n):
        inside = at + k < end
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, flat[np.minimum(at + k, len(flat) - 1)], np.uint64(0))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, out
