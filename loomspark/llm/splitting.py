"""Problem 2: cutting oversized items at natural boundaries into balanced pieces with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import spread

LIMIT, OVERLAP = 300, 30
#: Strength of a cut before a word: the name is what ends or begins there.
STRENGTH = {"section": 6, "code_block": 5, "paragraph": 4, "list_item": 3, "line": 2, "sentence": 1, "word": 0}
_WORD = re.compile(r"\S+")
_HEADING = re.compile(r"[ ]{0,3}#{1,6}[ ]|={2,6}[ ]*\S.*={2,6}[ ]*$|<h[1-6]\b|\\(?:sub)*section\b", re.I)
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)\]*_`]*$")


class Piece(NamedTuple):
    """Words first_word up to, not with, last_word of the item; boundary is the kind of the cut after it, 'end' for the last."""

    first_word: int
    last_word: int
    boundary: str
    text: str


def boundaries(text: str, code: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], list[str]]:
    """(start and end of each word, kind of a cut before each word). code: ranges of characters that are blocks of code; these, as what is fenced, have no boundaries
    inside but their lines."""
    spans: list[tuple[int, int]] = []
    kinds: list[str] = []
    ranges = sorted(code or [])
    fence, blank, after_code, ended, inside = "", False, False, False, False
    at, k = 0, 0
    for line in text.splitlines(keepends=True):
        words = [(at + m.start(), at + m.end()) for m in _WORD.finditer(line)]
        m = _FENCE.match(line)
        first = "line"
        while k < len(ranges) and words and ranges[k][1] <= words[0][0]:
            k += 1
            inside = False
        held = k < len(ranges) and bool(words) and ranges[k][0] <= words[0][0]
        if held:
            if not inside:
                first = "code_block"
            inside = after_code = True
            if fence and m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                fence, first = "", "word"
            elif m and not fence:
                fence = m.group(1)
        elif fence:
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                fence, first = "", "word"  # the closing fence stays with its code
                after_code = True
        elif m:
            fence, first = m.group(1), "code_block"
        elif _HEADING.match(line):
            first = "section"
        elif after_code and words:
            first = "code_block"
        elif blank:
            first = "paragraph"
        elif _ITEM.match(line):
            first = "list_item"
        for j, span in enumerate(words):
            kinds.append(first if j == 0 else "sentence" if ended and not fence and not held else "word")
            spans.append(span)
            ended = bool(_SENTENCE.search(text[span[0] : span[1]]))
        if words:
            blank = False
            after_code = held or after_code and first == "word"
        else:
            blank = True
        at += len(line)
    return spans, kinds


def _farthest(kinds: list[str], limit: int, overlap: int) -> list[int]:
    """Cuts that each lie as far as the limit lets them, at boundaries where there are any: of all ways to cut, one with the fewest cuts inside of sentences."""
    out: list[int] = []
    n, most = len(kinds), limit
    while most < n:
        least = (out[-1] if out else overlap) + 1
        out.append(next((p for p in range(most, least - 1, -1) if STRENGTH[kinds[p]]), most))
        most = out[-1] + limit - overlap
    return out


def cuts(kinds: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Word positions at which pieces end. From the fewest pieces on, equal targets are each snapped to the strongest boundary near; while
    a piece is over the limit, or more cuts lie inside of sentences than any cutting must have, one piece is added. Where no number of equal targets comes to
    that, the pieces end as far as the limit lets them."""
    n = len(kinds)
    if n <= limit:
        return []
    step = limit - overlap
    fewest = -(-(n - overlap) // step)
    farthest = _farthest(kinds, limit, overlap)
    bare = lambda at: sum(not STRENGTH[kinds[p]] for p in at)
    must = bare(farthest)
    for pieces in range(fewest, 2 * (len(farthest) + 1) + 1):
        size = (n - overlap) / pieces
        reach = max(8, int(size * 0.35))
        found: list[int] = []
        last = 0
        for i in range(1, pieces):
            target = round(overlap + i * size)
            # Room for this piece under the limit, and for those to come.
            least, most = max(last + 1, overlap + 1, n - step * (pieces - i)), min(last + step if i > 1 else limit, n - 1)
            if least > most:
                break
            low, high = max(least, target - reach), min(most, target + reach)
            if low > high:
                low = high = min(max(target, least), most)
            last = max(range(low, high + 1), key=lambda p: (STRENGTH[kinds[p]] - 3.0 * abs(p - target) / reach if STRENGTH[kinds[p]] else -10.0 - abs(p - target) / reach, -p))
            found.append(last)
        if len(found) == pieces - 1 and bare(found) <= must:
            return found
    return farthest


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, code: list[tuple[int, int]] | None = None) -> list[Piece]:
    """The pieces of a text, of which some ranges of characters may be code; one for a text within the limit. Leaving out each later piece's first `overlap` words gives all words once."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    spans, kinds = boundaries(text, code)
    if not spans:
        return []
    at = cuts(kinds, limit, overlap)
    ends = [*at, len(spans)]
    starts = [0, *(max(0, e - overlap) for e in at)]
    return [Piece(s, e, kinds[e] if e < len(spans) else "end", text[spans[s][0] : spans[e - 1][1]]) for s, e in zip(starts, ends)]


#: What stands between the blocks of an item.
BETWEEN = "\n\n"
_BLOCKS = "array<struct<size:int,is_code:boolean>>"
_OUT = "src string, item_key string, piece int, pieces int, first_word int, last_word int, boundary string, text string"


def _oversized(limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = [t is not None and len(t) > 2 * limit and len(t.split()) > limit for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(long))

    return work


def code_ranges(blocks: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges of characters that are code, from blocks of so many characters with blank lines between."""
    out, at = [], 0
    for b in blocks or []:
        if b["is_code"] and b["size"]:
            out.append((at, at + b["size"]))
        at += b["size"] + len(BETWEEN)
    return out


def _cut(limit: int, overlap: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for src, key, text, blocks in zip(*(batch.column(c).to_pylist() for c in ("src", "item_key", "text", "blocks"))):
                pieces = split(text, limit, overlap, code_ranges(blocks))
                rows += [(src, key, i, len(pieces), p.first_word, p.last_word, p.boundary, p.text) for i, p in enumerate(pieces)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = [c.split()[0] for c in _OUT.split(", ")]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return work


def oversized_items(src: str, df: DataFrame, key: str, text: str | None, loaded: str | None = None, limit: int = LIMIT, blocks: str | None = None) -> DataFrame:
    """(src, item_key, text, blocks): the items with more than `limit` words, once each, the last loaded of redelivered ones. Only these are shuffled.

    The text is a column, or is put together from a column of blocks (text, is_code), of which the sizes and kinds are kept; null texts of blocks count as empty."""
    t = F.coalesce(F.col(loaded).cast("long"), F.lit(-1)) if loaded else F.lit(-1).cast("long")
    own = lambda b: F.coalesce(b["text"], F.lit(""))
    whole = F.array_join(F.transform(blocks, own), BETWEEN) if blocks else F.col(text)
    shape = F.transform(blocks, lambda b: F.struct(F.length(own(b)).alias("size"), F.coalesce(b["is_code"], F.lit(False)).alias("is_code"))) if blocks else F.lit(None).cast(_BLOCKS)
    rows = df.where(F.col(key).isNotNull()).select(F.lit(src).alias("src"), F.col(key).cast("string").alias("item_key"), t.alias("t"), whole.alias("text"), shape.alias("blocks"))
    long = spread(rows).mapInArrow(_oversized(limit), f"src string, item_key string, t long, text string, blocks {_BLOCKS}")
    return long.groupBy("src", "item_key").agg(F.max_by(F.struct("text", "blocks"), F.struct("t", "text")).alias("r")).select("src", "item_key", "r.text", "r.blocks")


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, item_key, piece, pieces, first_word, last_word, boundary, text): the pieces of every item, each of at most `limit` words
    separated by white space, the last `overlap` words of each being the first of the next.

    An item within the limit is one piece; null, empty and blank texts have none; a single word, however long, is never cut. Blocks of code, fenced or told by the
    table, are cut at their ends or else at line ends."""
    return items.mapInArrow(_cut(limit, overlap), _OUT)


def piece_checks(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, item_key, words, digest, within_limit, shares_overlap) of each item's pieces: its words put together again and their md5, whether every piece is within the
    limit, and whether consecutive pieces share `overlap` words. An item's pieces lie in one task, as they came out of one text."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = pieces.select("src", "item_key", "piece", "first_word", "last_word", words.alias("w"))
    per = rows.groupBy("src", "item_key").agg(F.array_sort(F.collect_list(F.struct("piece", "first_word", "last_word", "w"))).alias("ps"), F.max(F.size("w")).alias("most"))
    whole = F.flatten(F.transform("ps", lambda p: F.when(p["piece"] == 0, p["w"]).otherwise(F.slice(p["w"], overlap + 1, F.greatest(F.size(p["w"]) - overlap, F.lit(1))))))
    shared = F.forall(F.sequence(F.lit(1), F.greatest(F.size("ps"), F.lit(2)) - 1), lambda i: (F.size("ps") < 2) | (F.slice(F.try_element_at("ps", i)["w"], -overlap, overlap) == F.slice(F.try_element_at("ps", i + 1)["w"], 1, overlap)))
    return per.select("src", "item_key", F.size(whole).cast("long").alias("words"), F.md5(F.array_join(whole, " ")).alias("digest"), (F.col("most") <= limit).alias("within_limit"), F.coalesce(shared, F.lit(True)).alias("shares_overlap"))
