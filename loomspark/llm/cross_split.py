"""Problem 1: the same or almost the same records across splits. Word n-gram hashes of the evaluation records are sent to, or partitioned with, the training
records, which are scanned for hits; the containment of each evaluation record in each training record that it hits decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bucket_join import mix
from loomspark.llm.words import hashed, words
from loomspark.session import spread, written

#: Hash buckets of the word counts that order the words; a fixed size whatever the vocabulary.
COUNT_BUCKETS = 1 << 16
#: Words of a record up to which n-grams are pairs of words, which are more selective; of longer records they are single words, whose number grows in line
#: with the length. Two records of which one is longer and one isn't share single words.
PAIRS_MOST = 60
#: Characters of all evaluation records up to which their n-grams are broadcast; more are partitioned by hash together with those of the training records.
SENT_MOST = 16 << 20
#: Hits that a task holds at once.
HELD = 1 << 20


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least number of common words at which `percent` of n words is reached."""
    return -(-n * percent // 100)


class Records(NamedTuple):
    """Tokens of some records one after the other, rarest first within each; a word's n-th occurrence is a token of its own, so that multisets become sets."""

    tokens: np.ndarray
    offsets: np.ndarray
    #: 64-bit maps of the tokens: a token that only one record has shows as at most one bit that the other lacks.
    bits: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def records(texts: list[str | None], often: np.ndarray) -> Records:
    flat, offsets = hashed(texts)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((flat, row))
    flat = flat[by]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    again = np.arange(len(flat)) - np.repeat(start, np.diff(np.r_[start, len(flat)]))
    tokens = np.where(again > 0, mix(flat + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), flat)
    tokens = tokens[np.lexsort((tokens, often[(tokens % np.uint64(COUNT_BUCKETS)).astype(np.int64)], row))]
    bits = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(bits, row, np.uint64(1) << (mix(tokens) & np.uint64(63)))
    return Records(tokens, offsets, bits)


def _heads(r: Records, rows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their first tokens as a matrix), for each length of a head."""
    for length in np.unique(lengths):
        at = rows[lengths == length]
        yield at, r.tokens[r.offsets[at][:, None] + np.arange(length)]


def grams(r: Records, percent: int, evaluation: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the n-grams of each record's rarest-first head.

    With C words needed in common, the first two common words (in any one order of words) lie within the first n - C + 2 of either record, the first one
    within n - C + 1; so an evaluation record has an n-gram in common with each training record that it overlaps with."""
    n = r.sizes
    c = needed(n, percent)
    all_rows = np.arange(len(n))
    # A training record has pairs up to PAIRS_MOST words, else single words; an evaluation record has those of all training records whose length fits its own.
    pairs = (n >= 2) & ((c <= PAIRS_MOST) if evaluation else (n <= PAIRS_MOST))
    single = (n > 0) & ((c == 1) | ((n >= needed(PAIRS_MOST + 1, percent)) if evaluation else (n > PAIRS_MOST)))
    out_rows, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for rows, head in _heads(r, all_rows[pairs], np.minimum(n, n - c + 2)[pairs]):
        i, j = np.triu_indices(head.shape[1], 1)
        lo, hi = np.minimum(head[:, i], head[:, j]), np.maximum(head[:, i], head[:, j])
        out.append(mix(mix(lo) ^ hi).ravel())
        out_rows.append(np.repeat(rows, len(i)))
    for rows, head in _heads(r, all_rows[single], (n - c + 1)[single]):
        out.append(mix(head + np.uint64(1)).ravel())
        out_rows.append(np.repeat(rows, head.shape[1]))
    return np.concatenate(out_rows), np.concatenate(out)


def fits(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether records of so many words and such bit maps can have enough words in common."""
    c = needed(np.maximum(na, nb), percent)
    return (np.minimum(na, nb) >= c) & (na - np.bitwise_count(a & ~b) >= c) & (nb - np.bitwise_count(b & ~a) >= c)


def containment(a: Counter, b: Counter, percent: int) -> float | None:
    """The share of the longer record's words that both have, if it is enough."""
    common, longer = sum((a & b).values()), max(a.total(), b.total())
    return common / longer if longer and common * 100 >= longer * percent else None


class _Evaluation:
    """The n-gram hashes of evaluation records with different words, sorted, and the records of each."""

    def __init__(self, texts: list[str], often: np.ndarray, percent: int):
        r = records(texts, often)
        rows, keys = grams(r, percent, True)
        by = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[by], rows[by].astype(np.int32)
        self.sizes, self.bits, self.texts, self.percent = r.sizes, r.bits, texts, percent
        self.counted: dict[int, Counter] = {}

    def counts(self, k: int) -> Counter:
        if k not in self.counted:
            if len(self.counted) > 100_000:
                self.counted.clear()
            self.counted[k] = Counter(words(self.texts[k]))
        return self.counted[k]

    def hits(self, r: Records) -> tuple[np.ndarray, np.ndarray]:
        """(record, evaluation record) that share an n-gram and whose sizes and bits fit, each once."""
        rows, keys = grams(r, self.percent, False)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = np.flatnonzero(high > low)
        found = np.empty(0, np.int64)
        width = np.int64(len(self.sizes) + 1)
        ends = np.cumsum((high - low)[some])
        at = 0
        while at < len(some):  # as many n-grams at once as have HELD hits
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
            part = some[at:to]
            n = (high - low)[part]
            a = np.repeat(rows[part], n)
            b = self.of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)].astype(np.int64)
            ok = fits(r.sizes[a], self.sizes[b], r.bits[a], self.bits[b], self.percent)
            found = np.unique(np.concatenate([found, a[ok] * width + b[ok]]))
            at = to
        return found // width, found % width


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by bucket; under bucket -1 the characters of evaluation records."""
    total, chars = np.zeros(COUNT_BUCKETS, np.int64), 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        total += np.bincount((hashed(texts)[0] % np.uint64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS)
        chars += sum(len(t) for t, held in zip(texts, batch.column("held").to_pylist()) if held)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.r_[-1, used]), pa.array(np.r_[chars, total[used]])], names=["bucket", "n"])


def _scan(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, often = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                texts = part.column("text").to_pylist()
                rows, nos, shares = [], [], []
                counted: dict[int, Counter] = {}
                for a, b in zip(*(x.tolist() for x in index.hits(records(texts, often)))):
                    if a not in counted:
                        counted[a] = Counter(words(texts[a]))
                    share = containment(counted[a], index.counts(b), index.percent)
                    if share is not None:
                        rows.append(a)
                        nos.append(b)
                        shares.append(share)
                at = pa.array(rows, pa.int32())
                yield pa.record_batch([*[part.column(c).take(at) for c in ("id", "o")], pa.array(nos, pa.int32()), pa.array(shares, pa.float64())], names=["id_train", "o_train", "no", "containment"])

    return work


def _partitioned(base: DataFrame, often, percent: int) -> DataFrame:
    """(id_train, o_train, id_eval, o_eval, eval_split, eval_origin, containment) by partitioning the n-grams of both sides by hash; the classes of equal words meet, and only
    classes that have a hit and their texts are joined. A class is told by the md5 of its words."""
    bag = F.array_join(F.array_sort(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")), " ")
    rows = written(base.withColumn("text", bag).where("text <> ''").withColumn("cls", F.md5("text")))
    classes = rows.groupBy("cls").agg(F.max(F.expr("split = 'train'")).alias("train"), F.max(F.expr("split <> 'train'")).alias("held"), F.first("text").alias("text"))

    def keyed(evaluation: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    part = batch.slice(i, 2000)
                    r = records(part.column("text").to_pylist(), often.value)
                    at, keys = grams(r, percent, evaluation)
                    yield pa.record_batch([pa.array(keys.view(np.int64)), part.column("cls").take(pa.array(at)), pa.array(r.sizes[at]), pa.array(r.bits[at].view(np.int64))], names=["k", "cls", "n", "bits"])

        return work

    kind = "k long, cls string, n long, bits long"
    a = classes.where("train").select("cls", "text").mapInArrow(keyed(False), kind).select("k", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "bits")])
    b = classes.where("held").select("cls", "text").mapInArrow(keyed(True), kind).select("k", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "bits")])
    c = F.expr(f"(greatest(n_a, n_b) * {percent} + 99) div 100")
    fit = (F.least("n_a", "n_b") >= c) & (F.col("n_a") - F.bit_count(F.expr("bits_a & ~bits_b")) >= c) & (F.col("n_b") - F.bit_count(F.expr("bits_b & ~bits_a")) >= c)
    met = a.join(b, "k").where(fit).select("cls_a", "cls_b").distinct()
    texts = classes.select("cls", "text")
    wide = met.join(texts.withColumnsRenamed({"cls": "cls_a", "text": "text_a"}), "cls_a").join(texts.withColumnsRenamed({"cls": "cls_b", "text": "text_b"}), "cls_b").select("cls_a", "cls_b", "text_a", "text_b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [containment(Counter(words(x)), Counter(words(y)), percent) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            ok = pa.array([s is not None for s in shares])
            yield pa.record_batch([batch.column("cls_a").filter(ok), batch.column("cls_b").filter(ok), pa.array([s for s in shares if s is not None], pa.float64())], names=["cls_a", "cls_b", "containment"])

    linked = wide.mapInArrow(verified, "cls_a string, cls_b string, containment double")
    train = rows.where("split = 'train'").select(F.col("cls").alias("cls_a"), F.col("id").alias("id_train"), F.col("o").alias("o_train"))
    held = rows.where("split <> 'train'").select(F.col("cls").alias("cls_b"), F.col("id").alias("id_eval"), F.col("o").alias("o_eval"), F.col("split").alias("eval_split"), F.col("origin").alias("eval_origin"))
    return linked.join(train, "cls_a").join(held, "cls_b").drop("cls_a", "cls_b")


def _order(*rest: str | Column) -> Column:
    """What the rows of an id are ordered by: the load time, then the row's content."""
    return F.to_json(F.struct(F.format_string("%020d", F.coalesce(F.col("loaded_at").cast("timestamp").cast("decimal(20,6)") * 1_000_000, F.lit(0)).cast("long")).alias("t"), *rest))


def cross_split_overlaps(items: DataFrame, percent: int = 80) -> DataFrame:
    """(id_train, id_eval, eval_split, eval_origin, containment): every pair of a training and a dev or test item of which the common words
    (with multiplicity, in any order) are at least `percent` of the words of the longer question.

    Exact: an overlapping evaluation record shares an n-gram (n is two, or one for long records) of its rarest-first head with the training record;
    sizes and bit maps drop chance hits without losing any, and the words themselves decide. The n-grams are taken in the order of rarity, not
    of the text, because the order of words doesn't count. Evaluation n-grams of up to SENT_MOST characters of records are broadcast, and the training records
    are scanned where they lie: only hits are shuffled. More are partitioned by hash.

    Redelivered items count once (the last loaded; of one load time the greatest row): rows of ids that have hits are looked up again, so that nothing else
    has to move. Null, empty and wordless questions match nothing; other splits than train, dev and test take no part; null origins are reported as such;
    an empty table gives no rows.
    """
    spark = items.sparkSession
    order = _order("split", "origin", F.md5(F.coalesce("question", F.lit(""))).alias("h"))
    base = spread(items.where("id is not null and question is not null and split in ('train', 'dev', 'test')").select("id", "split", "origin", "question", "loaded_at")).select("id", order.alias("o"), "split", "origin", F.col("question").alias("text"))
    often, chars = np.zeros(COUNT_BUCKETS, np.int64), 0
    for r in base.select("text", F.expr("split <> 'train'").alias("held")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most COUNT_BUCKETS + 1 rows
        if r.bucket < 0:
            chars = r.n
        else:
            often[r.bucket] = r.n
    if chars > SENT_MOST:
        hits = written(_partitioned(base, spark.sparkContext.broadcast(often), percent))
    else:
        held = base.where("split <> 'train'").groupBy("id", "o", "split", "origin").agg(F.first("text").alias("text")).toPandas()  # SENT_MOST characters at most
        no: dict[str, int] = {}  # records with equal words in any order are searched for once
        held["no"] = [no.setdefault(" ".join(sorted(words(t))), len(no)) for t in held["text"]]
        members = spark.createDataFrame(held[["no", "id", "o", "split", "origin"]].astype(object).where(held.notna(), None), "no int, id_eval string, o_eval string, eval_split string, eval_origin string")
        index = spark.sparkContext.broadcast((_Evaluation(list(no), often, percent), often))
        kind = dict(items.dtypes)["id"]
        scanned = base.where("split = 'train'").select("id", "o", "text").mapInArrow(_scan(index), f"id_train {kind}, o_train string, no int, containment double")
        hits = written(scanned.join(members, "no").drop("no"))
    ids = hits.select(F.col("id_train").alias("id")).unionByName(hits.select(F.col("id_eval").alias("id"))).distinct()
    last = items.where("id is not null").select("id", order.alias("o")).join(ids, "id", "left_semi").groupBy("id").agg(F.max("o").alias("o"))
    kept = hits.join(last.withColumnsRenamed({"id": "id_train", "o": "o_train"}), ["id_train", "o_train"], "left_semi").join(last.withColumnsRenamed({"id": "id_eval", "o": "o_eval"}), ["id_eval", "o_eval"], "left_semi")
    return kept.select("id_train", "id_eval", "eval_split", "eval_origin", "containment").distinct()


def overlap_report(items: DataFrame, percent: int = 80) -> DataFrame:
    """Per evaluation split and origin: items, items that overlap with training, pairs; splits without overlaps are listed with 0."""
    pairs = cross_split_overlaps(items, percent)
    found = pairs.groupBy("eval_split", "eval_origin").agg(F.countDistinct("id_eval").alias("overlapping_items"), F.count("*").alias("pairs"))
    last = items.where("id is not null").groupBy("id").agg(F.max(F.struct(_order("split", "origin", F.md5(F.coalesce("question", F.lit(""))).alias("h")).alias("o"), "split", "origin")).alias("r"))
    all_items = last.where("r.split in ('dev', 'test')").groupBy(F.col("r.split").alias("eval_split"), F.col("r.origin").alias("eval_origin")).agg(F.count("*").alias("items"))
    key = [all_items.eval_split == found.eval_split, all_items.eval_origin.eqNullSafe(found.eval_origin)]
    return all_items.join(found, key, "left").select(all_items.eval_split, all_items.eval_origin, "items", F.coalesce("overlapping_items", F.lit(0)).alias("overlapping_items"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
