"""Keyword, vector and fused search for a whole table of questions at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import tokens
from loomspark.session import spread, written

RRF_K = 60
#: Questions or query vectors that are sent to the executors at once; further ones take further passes over the corpus.
BLOCK = 8192


def postings(docs: DataFrame, id: str, text: Column) -> DataFrame:
    """(id, term, tf, len): term counts of each document and its number of terms."""
    rows = docs.select(F.col(id).alias("doc"), tokens(text).alias("terms"))
    return rows.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))


def query_terms(questions: DataFrame, id: str, text: Column) -> DataFrame:
    """(question_id, term, q_len): the different terms of each question."""
    rows = questions.select(F.col(id).alias("question_id"), F.array_distinct(tokens(text)).alias("terms"))
    return rows.select("question_id", F.size("terms").alias("q_len"), F.explode("terms").alias("term"))


def top_k(scored: DataFrame, k: int, by: str = "question_id", score: str = "score", tie: str = "content_id") -> DataFrame:
    """The k best of each group with their rank, ties by id. Each map task keeps k rows of a group (WindowGroupLimit) before they are shuffled."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Hits held by a task before they are reduced to the k best of each question, and scores that a task has at once.
HELD, SLICE = 1 << 20, 1 << 21


class _Best:
    """The k best documents of each of `questions` so far, of blocks of scores (documents by questions). Of a tie over the k-th place the smaller ids stay."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor = k, np.full(questions, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.most = 0, max(HELD, 2 * k * questions)

    def add(self, docs: np.ndarray, s: np.ndarray) -> None:
        """-inf is no hit. What lies under the k-th best score so far, or under that of this block, is dropped where it stands."""
        low, open_ = self.floor, np.flatnonzero(~np.isfinite(self.floor))
        if len(open_) and len(docs) > self.k:
            low = low.copy()
            low[open_] = np.partition(s[:, open_].T, len(docs) - self.k, axis=1)[:, len(docs) - self.k]
        d, q = np.nonzero((s >= low) & (s > -np.inf))
        self.held.append((q, docs[d], s[d, q]))
        self.n += len(q)
        if self.n > self.most or len(open_) and self.n > 4 * self.k * len(self.floor):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        keep = place < self.k
        self.held = [(q[keep], d[keep], s[keep])]
        self.n = int(keep.sum())
        return self.held[0]


def _allowed(wanted: list):
    """Function of a content's versions that tells for each question whether the content is of its version; questions without a version allow all."""
    of = np.array([*wanted, None], object)[:-1]
    free = np.array([w is None for w in wanted], bool)
    known: dict[tuple, np.ndarray] = {}

    def mask(versions: list | None) -> np.ndarray:
        key = tuple(versions or ())
        if key not in known:
            known[key] = free | np.isin(of.astype(str), [v for v in key if v is not None])
        return known[key]

    return mask


class _Asked:
    """A block of questions as an index from terms to questions in flat arrays: term t has the questions of `flat` from offsets[t] to offsets[t + 1], and a weight (idf)."""

    def __init__(self, block: list, bm25: tuple[float, float] | None, total: int, mean: float, versioned: bool):
        self.ids = np.array([r.question_id for r in block], object)
        self.norms = np.array([max(r.q_len, 1) for r in block], float)
        self.wanted = [r.version for r in block] if versioned else None
        self.bm25, self.mean = bm25, mean
        of: dict[str, list[int]] = {}
        df: dict[str, int] = {}
        for i, r in enumerate(block):
            for t in r.ts:
                of.setdefault(t.term, []).append(i)
                if bm25:
                    df[t.term] = t.df
        self.term = {t: i for i, t in enumerate(of)}
        self.offsets = np.r_[0, np.cumsum([len(x) for x in of.values()], dtype=np.int64)]
        self.flat = np.fromiter((i for x in of.values() for i in x), np.int64, int(self.offsets[-1]))
        self.idf = np.array([np.log1p((total - df[t] + 0.5) / (df[t] + 0.5)) if bm25 else 1.0 for t in of])

    def _postings(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, count) of the asked terms."""
        row, term, tf = [], [], []
        for i, terms in enumerate(docs):
            for t, c in Counter(terms).items():
                n = self.term.get(t)
                if n is not None:
                    row.append(i)
                    term.append(n)
                    tf.append(c)
        return np.array(row, np.int64), np.array(term, np.int64), np.array(tf, float)

    def _sums(self, docs: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        n = self.offsets[term + 1] - self.offsets[term]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offsets[term], n)
        width = len(self.ids)
        return np.bincount(np.repeat(row, n) * width + self.flat[at], np.repeat(weight, n), docs * width).reshape(docs, width)

    def scores(self, docs: list[list[str]]) -> np.ndarray:
        """(documents, questions), -inf where no term is shared."""
        row, term, tf = self._postings(docs)
        sizes = np.array([len(d) for d in docs], float)
        if self.bm25:
            k1, b = self.bm25
            weight = self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / self.mean))
        else:
            weight = tf / (tf + 1)
        sums = self._sums(len(docs), row, term, weight)
        s = np.round(sums if self.bm25 else sums / (self.norms[None, :] * np.log2(2.0 + sizes)[:, None]), 6)
        return np.where(sums > 0, s, -np.inf)


def _term_search(sent, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        allowed = _allowed(asked.wanted) if asked.wanted is not None else None
        best = _Best(len(asked.ids), k)
        step = max(16, SLICE // len(asked.ids))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                s = asked.scores(part.column("terms").to_pylist())
                if allowed:
                    s[~np.array([allowed(o) for o in part.column("versions").to_pylist()])] = -np.inf
                best.add(part.column("id").to_numpy(), s)
        if best.n:
            q, d, s = best.shrink()
            yield pa.record_batch([pa.array(asked.ids[q].tolist(), pa.string()), pa.array(d), pa.array(s)], names=["question_id", "content_id", "score"])

    return work


def _in_blocks(rows: DataFrame, search, finish=lambda result: result) -> list[DataFrame]:
    """search(block) for BLOCK rows at a time, which is all the driver holds. search gives the broadcast of a block and its result; with more than one block
    each result is finished (the tasks' k best reduced to those of each question) and written before the next block is read, and its broadcast given up."""
    first = rows.limit(BLOCK + 1).collect()
    if len(first) <= BLOCK:
        return [result for _, result in search(first)] if first else []
    parts: list[DataFrame] = []
    block: list = []

    def flush() -> None:
        for sent, result in search(block):
            parts.append(written(finish(result)))
            sent.destroy()
        block.clear()

    for r in written(rows).toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            flush()
    if block:
        flush()
    return parts


def term_search(terms: DataFrame, docs: DataFrame, id: str, text: Column, k: int, bm25: tuple[float, float] | None = None, versions: Column | None = None) -> DataFrame:
    """(question_id, content_id, score, rank): the k best contents of every question by its terms(question_id, term, q_len).

    With `versions`, the versions of a document, terms also has the question's version, and only documents of that version are scored for it (all, where it is
    null); the BM25 statistics are those of all documents given. Documents of other indexes are left out by the caller.

    Questions are taken in blocks of BLOCK, each sent as an index from term to questions; a block is one pass over the tokenised contents (written once, if there are several blocks)
    that keeps the k best per question and task, so that neither postings nor all pairs of questions and contents are ever shuffled. Without `bm25` the score is
    tf / (tf + 1) summed over shared terms, by the question's terms and log2(2 + length); with (k1, b) it is BM25 (Robertson and Zaragoza 2009),
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with df counted for asked terms only. Any shared term counts; ties go to the smaller id; null texts have no terms.
    """
    spark = terms.sparkSession
    rows = spread(docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), text.alias("text"), *([versions.alias("versions")] if versions is not None else []))).select("id", tokens(F.col("text")).alias("terms"), *(["versions"] if versions is not None else [])).where(F.size("terms") > 0)
    wanted = terms
    total, mean = 0, 1.0
    if bm25:
        rows = written(rows)
        totals = rows.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("m")).first()
        total, mean = totals.n, totals.m or 1.0
        frequency = rows.select(F.explode(F.array_distinct("terms")).alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        wanted = terms.join(frequency, "term")
    per_question = wanted.groupBy("question_id").agg(F.collect_list(F.struct("term", *(["df"] if bm25 else []))).alias("ts"), F.first("q_len").alias("q_len"), *([F.first("version").alias("version")] if versions is not None else []))
    held = {"rows": rows}

    def search(block: list):
        if len(block) == BLOCK and held["rows"] is rows and not bm25:  # several blocks: the texts are cut into terms once
            held["rows"] = written(rows)
        sent = spark.sparkContext.broadcast(_Asked(block, bm25, total, mean, versions is not None))
        yield sent, held["rows"].mapInArrow(_term_search(sent, k), "question_id string, content_id long, score double")

    parts = _in_blocks(per_question, search, lambda result: top_k(result, k).drop("rank"))
    if not parts:
        return spark.createDataFrame([], "question_id string, content_id long, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k)


class _Wanted:
    """A block of questions, each under the one of its terms that the fewest questions of the block have, with all its terms."""

    def __init__(self, block: list):
        often = Counter(t.term for r in block for t in r.ts)
        self.under: dict[str, list[tuple[str, frozenset]]] = {}
        for r in block:
            terms = frozenset(t.term for t in r.ts)
            self.under.setdefault(min(terms, key=lambda t: (often[t], t)), []).append((r.question_id, terms))
        self.keys = frozenset(self.under)


def _all_terms(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            questions, docs = [], []
            for doc, terms in zip(batch.column("id").to_pylist(), batch.column("terms").to_pylist()):
                held = frozenset(terms)
                found = [q for t in held & wanted.keys for q, own in wanted.under[t] if own <= held]
                questions += found
                docs += [doc] * len(found)
            yield pa.record_batch([pa.array(questions, pa.string()), pa.array(docs, pa.int64())], names=["question_id", "content_id"])

    return work


def all_terms(questions: DataFrame, id: str, text: Column, docs: DataFrame, doc_id: str, doc_text: Column) -> DataFrame:
    """(question_id, content_id): the AND match, documents that hold every term of a question. A question without terms matches nothing.

    Questions are sent in blocks as in `term_search`, each under its rarest term in the block; a scan of the documents looks only at the questions under a document's terms, and only matches leave it."""
    spark = questions.sparkSession
    rows = spread(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), doc_text.alias("text"))).select("id", tokens(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    per_question = query_terms(questions, id, text).groupBy("question_id").agg(F.collect_list(F.struct("term")).alias("ts"), F.first("q_len").alias("q_len"))

    held = {"rows": rows}

    def search(block: list):
        if len(block) == BLOCK and held["rows"] is rows:  # several blocks: the texts are cut into terms once
            held["rows"] = written(rows)
        sent = spark.sparkContext.broadcast(_Wanted(block))
        yield sent, held["rows"].mapInArrow(_all_terms(sent), "question_id string, content_id long")

    parts = _in_blocks(per_question, search)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "question_id string, content_id long")


def rrf(rankings: DataFrame, k: int) -> DataFrame:
    """(question_id, content_id, score, rank, first_list) of rankings(question_id, list_no, content_id, rank): reciprocal rank fusion
    (Cormack et al. 2009); first_list is the first list that holds the content, whose attributes it keeps."""
    fused = rankings.groupBy("question_id", "content_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.min("list_no").alias("first_list"))
    return top_k(fused, k)


def union_of_candidates(rankings: DataFrame) -> DataFrame:
    """(question_id, content_id, position): lists one after the other, each content where it comes first."""
    first = rankings.groupBy("question_id", "content_id").agg(F.min(F.struct("list_no", "rank")).alias("at"))
    order = Window.partitionBy("question_id").orderBy("at.list_no", "at.rank")
    return first.select("question_id", "content_id", F.row_number().over(order).alias("position"))


class _Vectors:
    """A block of unit query vectors of one length, their groups and versions, and the cells that each looks into, if the search is approximate."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray, q: np.ndarray, wanted: list | None, centres: np.ndarray | None, probes: int):
        self.ids, self.groups, self.q, self.wanted, self.centres = ids, groups, q, wanted, centres
        if centres is not None:
            near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
            self.looks = np.zeros((len(centres), len(q)), bool)
            self.looks[near.ravel(), np.repeat(np.arange(len(q)), near.shape[1])] = True


def _block_search(sent, k: int, same_group: bool, own: bool, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        ids, groups, q = asked.ids, asked.groups, asked.q
        allowed = _allowed(asked.wanted) if asked.wanted is not None else None
        best = _Best(len(ids), k)
        step = max(64, SLICE // len(ids))
        for batch in batches:
            column = batch.column("v")
            at = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy() == q.shape[1])
            for i in range(0, len(at), step):
                mine = at[i : i + step]
                x = column.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), -1)
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                    x = x / norm[:, None]
                ok = np.isfinite(x).all(1) & (norm > 0)
                x, mine = x[ok], mine[ok]
                if not len(mine):
                    continue
                doc = batch.column("id").to_numpy()[mine]
                if asked.centres is None:
                    s = np.round(x @ q.T, 6)
                else:  # only queries that look into a vector's cell are compared with it
                    s = np.full((len(mine), len(ids)), -np.inf)
                    cell = (x @ asked.centres.T).argmax(1)
                    for c in np.unique(cell):
                        r, looking = np.flatnonzero(cell == c), np.flatnonzero(asked.looks[c])
                        if len(looking):
                            s[np.ix_(r, looking)] = np.round(x[r] @ q[looking].T, 6)
                if own:
                    s[doc[:, None] == ids[None, :]] = -np.inf
                if same_group:
                    s[batch.column("grp").to_numpy(zero_copy_only=False)[mine][:, None] != groups[None, :]] = -np.inf
                if allowed:
                    s[~np.array([allowed(o) for o in batch.column("versions").take(pa.array(mine)).to_pylist()])] = -np.inf
                best.add(doc, s)
        if best.n:
            r, d, s = best.shrink()
            yield pa.record_batch([pa.array(ids[r].tolist(), kind), pa.array(d), pa.array(s)], names=["question_id", "content_id", "score"])

    return work


#: Vectors that the cells of an approximate search are fitted on, at most, and the most cells (which are sent).
CELL_SAMPLE, CELLS_MOST = 20_000, 1024


def _cells_of(corpus: DataFrame) -> dict[int, np.ndarray]:
    """By length of the vectors: centres of their cells, about the root of their number, by k-means of a bounded sample by hash."""
    counts = {r.d: r.n for r in corpus.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a length
    out = {}
    for d, n in counts.items():
        picked = corpus.where((F.size("v") == d) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, CELL_SAMPLE / n))).select("id", "v").orderBy("id")
        x = np.array([r.v for r in picked.toLocalIterator()], np.float64).reshape(-1, d)
        with np.errstate(all="ignore"):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x = x[np.isfinite(x).all(1)]
        if not len(x):
            continue
        c = x[np.linspace(0, len(x) - 1, max(1, min(len(x) // 4, int(n**0.5), CELLS_MOST))).astype(int)]
        for _ in range(6):
            near = (x @ c.T).argmax(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        out[d] = c
    return out


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, same_group: bool = False, own: bool = True, exact: bool = True, probes: int = 8) -> DataFrame:
    """(question_id, content_id, score, rank): cosine neighbours of queries(id, grp, v) among corpus(id, grp, v), itself left out
    unless the two have different ids (own=False), which for queries may be text. Where queries have a version and corpus has versions, only rows of
    the version are neighbours (all, where it is null).

    The query set is sent in blocks of BLOCK vectors of one length, each block one pass over the corpus with a k-best per task, so neither
    side is ever joined pairwise in rows. exact: all rows are compared; else only those in the `probes` cells nearest to a query, cells being fitted on a bounded sample.
    Null, zero, not finite and other-length vectors take no part. Scores are rounded to six places before ranking; ties go to the smaller id.
    """
    spark = queries.sparkSession
    text = dict(queries.dtypes)["id"] == "string"
    versioned = "version" in queries.columns and "versions" in corpus.columns
    schema = f"question_id {'string' if text else 'long'}, content_id long, score double"
    columns = ["id", "grp", "v"]
    cells = {} if exact else _cells_of(corpus)

    def search(rows: list):
        by_size: dict[int, list] = {}
        for r in rows:
            x = np.array(r.v, np.float64)
            norm = np.sqrt((x * x).sum())
            if len(x) and np.isfinite(norm) and norm > 0:
                by_size.setdefault(len(x), []).append((r.id, r.grp, x / norm, r.version if versioned else None))
        for size, held in by_size.items():
            sent = spark.sparkContext.broadcast(_Vectors(np.array([h[0] for h in held], object if text else np.int64), np.array([h[1] for h in held]), np.array([h[2] for h in held]), [h[3] for h in held] if versioned else None, cells.get(size), probes))
            yield sent, corpus.select(*columns, *(["versions"] if versioned else [])).mapInArrow(_block_search(sent, k, same_group, own, pa.string() if text else pa.int64()), schema)

    parts = _in_blocks(queries.where("v is not null").select(*columns, *(["version"] if versioned else [])), search, lambda result: top_k(result, k).drop("rank"))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k)


def exact_vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, same_group: bool = False, own: bool = True) -> DataFrame:
    return vector_top_k(queries, corpus, k, same_group, own)


#: Half a step of the fifth decimal place, to which distances are rounded before they are ranked.
HALF = 0.5e-5


def _rounded(x: np.ndarray) -> np.ndarray:
    """To five places, halves away from zero, as the SQL engine does it."""
    y = x * 1e5
    whole = np.trunc(y)
    return (whole + (y - whole >= 0.5)) / 1e5


class _Nearest:
    """Query vectors of one group and length, sorted by id, and the k nearest vectors of each so far, by rounded distance and then by id.

    A block of vectors is compared by one matrix product that bounds each distance from below. Only pairs that may still come among the k nearest by that bound are
    computed as the definition says, so the bound decides nothing but what is computed."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.k, self.qt = ids, k, np.ascontiguousarray(q.T)
        #: Relative error of products, norms and sums of differences over so many numbers, with room.
        self.slack = 8 * (len(self.qt) + 8) * np.finfo(float).eps
        self.qq = (q * q).sum(1)
        self.factor = np.vstack([2 * self.qt, np.full(len(q), -1.0)])
        #: Distance and id of the k-th nearest so far, or of one that is farther.
        self.far, self.last = np.full(len(q), np.inf), np.full(len(q), np.iinfo(np.int64).max)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.most = 0, max(1 << 16, 4 * k * len(q))

    def _distances(self, xt: np.ndarray, d: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros(len(d))
        for a, b in zip(xt, self.qt):  # in the order of the numbers, as the sum of a list
            z = a[d] - b[q]
            total += z * z
        return _rounded(np.sqrt(total))

    def _floor(self, distance: np.ndarray) -> np.ndarray:
        """What |q|² - d² is at least, as computed, for distances d up to this one; with infinity there is no bound, under zero nothing is that near."""
        square = np.square(np.maximum(distance, 0.0)) * (1 + 1e-12)
        least = self.qq - square - self.slack * (self.qq + square)
        return np.where(distance < 0, np.inf, np.maximum(least, -np.finfo(float).max))

    def add(self, docs: np.ndarray, x: np.ndarray) -> None:
        xt = np.ascontiguousarray(x.T)
        s = np.column_stack([x, (x * x).sum(1) * (1 - self.slack)]) @ self.factor
        at = np.searchsorted(self.ids, docs)
        own = np.flatnonzero(self.ids[np.minimum(at, len(self.ids) - 1)] == docs)
        s[own, at[own]] = -np.inf
        far, last = self.far, self.last
        open_ = np.flatnonzero(~np.isfinite(far))
        if len(open_) and len(docs) > self.k:  # any k vectors of the block are as near as the nearest k or farther
            some = np.argpartition(s[:, open_], len(docs) - self.k, axis=0)[len(docs) - self.k :]
            whole = np.isfinite(np.take_along_axis(s[:, open_], some, axis=0)).all(0)
            open_, some = open_[whole], some[:, whole]
            near = self._distances(xt, some.ravel(), np.tile(open_, self.k)).reshape(some.shape)
            far[open_] = near.max(0)
            last[open_] = np.where(near == far[open_], docs[some], np.iinfo(np.int64).min).max(0)
        d, q = np.nonzero(s >= self._floor(far + 1.2 * HALF))
        # At the k-th distance itself only smaller ids count.
        may = (docs[d] <= last[q]) | (s[d, q] >= self._floor(far - 0.8 * HALF)[q])
        d, q = d[may], q[may]
        distance = self._distances(xt, d, q)
        may = distance <= far[q]
        self.held.append((q[may], docs[d[may]], distance[may]))
        self.n += len(self.held[-1][0])
        if self.n > self.most:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, s = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((d, s, q))
        q, d, s = q[order], d[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.far[q[last]], self.last[q[last]] = s[last], d[last]
        keep = place < self.k
        self.held = [(q[keep], d[keep], s[keep])]
        self.n = int(keep.sum())
        return self.held[0]


def _nearest_search(sent, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], _Nearest] = {}
        for batch in batches:
            column, docs, groups = batch.column("v"), batch.column("id").to_numpy(), batch.column("grp").dictionary_encode()
            sizes, codes = column.value_lengths().to_numpy(), groups.indices.to_numpy()
            by_group = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[by_group], np.arange(len(groups.dictionary) + 1))
            for g, group in enumerate(groups.dictionary.to_pylist()):
                mine = by_group[bounds[g] : bounds[g + 1]]
                for size, (ids, q) in sent.value.get(group, {}).items():
                    at = mine[sizes[mine] == size]
                    if (group, size) not in best:
                        best[group, size] = _Nearest(ids, q, k)
                    step = max(64, SLICE // len(ids))
                    for i in range(0, len(at), step):
                        part = at[i : i + step]
                        x = column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), size)
                        best[group, size].add(docs[part], x)
        for (group, _), found in best.items():
            if found.n:
                q, d, s = found.shrink()
                yield pa.record_batch([pa.array([group] * len(q), pa.string()), pa.array(found.ids[q]), pa.array(d), pa.array(s)], names=["grp", "question_id", "content_id", "distance"])

    return work


def nearest_vectors(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(grp, question_id, content_id, distance): the k nearest vectors by Euclidean distance of each of queries(id, grp, v) among corpus(id, grp, v) of the same group and
    length, without the one of the same id. Ids are unique in a group; nothing is null and all numbers are finite. All pairs are compared.

    Queries are sent in blocks as in `vector_top_k`, those of all groups together; a block is one pass over the corpus (written once, if there are several blocks) with a
    k-best per task, so pairs are never rows. Distances are rounded to five places before ranking; ties go to the smaller id."""
    spark = queries.sparkSession
    schema = "grp string, question_id long, content_id long, distance double"
    columns = ["id", "grp", "v"]
    rows = corpus.select(*columns)
    held = {"rows": rows}
    order = Window.partitionBy("grp", "question_id").orderBy("distance", "content_id")
    best = lambda result: result.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")

    def search(block: list):
        if len(block) == BLOCK and held["rows"] is rows:  # several blocks: the corpus is made once
            held["rows"] = written(rows)
        asked: dict[str, dict[int, list]] = {}
        for r in sorted(block, key=lambda r: r.id):
            asked.setdefault(r.grp, {}).setdefault(len(r.v), []).append(r)
        sent = spark.sparkContext.broadcast({g: {n: (np.array([r.id for r in rs], np.int64), np.array([r.v for r in rs], np.float64).reshape(len(rs), n)) for n, rs in of.items()} for g, of in asked.items()})
        yield sent, held["rows"].mapInArrow(_nearest_search(sent, k), schema)

    parts = _in_blocks(queries.select(*columns), search, best)
    return best(reduce(DataFrame.unionByName, parts)) if parts else spark.createDataFrame([], schema)


def rerank(candidates: DataFrame, score: Column, k: int, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """candidates(question_id, content_id, rank, ...) with new_rank: the k best of each list by a score, ties in the order they came in."""
    order = Window.partitionBy(*by).orderBy(F.col("rerank_score").desc(), "rank")
    return candidates.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def choose_occurrence(wanted: DataFrame, occurrences: DataFrame, content: str, version_key: Column) -> DataFrame:
    """wanted(…, content, wanted_version) with the chunk of each content: of the wanted version, else the newest, then the smallest chunk_id."""
    keys = [c for c in wanted.columns]
    rank = F.struct((F.col("version") != F.coalesce("wanted_version", F.lit(""))).alias("other"), F.transform(version_key, lambda x: -x).alias("newest"), F.col("chunk_id"))
    return wanted.join(occurrences, content).groupBy(*keys).agg(F.min_by(F.struct("chunk_id", "version"), rank).alias("o")).select(*keys, "o.chunk_id", "o.version")
