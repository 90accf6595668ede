"""Problem 10: texts cut off by field limits or in transfer, by right-censored length models combined with evidence from the endings."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import spread

#: Buckets of the corpus-wide counts of words at and before the ends of lines; a fixed size whatever the vocabulary.
BUCKETS = 1 << 16
#: Sources of which the limits are sent to the executors; with more, a document's limits come by a join.
SOURCES_SENT = 10_000
#: Log odds of a cut away from any limit (one text in twenty), and the bounds within which evidence moves them.
PRIOR, SURE, STRONG = math.log(0.05 / 0.95), 12.0, 8.0

_FENCE = re.compile(r"^[ \t>]*(```+|~~~+)", re.M)
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+(.*)$", re.M)
_MARKER = re.compile(r"(?:\((?:read more|more|continued|cont\.?)\)|\[(?:…|\.\.\.|truncated|cut)\]|(?:weiterlesen|leer más|lire la suite))\s*$", re.I)
_OWN_DOTS = re.compile(r"(?:\s|and so on|etc|usw|etcétera)(?:\.\.\.|…)$", re.I)
_DOTS = re.compile(r"(?:\.\.\.|…)$")
_END = re.compile(r"[.!?。！？｡:;](?:[\"'”’»)\]}*_`]|</\w+>|\[\d+\])*$")
_CLOSED = re.compile(r"(?:\||```|~~~|</\w+>|/>|\|\}|\}\}|\]\]|\$\$|\\\]|\\\)|\\end\{\w+\*?\}|\]\([^()\s]+\)|-->|[*_-]{3,}|={3,}|\[\d+\])$")
_BYLINE = re.compile(r"^\s*(?:—|--|–)\s+\S")
_LINK = re.compile(r"(?:https?://|/)[\w./~%#?=&-]*$")
_PART = re.compile(r"[A-Z]?[a-zà-öø-ÿ]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+")


def _word(line: str) -> str | None:
    """The last part of a line: a word, a component of a camel-case name, or the kind of a number."""
    parts = list(_PART.finditer(line))
    if not parts:
        return None
    m = parts[-1]
    if m.group().isdigit():
        return ("-#" if m.start() and line[m.start() - 1] == "-" else ".#" if m.start() and line[m.start() - 1] == "." else " #")
    return m.group().lower()


_INVISIBLE = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_MARKS = re.compile("[\u0300-\u036f]+")


def _plain(line: str) -> str:
    """A line without accents, ligatures and invisible characters, which a loader may have put into any word."""
    return line if line.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", line.translate(_INVISIBLE)))


def _bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words anywhere in list items and bylines, and at their ends; a text's last line, which may be cut, isn't counted."""
    total, ends = Counter(), Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            body = text.rstrip().rpartition("\n")[0] if text else ""
            for m in _ITEM.finditer(body):
                line = _plain(m.group(1).rstrip())
                if not line or _END.search(line):
                    continue
                for p in _PART.finditer(line):
                    w = p.group()
                    total[("-#" if line[p.start() - 1] == "-" else " #") if w.isdigit() else w.lower()] += 1
                w = _word(line)
                if w:
                    ends[w] += 1
    t, e = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for w, n in total.items():
        t[_bucket(w)] += n
    for w, n in ends.items():
        e[_bucket(w)] += n
    used = np.flatnonzero(t + e)
    yield pa.record_batch([pa.array(used), pa.array(t[used]), pa.array(e[used])], names=["bucket", "total", "ends"])


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limits: dict[int, int], rounds: int = 50) -> tuple[float, float]:
    """Maximum likelihood (mean, deviation) of log lengths of which limits[L] values are only known to be L or longer, by expectation-maximisation."""
    x, n = np.log(np.maximum(lengths, 1)), counts.astype(float)
    open_ = np.array([v not in limits for v in lengths.tolist()])
    x, n = x[open_], n[open_]
    cut = [(math.log(v), c) for v, c in limits.items()]
    all_n = n.sum() + sum(c for _, c in cut)
    if n.sum() < 2:
        return (float(np.average(x, weights=n)) if n.sum() else math.log(max(limits, default=1))), 1.0
    mu, sd = float(np.average(x, weights=n)), float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))) or 0.1
    for _ in range(rounds):
        first, second = float((x * n).sum()), float((x * x * n).sum())
        for lim, c in cut:
            a = (lim - mu) / sd
            tail = max(_normal_tail(a), 1e-12)
            lam = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
            m1 = mu + sd * lam
            m2 = mu * mu + sd * sd + sd * lam * (lim + mu)
            first, second = first + c * m1, second + c * m2
        new = first / all_n
        sd_new = math.sqrt(max(second / all_n - new * new, 1e-4))
        if abs(new - mu) + abs(sd_new - sd) < 1e-6:
            mu, sd = new, sd_new
            break
        mu, sd = new, sd_new
    return mu, sd


def _limits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of a source: lengths at which far more different texts end than around them, with the censoring posterior there."""
    pdf = pdf.sort_values("len")
    lengths, counts = pdf["len"].to_numpy(), pdf["n"].to_numpy()
    upto = np.r_[0, np.cumsum(counts)]
    at = np.flatnonzero(counts >= 4)
    wide = np.maximum(20, lengths[at] // 20)
    near = upto[np.searchsorted(lengths, lengths[at] + wide, "right")] - upto[np.searchsorted(lengths, lengths[at] - wide, "left")] - counts[at]
    expected = (near + 1) / (2 * wide)
    c = counts[at].astype(float)
    # Upper bound of the chance of so many by accident (Poisson, Chernoff).
    piled = (c > expected) & (c - expected - c * np.log(c / expected) < -14)
    found = dict(zip(lengths[at[piled]].tolist(), counts[at[piled]].tolist()))
    mu, sd = fit_censored(lengths, counts, found)
    rows = []
    for v, c in found.items():
        z = (math.log(v) - mu) / sd
        tail, here = _normal_tail(z), math.exp(-z * z / 2) / (v * sd * math.sqrt(2 * math.pi))
        rows.append((pdf["source"].iloc[0], v, c, tail / max(tail + here, 1e-300), mu, sd))
    return pd.DataFrame(rows, columns=["source", "limit", "n", "posterior", "mu", "sd"])


def length_limits(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source, limit, n, posterior, mu, sd): per source the lengths where values pile up, how many different texts have it, the posterior
    that a value of that length was cut there, and the fitted log-normal. Lengths are counted over different texts, pre-aggregated before a source's histogram is fitted."""
    different = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.xxhash64(F.col(text)).alias("h"), F.length(F.col(text)).alias("len")).distinct()
    histogram = different.groupBy("source", "len").agg(F.count("*").alias("n"))
    return histogram.groupBy("source").applyInPandas(_limits, "source string, limit int, n long, posterior double, mu double, sd double")


def ending(text: str, recorded: int | None, total: np.ndarray, ends: np.ndarray) -> tuple[str, float]:
    """(kind, log odds of a cut) of a text's last characters."""
    t = text.rstrip()
    if len(_FENCE.findall(t)) % 2:
        return "open_code", SURE
    if t.endswith("�"):
        return "broken_character", SURE
    if _MARKER.search(t):
        return "marker", SURE
    if _DOTS.search(t):
        return ("own_dots", -SURE) if _OWN_DOTS.search(t) else ("dots", STRONG)
    last = t[t.rfind("\n") + 1 :]
    item = _ITEM.match(last)
    body = item.group(1) if item else last
    if re.fullmatch(r"[ \t]*(?:[-*+•]|\d+[.)]?)", last):
        return "bare_item", STRONG
    if last.lstrip().startswith("|") and not last.endswith("|"):
        return "open_row", STRONG
    if _CLOSED.search(t):
        return "closed_block", -SURE
    if _END.search(t):
        # "Since 1." and the like: a stub of a sentence after whole ones.
        stub = re.split(r"(?<=[.!?。])\s+", body)[-1]
        return ("stub", -1.0) if re.fullmatch(r"\S+ \d\.", stub) else ("sentence_end", -SURE)
    byline, link = bool(_BYLINE.match(last)), _LINK.search(last)
    if link:
        return ("link", -SURE) if last.endswith("/") or re.search(r"\.\w{2,5}$", last) else ("open_link", 2.0)
    if byline:
        return ("byline", -SURE) if re.search(r"\d$|\S+ \S+$", last) and _word(last) in (".#", " #", "-#") else ("open_byline", 2.0)
    heading = last.startswith("#")
    if item or heading:
        w = _word(_plain(body))
        if w is None or body.rstrip().endswith((",", "-", "/", "(", "=")):
            return "open_item", STRONG
        b = _bucket(w)
        at_end, seen = ends[b], total[b]
        odds = math.log((seen - at_end + 0.5) / (at_end + 0.5)) if seen else 1.5
        if at_end >= 3:
            odds = min(odds, 2.0)  # a word that does end items
        elif seen >= 20 and not at_end:
            odds += 3
        elif not seen and total.sum() > 20_000:
            odds += 3  # a rich corpus doesn't know the word: cut inside it
        if recorded is not None and recorded > 1.1 * len(text) + 5:
            odds += 3
        return "item", max(-STRONG, min(STRONG, odds))
    return "open_sentence", STRONG


def line_counts(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Corpus-wide (counts, counts at the end of an item) of words by bucket; lines has a column text without nulls."""
    t, e = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in spread(lines).mapInArrow(_line_counts, "bucket long, total long, ends long").groupBy("bucket").agg(F.sum("total").alias("t"), F.sum("ends").alias("e")).collect():  # at most BUCKETS rows
        t[r.bucket], e[r.bucket] = r.t, r.e
    return t, e


def _judge(limits, counts):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ends = counts.value
        known = limits.value if limits is not None else None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "source", "text", "recorded", "posterior")]
            ids, sources, kinds, odds = [], [], [], []
            for doc, source, text, recorded, posterior in zip(*cols):
                if not text or not text.strip():
                    continue
                kind, evidence = ending(text, recorded, total, ends)
                at = posterior if known is None else known.get((source, len(text)))
                prior = PRIOR if at is None else max(PRIOR, math.log(min(max(at, 1e-6), 1 - 1e-6) / (1 - min(max(at, 1e-6), 1 - 1e-6))))
                if kind == "stub" and at is not None:
                    evidence = 0.0
                ids.append(doc)
                sources.append(source)
                kinds.append(kind if at is None else f"{kind}_at_limit")
                odds.append(prior + evidence)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(kinds, pa.string()), pa.array(odds, pa.float64())], names=["doc_id", "source", "kind", "odds"])

    return work


def truncation_evidence(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", recorded: str = "n_chars") -> DataFrame:
    """(doc_id, source, kind, odds): for each text its ending and the log odds that it was cut, over 0 meaning cut.

    The odds start from the censoring posterior if the text has exactly a candidate length of its source, else from one in twenty; the
    ending adds its evidence: open code, markers and unfinished sentences speak for a cut, whole sentences, closed blocks, links, signatures
    and the author's own dots against it at any length; for list items the counts of their last word inside and at the end of items decide.

    Null, empty and blank texts are left out, as nothing says that they were cut; a null source is reported as ''; null ids and repeated rows are kept.
    """
    spark = docs.sparkSession
    counts = line_counts(docs.select(F.col(text).alias("text")).where("text is not null"))
    limits = length_limits(docs, text, source).select("source", "limit", "posterior")
    rows = limits.limit(SOURCES_SENT + 1).collect()
    base = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"), F.col(recorded).cast("long").alias("recorded"))
    sent = None
    if len(rows) <= SOURCES_SENT:
        sent = spark.sparkContext.broadcast({(r.source, r.limit): r.posterior for r in rows})
        base = base.withColumn("posterior", F.lit(None).cast("double"))
    else:
        here = limits.withColumnsRenamed({"source": "s", "limit": "l"})
        base = base.join(here, (F.col("source") == F.col("s")) & (F.length("text") == F.col("l")), "left").drop("s", "l")
    return spread(base).mapInArrow(_judge(sent, spark.sparkContext.broadcast(counts)), "doc_id long, source string, kind string, odds double")


def truncated(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id): the documents of which the text was cut."""
    return truncation_evidence(docs, **columns).where("odds > 0").select("doc_id").distinct()


def truncation_rates(docs: DataFrame, **columns: str) -> DataFrame:
    """(source, texts, cut, rate) over the texts that aren't blank."""
    per = truncation_evidence(docs, **columns).groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.expr("int(odds > 0)")).alias("cut"))
    return per.withColumn("rate", F.round(F.col("cut") / F.col("texts"), 6))
