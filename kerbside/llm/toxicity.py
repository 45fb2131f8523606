"""Operator 10: toxic passages by maximum-scoring segments.

Terms are words and word beginnings. A term's score is its log odds between toxic and clean
training texts with a Dirichlet prior in proportion to its overall rate. Counts are of distinct
contexts (the words before and after), so copies of a text count once. Other words cost a little. A
linear scan finds every maximal segment of the score sequence (all that cannot be extended or
cut to score higher). By extreme-value theory the number of segments in ``n`` clean words that
reach a score S is about ``K n exp(-lambda S)``; this makes scores of short and long texts
comparable. The evidence of a document's segments is summed and turned into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import words as W
from kerbside.llm.labelled import isotonic, remainder, training_rows

#: Bytes of word beginnings that are terms, besides whole words.
BEGINNINGS = (4, 5)
#: A term needs so many occurrences in toxic texts, log odds and standard scores.
LEAST_COUNT, LEAST_ODDS, LEAST_Z = 5, 3.0, 2.2
#: Weight of the prior against the toxic texts.
PRIOR = 0.1
#: Cost of a word that is no term.
COST = 0.05
K = 0.1
#: Segments that clean texts have more often than this are not evidence.
MOST_EXPECTED = 0.5
BINS = 64


class Model(NamedTuple):
    key: np.ndarray
    score: np.ndarray
    scale: float
    rates: list[float]


def _terms(w: W.Words) -> list[np.ndarray]:
    """Keys of each word's terms; a word no longer than a beginning has its own key again."""
    out = [W.mix(w.hash + np.uint64(1))]
    for size in BEGINNINGS:
        long = w.end - w.start > size
        begin = W.span_hashes(w.data, w.start, np.minimum(w.end, w.start + size))
        out.append(np.where(long, W.mix(begin + np.uint64(size)), out[0]))
    return out


def _words(batch: pa.RecordBatch) -> Iterator[tuple[W.Words, np.ndarray]]:
    label = batch.column(1).to_numpy()
    for at, texts in W.slices(batch.column(0), W.SMALL):
        w = W.words(texts, W.NOT_ALNUM)
        yield w, label[at:][w.unit]


def _added(parts: list[np.ndarray], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if known is not None:
        keys = keys[np.isin(keys, known)]
    return np.unique(keys, return_counts=True)


def _counts(rows: DataFrame, label: int, known: np.ndarray | None) -> DataFrame:
    """Occurrences of terms (of ``known`` ones) in the texts with a label: ``term, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, _ in _words(batch):
                parts = _terms(w)
                shorter = [p[p != parts[0]] for p in parts[1:]]
                keys, n = _added([parts[0], *shorter], known)
                yield pa.RecordBatch.from_pydict({"term": keys.view(np.int64), "n": n})

    some = rows.where(F.col("label") == label).select("text", "label")
    return some.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """``term, toxic, clean``: distinct contexts of each of ``known`` by label."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, label in _words(batch):
                edge = np.concatenate([[True], w.unit[1:] != w.unit[:-1], [True]])
                around = np.concatenate([[0], w.hash, [0]]).astype(np.uint64)
                before = np.where(edge[:-1], np.uint64(7), around[:-2])
                after = np.where(edge[1:], np.uint64(9), around[2:])
                context = W.mix(W.mix(before + w.hash) ^ after)
                own = _terms(w)
                for i, keys in enumerate(own):
                    at = np.isin(keys, known) & ((keys != own[0]) if i else True)
                    columns = {"term": keys[at].view(np.int64), "context": context[at].view(np.int64)}
                    yield pa.RecordBatch.from_pydict(columns | {"label": label[at].astype(np.int32)})

    found = rows.select("text", "label").mapInArrow(find, "term long, context long, label int").distinct()
    count = lambda x: F.count(F.when(F.col("label") == x, 1))
    return found.groupBy("term").agg(count(1).alias("toxic"), count(0).alias("clean"))


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds with a Dirichlet prior in proportion to the overall rate, and their standard score."""
    total = PRIOR * n_toxic
    prior = total * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic + total - a)) - np.log(b / (n_clean + total - b))
    return odds, odds / np.sqrt(1 / a + 1 / b)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    """Learn from ``labels.toxic`` of the rows outside the held-out fold. Without toxic or clean
    rows there are no terms and every document gets the rate of toxic rows (0.5 without rows).

    What reaches the driver follows the number of training rows, which has a bound."""
    rows = training_rows(docs, labels, "toxic", folds, held_out)
    sc = docs.sparkSession.sparkContext

    def keys(found: list) -> np.ndarray:
        return np.array([r["term"] for r in found], np.int64).view(np.uint64)

    found = _counts(rows, 1, None).where(F.col("n") >= LEAST_COUNT).collect()
    known, toxic = keys(found), np.array([r["n"] for r in found], float)
    order = np.argsort(known)
    known, toxic = known[order], toxic[order]
    n_words = lambda w: F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    sums = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(n_words(0)).alias("n")).collect()}
    n_toxic, n_clean = float(sums.get(1) or 1), float(sums.get(0) or 1)
    score = np.empty(0)
    scale = 1.0
    if len(known):
        clean = np.zeros(len(known))
        found = _counts(rows, 0, known).collect()
        clean[np.searchsorted(known, keys(found))] = [r["n"] for r in found]
        odds, z = _odds(toxic, clean, n_toxic, n_clean)
        known = known[(odds >= LEAST_ODDS) & (z >= LEAST_Z)]
        found = _contexts(rows, known).collect() if len(known) else []
        known = keys(found)
        toxic = np.array([r["toxic"] for r in found], float)
        clean = np.array([r["clean"] for r in found], float)
        odds, z = _odds(toxic, clean, n_toxic, n_clean)
        keep = (odds >= LEAST_ODDS) & (z >= LEAST_Z) & (toxic >= LEAST_COUNT)
        known, score, clean = known[keep], odds[keep], clean[keep]
        order = np.argsort(known)
        known, score = known[order], score[order]
        scale = _scale(score, (clean[order] + 0.5) / n_clean)
    model = Model(known, score, scale, [])
    shared = sc.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.array([_bin(x[0]) for x in _scored(batch.column(0), shared.value)], np.int32)
            yield pa.RecordBatch.from_pydict({"bin": bins, "label": batch.column(1)})

    held = rows.select("text", "label").mapInArrow(binned, "bin int, label int")
    held = held.groupBy("bin").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    positive, total = [0.0] * BINS, [0.0] * BINS
    for r in held:
        positive[r["bin"]], total[r["bin"]] = float(r["toxic"]), float(r["n"])
    return model._replace(rates=isotonic(positive, total))


def _scale(score: np.ndarray, rate: np.ndarray) -> float:
    """Lambda: where the expected ``exp(lambda * score)`` of a clean word is 1."""
    low, high = 0.0, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        grown = float(np.sum(rate * np.exp(mid * score)) + max(0.0, 1 - rate.sum()) * math.exp(-mid * COST))
        low, high = (mid, high) if grown < 1 else (low, mid)
    return max(low, 1e-3)


def _bin(evidence: float) -> int:
    return min(BINS - 1, math.ceil(4 * math.log2(1 + evidence)))


def segments(at: list[int], score: list[float]) -> list[tuple[int, int, float]]:
    """Maximal scoring segments ``(first, last, score)`` of words that score ``score`` at the places
    ``at`` and ``-COST`` elsewhere, left to right, in linear time."""
    out: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, done = 0.0, -1
    for place, value in zip(at, score):
        total -= COST * (place - done - 1)
        new = (place, place, total, total + value)
        total, done = total + value, place
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = (out[j][0], place, out[j][2], new[3])
            del out[j:]
    return [(a, b, after - before) for a, b, before, after in out]


def _scored(texts: pa.Array, model: Model) -> Iterator[tuple[float, list[tuple[int, int, float, float]]]]:
    """Evidence of each text and its significant segments: characters from and to, score, and how
    many such segments a clean text of the length has."""
    for _, part in W.slices(texts, W.SMALL):
        w = W.words(part, W.NOT_ALNUM)
        best = np.full(len(w.hash), -1.0)
        if len(model.key):
            for keys in _terms(w):
                found = np.minimum(np.searchsorted(model.key, keys), len(model.key) - 1)
                best = np.maximum(best, np.where(model.key[found] == keys, model.score[found], -1.0))
        hit = np.flatnonzero(best > 0)
        count = np.bincount(w.unit, minlength=len(part))
        first = np.cumsum(count) - count
        ends = np.searchsorted(w.unit[hit], np.arange(len(part)), "right")
        char = None
        low = 0
        for i, high in enumerate(ends.tolist()):
            evidence, spans = 0.0, []
            if high > low:
                own = hit[low:high]
                for a, b, s in segments((own - first[i]).tolist(), best[own].tolist()):
                    log_expected = math.log(K * int(count[i])) - model.scale * s
                    if log_expected <= math.log(MOST_EXPECTED):
                        evidence += math.log1p(math.exp(log_expected)) - log_expected
                        if char is None:
                            char = np.cumsum(np.concatenate([[0], (w.data & 0xC0) != 0x80]))
                        begin = int(char[w.offsets[i]])
                        span = char[w.start[first[i] + a]], char[w.end[first[i] + b]]
                        spans.append((int(span[0]) - begin, int(span[1]) - begin, s, math.exp(log_expected)))
            low = high
            yield evidence, spans


SCORES = "doc_id long, score double, evidence double, passages array<struct<start:long,end:long,score:double,expected:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``evidence`` and the significant ``passages`` (characters from
    ``start`` to ``end``) per row. Null and empty texts have no passage and the lowest score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            evidence, spans = [], []
            for e, s in _scored(batch.column(1), own):
                evidence.append(e)
                spans.append([dict(zip(("start", "end", "score", "expected"), x)) for x in s])
            columns = {
                "doc_id": batch.column(0),
                "score": pa.array([own.rates[_bin(e)] for e in evidence], pa.float64()),
                "evidence": pa.array(evidence, pa.float64()),
                "passages": pa.array(spans, pa.list_(passage)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(find, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, least: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``passages`` of every row of ``docs``.
    Rows that repeat get the same score each. Columns other than ``doc_id`` and ``text`` are not read."""
    out = score(docs, fit(docs, labels, folds, held_out))
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
        "passages",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text scores ``least`` or more; scored in place, no join."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def own(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.rates[_bin(e)] for e, _ in _scored(texts, shared.value)], pa.float64())

    return docs.where(own(F.coalesce(F.col("text").cast("string"), F.lit(""))) < least)
