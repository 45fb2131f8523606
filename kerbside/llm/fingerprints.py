"""Operator 7: MinHash fingerprints of documents.

A text's set of five-word shingles is reduced to the least value under each of ``SIZE`` universal
hash functions, in numpy. Equal places of two fingerprints estimate the Jaccard similarity of
the sets. ``near_groups`` joins bands of fingerprints in Spark and verifies the pairs on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import setjoin as S
from kerbside.llm import words as W
from kerbside.llm.common import tasks
from kerbside.llm.ngram_join import linked

SHINGLE = 5
SIZE = 128
#: Minima to a band: two texts of similarity s share a band with 1 - (1 - s**4)**32, at 0.8 all
#: but one pair in twenty million.
BAND = 4
#: Five words, similarity 0.8; bands have no order that would bound an intersection.
NEAR = S.Join(k=SHINGLE, num=80, den=100, positions=False)
_EMPTY = np.uint16(0xFFFF)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts: x -> (a * x + b) >> 32 modulo 2**64 is a universal family."""
    random = np.random.default_rng(1)
    a, b = random.integers(0, 1 << 63, (2, SIZE), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signatures(part: pa.LargeStringArray) -> np.ndarray:
    """One row of ``SIZE`` unsigned 32-bit minima per text of a slice; all ones without words."""
    h, unit = W.shingles(W.words(part), SHINGLE)
    h = h[np.argsort(unit, kind="stable")]
    count = np.bincount(unit, minlength=len(part))
    return _minima(h, count)


def _minima(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Minima of the hashes of each unit, which has ``count`` of them; all ones if none."""
    a, b = _functions()
    h = h >> np.uint64(32)
    out = np.full((len(count), SIZE), 0xFFFFFFFF, np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        start = (np.cumsum(count) - count)[some]
        for i in range(SIZE):
            out[some, i] = np.minimum.reduceat((h * a[i] + b[i]) >> np.uint64(32), start)
    return out.astype(np.uint32)


def _bands(sets: S.Sets, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One token per band of each marked unit: its number and its minima, hashed."""
    minima = _minima(sets.hash, sets.n)[leads].astype(np.uint64)
    bands = [W.mix(np.full(len(minima), i, np.uint64)) for i in range(SIZE // BAND)]
    for i in range(SIZE):
        bands[i // BAND] = W.mix(bands[i // BAND] + minima[:, i])
    return np.stack(bands, axis=1).ravel(), np.where(leads, SIZE // BAND, 0)


def near_groups(docs: DataFrame, join: S.Join = NEAR) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``links`` per row of ``docs``, as in
    ``ngram_join.similar_documents`` (which states nulls, empty texts and repeated rows).

    Sets meet by equal bands of their fingerprints instead of a prefix. Pairs are verified on the
    shingles of the whole texts, so every link is real; ``BAND`` states how many are found."""
    base = S.base(docs)
    return linked(base, S.digested(base, join, _bands, "band-digest"), join)


def _fingerprints(texts: list[str]) -> np.ndarray:
    """The low 16 bits of the minima: unequal minima agree in them once in 65536."""
    found = [signatures(part) for _, part in W.slices(pa.array(texts, pa.string()), 1 << 19)]
    return np.concatenate(found).astype(np.uint16) if found else np.empty((0, SIZE), np.uint16)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _chains(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of ``doc_id``, each range followed by the first row of the next one
    (``head``; the last by the first of all), so every row meets the one after it in a task."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 4 * tasks(spark)
    at = sorted(set(rows.select("key").approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)))
    # an empty table has no quantiles, and there must be one cut
    cuts = Bucketizer(splits=[-float("inf"), *(at or [0.0]), float("inf")], inputCol="number", outputCol="range")
    rows = cuts.transform(rows.withColumn("number", F.col("key").cast("double"))).drop("number")
    rows = rows.withColumn("range", F.col("range").cast("int"))
    # one row per range: bounded by the number of ranges
    heads = sorted((r["range"], r["key"]) for r in rows.groupBy("range").agg(F.min("key").alias("key")).collect())
    to = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    to = F.broadcast(spark.createDataFrame(to, "key long, to int"))
    copies = rows.join(to, "key").select("doc_id", "key", "text", F.col("to").alias("range"), F.lit(1).alias("head"))
    every = rows.withColumn("head", F.lit(0)).unionByName(copies)
    return every.repartition(tasks(spark), "range").sortWithinPartitions("range", "head", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for every row of ``docs``.

    ``near_edited`` and ``near_next`` are the shares of equal places with the fingerprint of the
    edited text and of the next row, in ascending ``doc_id`` (nulls first, rows of one ``doc_id`` by
    their texts; the last is followed by the first; a single row by itself). Null text is empty;
    texts without words have one fingerprint of their own. Other columns are not read."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next one, with its fingerprint
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                ids, texts, ranges, heads = (batch.column(i).to_pylist() for i in range(4))
                prints = list(_fingerprints(texts))
                rows = list(zip(ids, texts, ranges, heads, prints))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[3] and x[2] == y[2]]
                if pairs:
                    yield _compared(pairs)

    return _chains(docs).select("doc_id", "text", "range", "head").mapInArrow(find, SCHEMA)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [edited(x[1], y[1]) for x, y in pairs]
    other = _fingerprints(texts)
    own, following = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([x[0] for x, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            "fingerprint": [x.tobytes().hex() for x in own],
            "edited_fingerprint": [x.tobytes().hex() for x in other],
            "near_edited": (own == other).mean(axis=1),
            "near_next": (own == following).mean(axis=1),
        }
    )
