"""Operator 6: document quality from text statistics.

A text becomes a few dozen statistics. Random Fourier features make an inner product of them
approximate a Gaussian kernel, so ridge regression on the features is kernel regression with a
model of fixed size. Every task sums its part of the normal equations; their sum is solved once.
Isotonic regression on binned scores turns the result into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import words as W
from kerbside.llm.labelled import isotonic, remainder, training_rows

FEATURES = 384
#: Width of the kernel in standard deviations, and the ridge per row.
WIDTH = 5.0
RIDGE = 1e-4
BINS = 200

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?'\"",
    "mark": b"!#$%&*+=@\\^_`~",
    "bar": b"|<>{}[]/()-",
    "space": W.SPACES,
    "high": range(0x80, 0x100),
}


class Model(NamedTuple):
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    solution: np.ndarray
    low: float
    high: float
    rates: list[float]


def statistics(part: pa.LargeStringArray) -> np.ndarray:
    """One row of statistics per text of a slice; all are 0 for a text without words."""
    w = W.words(part, lines=True)
    raw, offsets = W.body(part)
    rows, size = len(part), np.diff(offsets).astype(float)
    row = w.unit_row[w.unit]
    n = np.bincount(row, minlength=rows).astype(float)

    def rate(flags: np.ndarray, of: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=flags, minlength=rows) / np.maximum(total, 1)

    byte_row = np.repeat(np.arange(rows), np.diff(offsets))
    out = [np.log1p(n), np.log1p(size)]
    tail = np.zeros((256,), np.int64)
    for i, some in enumerate(_CLASSES.values()):
        tail[list(some)] = i + 1
    kind = tail[raw]
    shares = np.bincount(byte_row * 9 + kind, minlength=rows * 9).reshape(-1, 9)
    out += list((shares / np.maximum(size, 1)[:, None]).T)
    length = (w.end - w.start).astype(float)
    mean = rate(length, row, n)
    out += [mean, np.sqrt(np.maximum(0, rate(length**2, row, n) - mean**2))]
    out += [rate(length == 1, row, n), rate(length > 15, row, n)]
    last = kind[w.end - 1] if len(w.end) else np.empty(0, int)
    first = kind[w.start] if len(w.start) else np.empty(0, int)
    out += [rate(last == k, row, n) for k in range(1, 9)]
    out += [rate(first == k, row, n) for k in (1, 3, 5, 6)]
    # words that repeat: the one before, the one ten before, anywhere in the text
    for step in (1, 2, 10):
        same = np.zeros(len(row), bool)
        if len(row) > step:
            same[step:] = (w.hash[step:] == w.hash[:-step]) & (row[step:] == row[:-step])
        out.append(rate(same, row, n))
    order = np.lexsort((w.hash, row))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
    out.append(rate(new, row[order], n))
    # the share of words in lines that repeat words, shout or end words with marks
    lines = len(w.unit_start)
    held = np.maximum(np.bincount(w.unit, minlength=lines), 1)
    for flags in (last == 5, last == 6, first == 1, np.concatenate([[False], w.hash[1:] == w.hash[:-1]])[: len(row)]):
        heavy = np.bincount(w.unit, weights=flags, minlength=lines) / held > 0.3
        out.append(rate(heavy[w.unit], row, n))
    used = np.bincount(w.unit_row, weights=np.bincount(w.unit, minlength=lines) > 0, minlength=rows)
    out += [np.log1p(used), np.log1p(n / np.maximum(used, 1))]
    stats = np.stack(out, axis=1)
    stats[n == 0] = 0
    return stats


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, part in W.slices(batch.column(0)):
                x = statistics(part)
                now = np.stack([np.ones(x.shape[1]) * len(x), x.sum(0), (x**2).sum(0)])
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(total.shape[1], dtype=np.int32), "n": total[0], "s": total[1], "q": total[2]})

    sums = rows.select("text").mapInArrow(add, "i int, n double, s double, q double")
    sums = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    found = sorted(sums.collect(), key=lambda r: r["i"])
    mean = np.array([r["s"] / r["n"] for r in found])
    deviation = np.sqrt(np.maximum(0, np.array([r["q"] / r["n"] for r in found]) - mean**2))
    return mean, np.where(deviation > 1e-9, deviation, 1.0)


def _features(part: pa.LargeStringArray, model: Model) -> np.ndarray:
    x = np.clip((statistics(part) - model.mean) / model.deviation, -8, 8)
    z = np.cos(x @ model.weights + model.shift) * np.sqrt(2 / FEATURES)
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model | None:
    """Learn from ``labels.quality`` of the rows outside the held-out fold; None without rows."""
    rows = training_rows(docs, labels, "quality", folds, held_out)
    if rows.isEmpty():
        return None
    sc = docs.sparkSession.sparkContext
    mean, deviation = _moments(rows)
    random = np.random.default_rng(7)
    weights = random.normal(size=(len(mean), FEATURES)) / WIDTH
    shift = random.uniform(0, 2 * np.pi, FEATURES)
    model = Model(mean, deviation, weights, shift, np.zeros(FEATURES + 1), 0.0, 1.0, [])
    shared = sc.broadcast(model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            label = batch.column(1).to_numpy()
            for at, part in W.slices(batch.column(0)):
                z = _features(part, shared.value)
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ label[at : at + len(z)]
        for i, line in enumerate(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "line": [line.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(line)
        for i, line in sums.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "line": [line.tobytes()]})

    schema = "i int, line binary"
    parts = rows.select("text", "label").mapInArrow(normal, schema)
    sums = parts.repartition(8, "i").mapInArrow(add, schema)
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in sums.collect():  # FEATURES lines, whatever the rows
        total[r["i"]] += np.frombuffer(r["line"])
    n = total[-1, -2]
    ridge = RIDGE * n * np.eye(FEATURES + 1)
    ridge[-1, -1] = 0
    model = model._replace(solution=np.linalg.solve(total[:, :-1] + ridge, total[:, -1]))
    shared_fit = sc.broadcast(model._replace(low=-0.5, high=1.5))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.concatenate([_bins(part, shared_fit.value) for _, part in W.slices(batch.column(0))])
            yield pa.RecordBatch.from_pydict({"bin": bins.astype(np.int32), "label": batch.column(1)})

    held = rows.select("text", "label").mapInArrow(binned, "bin int, label int")
    held = held.groupBy("bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good, count = [0.0] * BINS, [0.0] * BINS
    for r in held:
        good[r["bin"]], count[r["bin"]] = float(r["good"]), float(r["n"])
    return shared_fit.value._replace(rates=isotonic(good, count))


def _bins(part: pa.LargeStringArray, model: Model) -> np.ndarray:
    value = _features(part, model) @ model.solution
    return np.clip((value - model.low) / (model.high - model.low) * BINS, 0, BINS - 1).astype(int)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) per row; null text counts as empty. Without a model 0.5."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = np.array(shared.value.rates)
        for batch in batches:
            for at, part in W.slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "score": rates[_bins(part, shared.value)]})

    return rows.mapInArrow(find, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, least: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``. Rows that repeat get
    the same score each. Columns other than ``doc_id`` and ``text`` are not read."""
    out = score(docs, fit(docs, labels, folds, held_out))
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
