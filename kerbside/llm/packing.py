"""Operator 9: documents packed into sequences of at most ``capacity`` tokens.

How many pieces there are of each length is all that the placement needs: at most ``capacity``
numbers, whatever the documents. From them ``place`` makes runs of equal placements; every
piece then finds its own by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import sized, stored
from kerbside.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Run(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank`` on: ``each`` to a sequence, ``sequences``
    sequences from ``first`` on, the first piece of each at ``offset``."""

    length: int
    rank: int
    sequences: int
    each: int
    first: int
    offset: int


def place(counts: dict[int, int], capacity: int) -> list[Run]:
    """Placement of ``counts[length]`` pieces of each length.

    Pieces above a third of the capacity go first, longest first, each with the longest that
    still fits beside it: no more than two of them fit in a sequence. Then smaller ones, longest
    first, go where they leave the least room (best fit), and into new sequences if nowhere.
    Sequences that are filled alike are one entry, so the work follows the number of lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    sequences = 0

    def put(n: int, first: int, many: int, each: int, offset: int) -> None:
        runs.append(Run(n, rank[n], many, each, first, offset))
        rank[n] += many * each
        left[n] -= many * each
        if room := capacity - offset - n * each:
            gaps.setdefault(room, []).append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mates = [m for m in large if m <= n and left[m] and n + m <= capacity]
            mate = next((m for m in mates if m != n or left[n] > 1), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            if mate is None:
                put(n, sequences, many, 1, 0)
            else:
                runs.append(Run(n, rank[n], many, 1, sequences, 0))
                rank[n] += many
                left[n] -= many
                put(mate, sequences, many, 1, n)
            sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = min((g for g in gaps if g >= n), default=None)
            if room is None:
                each = min(capacity // n, left[n])
                many = left[n] // each
                put(n, sequences, many, each, 0)
                sequences += many
                continue
            first, many = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            each = min(room // n, left[n])
            some = min(many, left[n] // each)
            if some < many:
                gaps.setdefault(room, []).append((first + some, many - some))
            put(n, first, some, each, capacity - room)
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document with the place of each among the task's pieces of its length
    (``part``, ``nth``). A document is its ids and ``end_id``; longer ones than ``capacity`` are cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            names = [x.split()[0] for x in PIECES.split(", ")]
            out: dict[str, list] = {x: [] for x in names}
            for doc, ids in zip(batch.column(0).to_pylist(), own.batch(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own_ids = ids[start : start + capacity]
                    row = (doc, piece, start, len(own_ids), zlib.crc32(own_ids), part, int(seen[len(own_ids)]))
                    seen[len(own_ids)] += 1
                    for name, value in zip(names, row):
                        out[name].append(value)
            kinds = {"piece": pa.int32(), "part": pa.int32()}
            yield pa.RecordBatch.from_pydict(
                {x: pa.array(v, kinds.get(x, pa.int64())) for x, v in out.items()}
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(cut, PIECES), "pack-pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of
    every piece of every row of ``docs``.

    A null or empty text is the end id alone. Rows that repeat are packed each. A null
    ``doc_id`` is packed like any other. Other columns are not read."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, end_id, capacity)
    # pieces of a length in a task are consecutive ranks: tasks x lengths rows, summed up
    held = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("held"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("held").alias("n")).collect()}
    runs = place(counts, capacity)
    starts: dict[int, list[Run]] = {}
    for run in runs:
        starts.setdefault(run.length, []).append(run)
    table = {
        n: np.array([x[1:] for x in sorted(some)], np.int64) for n, some in starts.items()
    }
    table = spark.sparkContext.broadcast(table)
    from pyspark.sql import Window

    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0))).drop("held")
    before = stored(before, "pack-ranks")
    placed = cut.join(sized(before, 32), ["part", "length"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                at, run = np.flatnonzero(length == n), known[int(n)]
                of = run[np.searchsorted(run[:, 0], rank[at], "right") - 1]
                nth = rank[at] - of[:, 0]
                sequence[at] = of[:, 3] + nth // of[:, 2]
                offset[at] = of[:, 4] + nth % of[:, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    placed = placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return placed.mapInArrow(
        find,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
