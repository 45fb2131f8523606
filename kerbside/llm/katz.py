"""Operator 11: texts scored by a Katz backoff model that is learned from the corpus.

Counts come from all training texts. Counts up to ``LOW`` are discounted by Good-Turing (counts of
counts of the same order); what a context saves goes to the words it was not seen with, in
proportion to the next shorter context. The weight of that is exact: the saved mass over the mass
that the shorter context gives to unseen words, both summed over what was seen.

Texts are put into blocks and stay where they are. For each order a block sends its distinct n-grams
once, with their training counts, to the buckets of their contexts. A bucket adds up, writes its part
of the table of that order, and answers each block in the order of its message: counts, numbers for
the n-grams (which are the contexts of the next order), and sums per context. So the block knows the
probability of each of its tokens at this order, and what it needs of it for the next one. What is
shuffled is a few bytes per distinct n-gram of a block, whatever the number of copies.

A context with more tokens than a bucket has on average (``<start>``, frequent words) is dealt out
over several buckets by its followers; there are fewer of those than buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import words as W
from kerbside.llm.common import new_path, tasks
from kerbside.llm.labelled import remainder

#: Counts up to this one are discounted.
LOW = 5
#: Bytes of text in a block, or one longer text.
BLOCK_BYTES = 8 << 20
#: Buckets for each shuffle task.
BUCKETS = 4
START, UNKNOWN, FIRST_ID = 0, 1, 2
_END = np.uint64(0x8F3A2B1C5D6E7F01)
_SMALLEST = 1e-15

_MESSAGE = (
    "block long, bucket int, n_contexts int, contexts binary, widths binary, split binary, "
    "followers binary, counts binary, lower binary"
)
_REDUCED = (
    "kind string, block long, bucket int, contexts binary, widths binary, followers binary, "
    "counts binary, ids binary, totals binary, lower binary, numbers array<long>, seen double"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_()}


def _table(rows: list[dict], schema: str) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], _ARROW[k]) for n, k in fields})


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 on, by planes of bytes: those that are mostly zero compress to nothing."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return out.view("<u8").reshape(n)


class Order(NamedTuple):
    """What is known of one order: discounts of counts 1 to ``LOW``, sums of the split contexts, and
    of the first order all training tokens and distinct ones."""

    discount: np.ndarray
    split: np.ndarray  # contexts, ascending
    totals: np.ndarray  # of each: tokens, and followers with count 1 to LOW
    seen: np.ndarray  # of each: what the shorter context gives to the followers
    tokens: int
    types: int


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing discounts after Katz for counts 1 to ``LOW`` from the numbers of n-grams with
    count 1 to ``LOW + 1``. Where these give none between 0 and 1 (few or much copied texts), a
    count loses one half."""
    n = np.array(of_counts, float)
    r = np.arange(1, LOW + 1)
    if (n > 0).all():
        over = (LOW + 1) * n[LOW] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - over) / (1 - over) if over != 1 else np.zeros(LOW)
        if ((d > 0) & (d < 1)).all():
            return d
    return (r - 0.5) / r


def probabilities(
    counts: np.ndarray, lower: np.ndarray, totals: np.ndarray, seen: np.ndarray, discount: np.ndarray
) -> np.ndarray:
    """Of followers with ``counts`` in contexts with ``totals`` (tokens, and followers with each low
    count) and ``seen``. A context that saves nothing, as all its counts are high, is given one
    more token, and that goes to the unseen."""
    r = np.arange(1, LOW + 1)
    saved = totals[:, 1:] @ ((1 - discount) * r)
    nothing = saved <= 0
    tokens = totals[:, 0] + nothing
    saved = np.where(nothing, 1.0, saved)
    factor = np.concatenate([[0.0], discount, [1.0]])[np.minimum(counts, LOW + 1)]
    backoff = saved / tokens / np.maximum(1 - seen, _SMALLEST)
    return np.where(counts > 0, factor * counts / tokens, backoff * lower)


def _sorted(context: np.ndarray, follower: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Places in order of ``first``, context and follower."""
    keys = [k for k in (first, context, follower) if k is not None and len(k) and k.max() > 0]
    bits = [int(k.max()).bit_length() for k in keys]
    if not keys:
        return np.arange(len(context))
    if sum(bits) > 64:
        return np.lexsort(keys[::-1])
    one = np.zeros(len(context), np.uint64)
    for k, b in zip(keys, bits):
        one = (one << np.uint64(b % 64)) | k.astype(np.uint64)
    return np.argsort(one, kind="stable")


def _changes(*keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


class Grams(NamedTuple):
    """Distinct n-grams of a block in the order of its messages."""

    context: np.ndarray
    follower: np.ndarray
    bucket: np.ndarray
    split: np.ndarray
    counts: np.ndarray
    one: np.ndarray  # a token of each
    of: np.ndarray  # of each token used, its n-gram


def distinct(
    context: np.ndarray, follower: np.ndarray, size: np.ndarray, train: np.ndarray, buckets: int, tokens: int
) -> Grams:
    """``size`` is how often the context occurs. It decides over how many buckets it is dealt out."""
    at = _sorted(context, follower)
    new = _changes(context[at], follower[at])
    group = np.cumsum(new) - 1
    one = at[new]
    counts = np.bincount(group, weights=train[at], minlength=len(one)).astype(np.int64)
    context, follower = context[one], follower[one]
    parts = 1 + size[one].astype(np.int64) * buckets // max(tokens, 1)
    part = W.mix(follower) % parts.astype(np.uint64)
    bucket = (W.mix(W.mix(context) + part) % np.uint64(buckets)).astype(np.int64)
    order = _sorted(context, follower, bucket)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = np.empty(len(at), np.int64)
    of[at] = place[group]
    return Grams(context[order], follower[order], bucket[order], parts[order] > 1, counts[order], one[order], of)


def _spans(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(_changes(bucket))
    yield from zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)])


class Step(NamedTuple):
    own: Grams
    used: np.ndarray  # tokens that have a context of the order
    p: np.ndarray
    word_counts: np.ndarray | None


class Block:
    """Tokens of a block: the words of each text, then an end."""

    def __init__(self, docs: pa.Table) -> None:
        hashes, owner, seen = [], [], 0
        for at, part in W.slices(docs["text"], 1 << 18):
            w = W.words(part)
            ends = np.arange(len(part))
            where = np.concatenate([w.unit, ends])
            order = np.argsort(where, kind="stable")
            hashes.append(np.concatenate([w.hash, np.full(len(part), _END)])[order])
            owner.append(where[order] + at)
        self.rows = len(docs)
        self.doc = np.concatenate(owner)
        self.train = docs["train"].to_numpy()[self.doc].astype(np.int64)
        first = _changes(self.doc)
        self.place = np.arange(len(self.doc)) - np.flatnonzero(first)[self.doc]
        self.hash = np.concatenate(hashes)

    def step(self, known: list[Order], answers: list[list[dict]], buckets: int, more: bool) -> Step:
        """After the orders in ``known`` were answered: the probabilities of all tokens and, if there
        are to be ``more``, the n-grams of the next order."""
        n = len(self.hash)
        used, p, word_counts = np.arange(n), np.ones(n), None
        # the empty context is dealt out by its followers, as all tokens have it
        own = distinct(np.zeros(n, np.uint64), self.hash, np.ones(n), self.train, buckets, 1)
        for m, (order, rows) in enumerate(zip(known, answers), 1):
            counts, ids, totals, seen = self._answer(own, rows, order)
            made = probabilities(counts, p[used[own.one]], totals, seen, order.discount)
            p = p.copy()
            p[used] = made[own.of]
            held, held_counts = np.full(n, UNKNOWN, np.uint64), np.zeros(n, np.int64)
            held[used], held_counts[used] = ids[own.of], counts[own.of]
            if m == 1:
                words, word_counts = held, held_counts
            if m == len(known) and not more:
                break
            # the n-gram that ends before a token is its context; before the first stands the start
            context, size = np.roll(held, 1), np.roll(held_counts, 1)
            if m == 1:
                context[self.place == 0] = START
                size[self.place == 0] = word_counts[self.hash == _END][:1].sum()
            used = np.flatnonzero((size > 0) & (self.place >= m - 1))
            own = distinct(context[used], words[used], size[used], self.train[used], buckets, known[0].tokens)
        return Step(own, used, p, word_counts)

    @staticmethod
    def _answer(own: Grams, rows: list[dict], order: Order):
        """Counts and numbers of the n-grams, and totals and ``seen`` of their contexts."""
        spans, rows = list(_spans(own.bucket)), sorted(rows, key=lambda r: r["bucket"])
        if [r["bucket"] for r in rows] != [int(own.bucket[a]) for a, _ in spans]:
            raise ValueError("these are answers to another block")
        counts, ids = np.empty(len(own.one), np.int64), np.empty(len(own.one), np.uint64)
        totals, seen = np.empty((len(own.one), LOW + 1), np.int64), np.empty(len(own.one))
        for r, (a, b) in zip(rows, spans):
            counts[a:b], ids[a:b] = unpack(r["counts"], b - a), unpack(r["ids"], b - a)
            of = np.cumsum(_changes(own.context[a:b])) - 1
            n = int(of[-1]) + 1
            totals[a:b] = unpack(r["totals"], n * (LOW + 1)).reshape(LOW + 1, n).T[of]
            seen[a:b] = np.frombuffer(r["lower"], "<f8")[of]
        if own.split.any():
            at = np.searchsorted(order.split, own.context[own.split])
            totals[own.split], seen[own.split] = order.totals[at], order.seen[at]
        return counts, ids, totals, seen


def _messages(block: int, step: Step, order: int) -> pa.Table:
    """A row for each bucket that has n-grams of this block."""
    own, rows = step.own, []
    if order == 1:
        lower = np.zeros(len(own.one), np.int64)
    elif order == 2:  # the bucket knows what a word's count gives
        lower = step.word_counts[step.used[own.one]]
    else:
        lower = step.p[step.used[own.one]]
    for a, b in _spans(own.bucket):
        new = _changes(own.context[a:b])
        starts = np.flatnonzero(new)
        rows.append(
            {
                "block": block,
                "bucket": int(own.bucket[a]),
                "n_contexts": len(starts),
                "contexts": pack(np.diff(own.context[a:b][new], prepend=np.uint64(0))),
                "widths": pack(np.diff(starts, append=b - a)),
                "split": pack(own.split[a:b][new]),
                "followers": pack(own.follower[a:b]),
                "counts": pack(own.counts[a:b]),
                "lower": pack(lower[a:b]) if order < 3 else lower[a:b].astype("<f8").tobytes(),
            }
        )
    return _table(rows, _MESSAGE)


def _words_from_counts(counts: np.ndarray, words: Order) -> np.ndarray:
    """What the first order gives words with these counts."""
    n = len(counts)
    totals = np.repeat(words.totals, n, axis=0)
    return probabilities(counts, np.ones(n), totals, np.zeros(n), words.discount)


def _reduce(order: int, known: list[Order], buckets: int, last: bool):
    """Sums of the messages to one bucket: the rows of the table, of the answers, and sums. N-grams
    of the ``last`` order are no contexts and get no numbers."""

    def reduce(messages: pa.Table) -> pa.Table:
        bucket, rows = messages["bucket"][0].as_py(), messages.to_pylist()
        contexts, followers, counts, lower, split, ends = [], [], [], [], [], [0]
        for r in rows:
            n = r["n_contexts"]
            widths = unpack(r["widths"], n).astype(np.int64)
            size = int(widths.sum())
            contexts.append(np.repeat(np.cumsum(unpack(r["contexts"], n)), widths))
            split.append(np.repeat(unpack(r["split"], n), widths))
            followers.append(unpack(r["followers"], size))
            counts.append(unpack(r["counts"], size).astype(np.int64))
            lower.append(unpack(r["lower"], size) if order < 3 else np.frombuffer(r["lower"], "<f8"))
            ends.append(ends[-1] + size)
        contexts, followers, counts, lower, split = map(
            np.concatenate, (contexts, followers, counts, lower, split)
        )
        at = _sorted(contexts, followers)
        new = _changes(contexts[at], followers[at])
        starts = np.flatnonzero(new)
        group = np.empty(len(at), np.int64)
        group[at] = np.cumsum(new) - 1
        total = np.add.reduceat(counts[at], starts)
        context, follower, split = contexts[at][starts], followers[at][starts], split[at][starts]
        lower = lower[at][starts]
        if order == 2:
            lower = _words_from_counts(lower.astype(np.int64), known[0])
        ids = np.zeros(len(total), np.int64)
        if not last:  # numbers from 2 on, the frequent ones first; the buckets' numbers interleave
            rank = np.argsort(-total, kind="stable")
            ids[rank] = np.arange(len(total)) * buckets + bucket + FIRST_ID
            ids = np.where(total > 0, ids, UNKNOWN)

        first = _changes(context)
        heads, of = np.flatnonzero(first), np.cumsum(first) - 1
        low = [np.add.reduceat((total == r).astype(np.int64), heads) for r in range(1, LOW + 1)]
        totals = np.stack([np.add.reduceat(total, heads), *low])
        seen = np.add.reduceat(np.where(total > 0, lower, 0.0), heads)

        own = np.flatnonzero(total > 0)
        of_counts = [int((total == r).sum()) for r in range(1, LOW + 2)]
        out = [{"kind": "sums", "bucket": bucket, "numbers": [*of_counts, len(own), int(total.sum())]}]
        for k in np.flatnonzero(split[heads]):
            numbers = [int(context[heads[k]]), *totals[:, k].tolist()]
            out.append({"kind": "split", "bucket": bucket, "numbers": numbers, "seen": float(seen[k])})
        if len(own):
            held = np.unique(of[own])
            out.append(
                {
                    "kind": "table",
                    "bucket": bucket,
                    "contexts": pack(np.diff(context[heads[held]], prepend=np.uint64(0))),
                    "widths": pack(np.bincount(of[own], minlength=len(heads))[held]),
                    "followers": pack(follower[own]),
                    "counts": pack(total[own]),
                    "ids": pack(ids[own]),
                    "totals": pack(totals[:, held].ravel()),
                    "lower": seen[held].astype("<f8").tobytes(),
                    "numbers": [len(held), len(own)],
                }
            )
        for r, a, b in zip(rows, ends, ends[1:]):
            mine = of[group[a:b]]
            mine = mine[_changes(mine)]
            out.append(
                {
                    "kind": "answer",
                    "block": r["block"],
                    "bucket": bucket,
                    "counts": pack(total[group[a:b]]),
                    "ids": pack(ids[group[a:b]]),
                    "totals": pack(totals[:, mine].ravel()),
                    "lower": seen[mine].astype("<f8").tobytes(),
                }
            )
        return _table(out, _REDUCED)

    return reduce


def _blocks(docs: DataFrame, held_out: int, folds: int) -> DataFrame:
    """``block, doc_id, train, text`` of all rows, each block about ``BLOCK_BYTES`` of text. A bucketed
    table, so that blocks are met by their answers where they are and are not shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch["text"].cast(pa.large_binary())])
            blocks = np.empty(len(batch), np.int64)
            for i, size in enumerate(sizes.tolist()):
                if filled and filled + size > BLOCK_BYTES:
                    block, filled = block + 1, 0
                blocks[i], filled = block, filled + size
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *batch.columns], names=["block", *batch.schema.names])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (remainder(F.col("doc_id"), folds) != held_out).alias("train"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    spark, name = docs.sparkSession, "katz_blocks_" + uuid.uuid4().hex
    made = rows.mapInArrow(cut, "block long, doc_id long, train boolean, text string")
    made.write.bucketBy(tasks(spark), "block").option("compression", "zstd").option(
        "path", new_path(spark, "katz-blocks")
    ).saveAsTable(name)
    return spark.table(name)


def _known(reduced: DataFrame) -> Order:
    """Sums over the buckets; the split contexts are fewer than buckets."""
    parts = [F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(LOW + 3)]
    sums = [x or 0 for x in reduced.where("kind = 'sums'").agg(*parts).first()]
    parts = [F.sum(F.col("numbers")[i + 1]).alias(f"n{i}") for i in range(LOW + 1)]
    split = reduced.where("kind = 'split'").groupBy(F.col("numbers")[0].alias("context"))
    rows = sorted(split.agg(*parts, F.sum("seen").alias("seen")).collect())
    return Order(
        discounts(sums[: LOW + 1]),
        np.array([r[0] for r in rows], np.uint64),
        np.array([r[1 : LOW + 2] for r in rows], np.int64).reshape(-1, LOW + 1),
        np.array([r["seen"] for r in rows], float),
        sums[LOW + 2],
        sums[LOW + 1],
    )


def _met(blocks: DataFrame, reduced: list[DataFrame], work, schema: str) -> DataFrame:
    """``work(docs, answers of each order)`` on every block."""
    if not reduced:
        return blocks.groupBy("block").applyInArrow(_alone(work), schema)
    answers, orders = None, len(reduced)
    for k, r in enumerate(reduced):
        own = r.where("kind = 'answer'").select("block", F.lit(k).alias("order"), "bucket", "counts", "ids", "totals", "lower")
        answers = own if answers is None else answers.union(own)

    def meet(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        return work(docs, [[r for r in rows if r["order"] == k] for k in range(orders)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)


def _alone(work):
    def alone(docs: pa.Table) -> pa.Table:
        return work(docs, [])

    return alone


def train(blocks: DataFrame, order: int) -> tuple[list[DataFrame], list[Order]]:
    """Tables and sums of the orders 1 to ``order``; each order is a table partitioned by kind."""
    spark = blocks.sparkSession
    buckets = BUCKETS * tasks(spark)
    reduced: list[DataFrame] = []
    known: list[Order] = []
    for m in range(1, order + 1):
        messages = _met(blocks, reduced, _ask(list(known), buckets), _MESSAGE)
        path = new_path(spark, f"katz-{m}")
        sums = messages.groupBy("bucket").applyInArrow(_reduce(m, list(known), buckets, m == order), _REDUCED)
        sums.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        reduced.append(spark.read.schema(_REDUCED).parquet(path))
        known.append(_known(reduced[-1]))
    return reduced, known


def _ask(known: list[Order], buckets: int):
    def ask(docs: pa.Table, answers: list[list[dict]]) -> pa.Table:
        step = Block(docs).step(known, answers, buckets, more=True)
        return _messages(docs["block"][0].as_py(), step, len(known) + 1)

    return ask


def table_rows(reduced: DataFrame) -> DataFrame:
    """The n-grams of one order's table: ``context`` (number of the n-gram before; 0 is empty, or the
    start of a text), ``follower`` (number of the word; of single words, their hash), ``id`` (0 in the
    last order), ``n``, and the context's ``tokens, low`` (followers with count 1 to ``LOW``) and ``seen``."""
    schema = "context long, follower long, id long, n long, tokens long, low array<long>, seen double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, size = r["numbers"]
                widths = unpack(r["widths"], n).astype(np.int64)
                totals = unpack(r["totals"], n * (LOW + 1)).astype(np.int64).reshape(LOW + 1, n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "context": np.repeat(np.cumsum(unpack(r["contexts"], n)), widths).astype(np.int64),
                        "follower": unpack(r["followers"], size).view(np.int64),
                        "id": unpack(r["ids"], size).astype(np.int64),
                        "n": unpack(r["counts"], size).astype(np.int64),
                        "tokens": np.repeat(totals[0], widths),
                        "low": pa.array(np.repeat(totals[1:].T, widths, axis=0).tolist(), pa.list_(pa.int64())),
                        "seen": np.repeat(np.frombuffer(r["lower"], "<f8"), widths),
                    }
                )

    names = ["contexts", "widths", "followers", "counts", "ids", "totals", "lower", "numbers"]
    return reduced.where("kind = 'table'").select(*names).mapInArrow(rows, schema)


def scores(docs: DataFrame, order: int = 2, folds: int = 7, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Words are cut at ASCII white space after A-Z became a-z; each text has one token more, its end.
    The model learns from the rows whose crc32 of ``doc_id`` modulo ``folds`` is not ``held_out``.
    ``score`` is the log10 of what it gives the text, all unknown words being one event; ``base_score``
    is that of single words with one added to each count.

    Null and empty texts are an end alone. A null ``doc_id`` counts as empty text for the fold. Repeated
    rows are learned and returned each. Without training tokens every token has probability 1. Texts
    of any length are used whole. No rows: none. Other columns are not read. Words are known by 64
    bits of hash, n-grams by exact numbers."""
    blocks = _blocks(docs, held_out, folds)
    buckets = BUCKETS * tasks(docs.sparkSession)
    reduced, known = train(blocks, order)
    tokens, types = known[0].tokens, known[0].types
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )

    def score(docs: pa.Table, answers: list[list[dict]]) -> pa.Table:
        block = Block(docs)
        step = block.step(known, answers, buckets, more=False)
        base = np.log10((step.word_counts + 1) / (tokens + types + 1))
        sums = [np.bincount(block.doc, weights=x, minlength=block.rows) for x in (base, np.log10(step.p))]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(~docs["train"].to_numpy()),
                "n_tokens": np.bincount(block.doc, minlength=block.rows).astype(np.int64),
                "n_known": np.bincount(block.doc, weights=step.word_counts > 0, minlength=block.rows).astype(np.int64),
                "train_tokens": np.full(block.rows, tokens, np.int64),
                "base_score": sums[0],
                "score": sums[1],
            }
        )

    return _met(blocks, reduced, score, schema)
