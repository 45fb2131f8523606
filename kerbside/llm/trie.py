"""Operator 13: the prefix trie of conversations.

Nothing but digests moves: each turn becomes a digest where it is read, and every prefix of a
conversation a key chained from them. Identical conversations are collapsed first into one weighted
sequence with the list of those that end there; only the prefixes of distinct sequences go on. A
sequence that is a proper prefix of another is no leaf (anti-join). Nodes are the prefixes,
grouped, with the weights summed.

Sums over subtrees need no walk through the tree. A node's own value is put on one sequence, that of
its smallest member. There values are summed from the end, so each prefix of the sequence has what
lies at or below it, and the sums of all sequences with that prefix are the node's.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import stored, tasks

#: Most turns taken from another conversation, and how many conversations share one.
MOST_SHARED = 5
FAMILY = 100
ROOT = bytes(16)
#: Most ids in one piece of an end list.
PIECE = 1 << 14

_PREFIX = "conv_id long, depth int, key binary, parent binary, chars long, last boolean"


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, chars`` of every turn, ``pos`` from 1; stored. Texts end here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(
            F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
        ).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    rows = rows.withColumn("pos", F.row_number().over(order))
    return stored(rows.select("conv_id", "pos", "digest", "chars"), "trie-turns")


def rebuilt(own: DataFrame) -> DataFrame:
    """The turns of every rebuilt conversation: ``conv_id, part, pos, digest, chars``. Part 0 is a
    row for the conversation itself, part 1 what it shares, part 2 its own turns."""
    names = ["conv_id", "part", "pos", "digest", "chars"]
    conv = F.col("conv_id")
    marks = own.where("pos = 1").withColumns(
        {"part": F.lit(0), "digest": F.lit(None).cast("binary"), "chars": F.lit(0).cast("long")}
    )
    heads = own.where((conv % FAMILY == 0) & (F.col("pos") <= MOST_SHARED))
    heads = heads.withColumnRenamed("conv_id", "base").withColumn("part", F.lit(1))
    wanted = marks.select("conv_id", (conv - conv % FAMILY).alias("base"), shared_turns(conv).alias("h"))
    taken = wanted.join(heads, "base").where("pos <= h")
    rest = own.where(F.col("pos") > shared_turns(conv)).withColumn("part", F.lit(2))
    return marks.select(names).union(taken.select(names)).union(rest.select(names))


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one too: ``conv_id, depth, key, parent,
    chars`` (of its last turn) and ``last`` (it is the whole conversation); stored."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "key", "parent", "chars", "last"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        held = None  # its successor decides whether it is the last of its conversation
        for batch in batches:
            out = []
            for conv, part, digest, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "digest", "chars"))):
                if held is not None:
                    out.append((*held, part == 0))
                if part == 0:
                    held = (conv, 0, ROOT, None, 0)
                else:
                    key = sha256(held[2] + digest).digest()[:16]
                    held = (conv, held[1] + 1, key, held[2], chars)
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*held, True), kinds)], names=names)

    keys = ["conv_id", "part", "pos"]
    rows = rebuilt(turns(conversations))
    rows = rows.repartition(tasks(rows.sparkSession), "conv_id").sortWithinPartitions(*keys)
    return stored(rows.mapInArrow(chain, _PREFIX), "trie-prefixes")


def end_lists(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``ends`` (``key, conv_id``): the digest of each key's ids, ascending,
    joined by commas.

    Ids are joined in pieces by all tasks, which range over keys and ids. A digest is a chain, so the
    pieces of one key then pass through one task, as a stream: it holds one piece at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch["key"].to_pylist(), batch["conv_id"].to_pylist()
            out, at = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at] or i - at == PIECE:
                    out.append((keys[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            columns = list(zip(*out)) or [[]] * 3
            kinds = (pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names=["key", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if k == key:
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, sha256(ids.encode())
            columns = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns, (pa.binary(), pa.string()))], names=["key", "ends_sha256"]
            )
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [running.hexdigest()]})

    n = tasks(ends.sparkSession)
    dealt = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id")
    dealt = dealt.sortWithinPartitions("key", "conv_id")
    joined = dealt.mapInArrow(pieces, "key binary, first long, ids string")
    joined = joined.repartition(n, "key").sortWithinPartitions("key", "first")
    return joined.mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` has ``conv_id, turn, role, text``. Turns are ordered by ``turn``, null first,
    those of one number by role and then by a digest of the text; a row that repeats is a turn of
    its own. A null role or text is empty. Rows without a ``conv_id`` belong to no conversation and
    are left out. Conversations rebuilt without any turn are members of the root. No conversations:
    no rows. Other columns are not read. Turns are known by 128 bits of chained SHA-256. A conversation
    of any length is one sorted stream and never held whole.
    """
    every = prefixes(conversations)
    ends = every.where("last")
    sequences = ends.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")
    )
    sequences = stored(sequences, "trie-sequences")
    kept = stored(every.join(sequences.select("conv_id", "weight"), "conv_id"), "trie-kept")
    inner = kept.where("not last").select("key").distinct()
    leaves = sequences.join(inner, "key", "left_anti")

    # depth, parent and chars follow from the key
    nodes = kept.groupBy("key", "depth", "parent", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")
    )
    nodes = stored(nodes, "trie-nodes")

    none, zero = F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long")
    cost = (F.col("n_convs") - 1) * F.col("chars")
    values = (
        kept.select("conv_id", "depth", "key", zero.alias("saved"), zero.alias("leaf"))
        .union(nodes.select("conv_id", "depth", none, cost, zero))
        .union(leaves.select("conv_id", "depth", none, zero, F.lit(1).cast("long")))
    )
    # of a sequence, what stands at this depth or deeper
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    values = values.select("key", F.sum("saved").over(below).alias("saved"), F.sum("leaf").over(below).alias("leaf"))
    totals = values.where("key is not null").groupBy("key").agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")
    )
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "key").join(children, "key", "left").join(end_lists(ends), "key", "left")
    return out.join(above, "parent", "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )
