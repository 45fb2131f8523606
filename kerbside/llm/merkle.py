"""Operator 12: a Merkle manifest, kept as a postorder append log.

Every ``FAN`` consecutive nodes of a tree (the last run may be shorter) have one parent, until one
node is left. The log of a tree holds its nodes in the order in which they are complete. So where
a node stands follows from its level, its index and the number of leaves alone (``position``), and
whoever wants a proof addresses the siblings directly.

The log is written by builders. A builder takes ``FAN ** LEVELS`` consecutive nodes from a multiple
of that number on, completes all that lies above them up to ``LEVELS`` levels, and writes one
segment. The tops of the segments are the nodes of the next round, so the rounds grow with the
logarithm of the largest tree, and no task holds more than one segment. Trees of any number and
size are built side by side; their roots are the leaves of one more tree.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import ascii_lower, sized, stored, tasks

FAN = 16
#: Levels that a builder completes.
LEVELS = 2
SPAN = FAN**LEVELS
_SEGMENT = (
    "tree string, block long, n long, levels int, first long, nodes binary, "
    "ids array<long>, tampered binary"
)
_PATH = "array<struct<before:binary,after:binary>>"


def node_digest(children: list[bytes]) -> bytes:
    """Digest of a node: of its children's digests as hexadecimal text."""
    return sha256(b"".join(children).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """Where a node stands in the log of ``n`` leaves.

    Node ``index`` of ``level`` is complete after its last leaf and the levels between. Before that
    leaf stand the leaves before it and, of each level, the nodes that these filled: the sizes of
    the subtrees to the left."""
    last = min((index + 1) * FAN**level, n) - 1
    at, leaves = last + level, FAN
    while leaves <= last:
        at += last // leaves
        leaves *= FAN
    return at


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes over ``leaves`` up to ``levels``, in the order in which they are complete."""
    log: list[bytes] = []
    unfinished: list[list[bytes]] = [[] for _ in range(levels + 1)]
    for i, node in enumerate(leaves):
        for level in range(levels + 1):
            log.append(node)
            unfinished[level].append(node)
            if level == levels or (len(unfinished[level]) < FAN and i < len(leaves) - 1):
                break
            node = node_digest(unfinished[level])
            unfinished[level] = []
    return log


def siblings(log: list[bytes], leaf: int, n: int, levels: int) -> list[tuple[bytes, bytes]]:
    """Of each level from the leaf up: the digests of its run before its own, and after it."""
    path, width = [], n
    for level in range(levels):
        own, low = leaf, leaf // FAN * FAN
        run = range(low, min(low + FAN, width))
        held = [log[position(level, i, n)] for i in run]
        path.append((b"".join(held[: own - low]), b"".join(held[own - low + 1 :])))
        leaf, width = leaf // FAN, -(-width // FAN)
    return path


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = node_digest([before, leaf, after])
    return leaf


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``rank`` in their ``tree`` (from 0, by ``order``) and ``n``, its leaves.

    Rows are dealt out by ranges of tree and order, so a tree with most of the rows is in many
    tasks; a row's rank is its place in its range and the rows of its tree in ranges before."""
    keys = ["tree", *order]
    dealt = leaves.repartitionByRange(tasks(leaves.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "merkle-ranges")
    part = F.shiftright("place", 33)
    starts = dealt.groupBy("tree", part.alias("part")).agg(
        F.min("place").alias("start"), F.count(F.lit(1)).alias("rows")
    )
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        F.col("tree").alias("in_tree"),
        "part",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("start")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    starts = sized(stored(starts, "merkle-starts"), 256)
    same = dealt["tree"].eqNullSafe(starts["in_tree"]) & (part == starts["part"])
    joined = dealt.join(starts, same).withColumn("rank", F.col("place") + F.col("shift"))
    return joined.drop("in_tree", "part", "place", "shift")


def _build(nodes: DataFrame, name: str) -> DataFrame:
    """One segment of the log per block of nodes (``tree, rank, n, digest``, and ``doc_id`` and
    ``tampered`` of leaves); stored."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        n, block = rows["n"][0].as_py(), rows["block"][0].as_py()
        levels = min(LEVELS, height(n))
        log = append_log(rows["digest"].to_pylist(), levels)
        out = {
            "tree": rows["tree"][:1],
            "block": [block],
            "n": [n],
            "levels": [levels],
            "first": [position(0, block * SPAN, n)],
            "nodes": [b"".join(log)],
            "ids": [rows["doc_id"].to_pylist()],
            "tampered": [b"".join(x or b"" for x in rows["tampered"].to_pylist())],
        }
        schema = pa.schema(
            [("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("levels", pa.int32()),
             ("first", pa.int64()), ("nodes", pa.binary()), ("ids", pa.list_(pa.int64())),
             ("tampered", pa.binary())]
        )
        return pa.table(out, schema=schema)

    blocks = nodes.withColumn("block", F.floor(F.col("rank") / SPAN).cast("long"))
    return stored(blocks.groupBy("tree", "block").applyInArrow(build, _SEGMENT), name)


def append_logs(leaves: DataFrame) -> list[DataFrame]:
    """The segments of the logs of all trees, a table for each round of building. ``leaves`` has
    ``tree, rank, n, digest, doc_id, tampered`` (see ``ranked``)."""
    rounds = [_build(leaves, "merkle-log-0")]
    while True:
        last = rounds[-1]
        more = last.where(F.col("n") > SPAN)
        if more.isEmpty():
            return rounds
        nodes = more.select(
            "tree",
            F.col("block").alias("rank"),
            F.ceil(F.col("n") / SPAN).cast("long").alias("n"),
            F.expr("substring(nodes, -32, 32)").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )
        rounds.append(_build(nodes, f"merkle-log-{len(rounds)}"))


def _entries(base: int):
    """Nodes of a segment whose lowest level is ``base``; above 0 that level stands in segments below."""

    def entries(rows: pa.Table) -> pa.Table:
        n, leaves = rows["n"][0].as_py(), rows["leaves"][0].as_py()
        block, log = rows["block"][0].as_py(), rows["nodes"][0].as_py()
        held = min(SPAN, n - block * SPAN)
        made, start, width = [], block * SPAN, held
        for level in range(rows["levels"][0].as_py() + 1):
            for i in range(width if level or not base else 0):
                at, index = 32 * position(level, i, held), start + i
                made.append((position(base + level, index, leaves), base + level, index, log[at : at + 32]))
            start, width = start // FAN, -(-width // FAN)
        columns = list(zip(*made)) or [[]] * 4
        tree = pa.array([rows["tree"][0].as_py()] * len(made), pa.string())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table(
            [tree, *map(pa.array, columns, kinds)], names=["tree", "position", "level", "index", "digest"]
        )

    return entries


def log_entries(rounds: list[DataFrame]) -> DataFrame:
    """Every node of the logs: ``tree, position, level, index, digest``."""
    leaves = rounds[0].groupBy("tree").agg(F.first("n").alias("leaves"))
    of = leaves.select(F.col("tree").alias("in_tree"), "leaves")
    schema = "tree string, position long, level int, index long, digest binary"
    out = None
    for k, segments in enumerate(rounds):
        rows = segments.join(of, segments["tree"].eqNullSafe(of["in_tree"])).drop("in_tree", "ids", "tampered")
        part = rows.groupBy("tree", "block").applyInArrow(_entries(k * LEVELS), schema)
        out = part if out is None else out.union(part)
    return out


def tops(rounds: list[DataFrame]) -> DataFrame:
    """``tree`` and the ``digest`` of its last node."""
    out = None
    for segments in rounds:
        done = segments.where(F.col("n") <= SPAN).select("tree", F.expr("substring(nodes, -32, 32)").alias("digest"))
        out = done if out is None else out.union(done)
    return out


def _paths(segments: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """``tree, block, top, path`` of every node that ``segments`` were built over: its siblings
    within its segment, then those of the segment's top (``above``)."""
    schema = f"tree string, block long, top binary, path {_PATH}"

    def paths(rows: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        log = _cut(row["nodes"])
        n = min(SPAN, row["n"] - row["block"] * SPAN)
        higher = [(x["before"], x["after"]) for x in row["path"]]
        found = [siblings(log, i, n, row["levels"]) + higher for i in range(n)]
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        return pa.table(
            {
                "tree": pa.array([row["tree"]] * n, pa.string()),
                "block": pa.array(range(row["block"] * SPAN, row["block"] * SPAN + n), pa.int64()),
                "top": pa.array([row["top"]] * n, pa.binary()),
                "path": pa.array([[{"before": a, "after": b} for a, b in p] for p in found], kind),
            }
        )

    return stored(_joined(segments, above).groupBy("tree", "block").applyInArrow(paths, schema), name)


def _cut(nodes: bytes) -> list[bytes]:
    return [nodes[i : i + 32] for i in range(0, len(nodes), 32)]


def _joined(segments: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("tree").alias("in_tree"), F.col("block").alias("in_block"), "top", "path")
    same = segments["tree"].eqNullSafe(above["in_tree"]) & (segments["block"] == above["in_block"])
    return segments.join(above, same).drop("in_tree", "in_block")


def _above_leaves(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``tree, block, top, path`` for the segments of the first round; ``roots`` has ``tree``,
    ``top`` and the ``path`` of the tree's own root."""
    ends = roots.select("tree", F.lit(0).cast("long").alias("block"), "top", "path")
    carried = None
    for k in range(len(rounds) - 1, -1, -1):
        segments = rounds[k]
        last = segments.where(F.col("n") <= SPAN).select(F.col("tree").alias("done"))
        own = ends.join(last, ends["tree"].eqNullSafe(last["done"]), "left_semi")
        above = own if carried is None else own.union(carried)
        if k == 0:
            return above
        carried = _paths(segments, above, f"merkle-paths-{k}")


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``, nulls marked. Each ``source``
    (null is one) is a tree of its rows by ascending ``doc_id``; the roots of the sources, null
    first and then by bytes, are the leaves of the top tree. ``proof_sha256`` is the digest of all
    siblings from the leaf to the root. ``folded_root`` is what leaf and siblings give; for rows with
    crc32 of ``doc_id`` divisible by five, the leaf is made from the text with A-Z as a-z.

    A null ``doc_id`` comes first and is never altered. Rows of one ``doc_id`` are ordered by their
    digests; repeated rows are leaves of their own. Texts of any length are hashed whole where they
    are read. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    names = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    rows = docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in names.items()])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = stored(
        rows.select(
            F.col("source").alias("tree"),
            "doc_id",
            row_digest(*head, F.col("text")).alias("digest"),
            F.when(tampered, row_digest(*head, ascii_lower(F.col("text")))).alias("altered"),
        ),
        "merkle-leaves",
    ).withColumn("tampered", F.coalesce("altered", "digest")).drop("altered")
    rounds = append_logs(ranked(leaves, ["doc_id", "digest"]))

    # the roots of the trees are the leaves of the top tree; its key is one for all
    subroots = stored(tops(rounds), "merkle-subroots")
    plain = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("source"), "digest",
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"),
    )
    plain = stored(ranked(plain, ["source"]), "merkle-top-leaves")
    top_rounds = append_logs(plain.drop("source"))
    root = tops(top_rounds).first()
    root = bytes(root["digest"]) if root else b""
    above = spark.createDataFrame([("", root, [])], f"tree string, top binary, path {_PATH}")
    above = _paths(top_rounds[0], _above_leaves(top_rounds, above), "merkle-top-paths")
    own = plain.select("source", "rank", "digest")
    roots = own.join(above.select("block", "path"), own["rank"] == above["block"])
    roots = stored(roots.select(F.col("source").alias("tree"), F.col("digest").alias("top"), "path"), "merkle-roots")

    schema = (
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )

    def prove(rows: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        log, altered = _cut(row["nodes"]), _cut(row["tampered"])
        higher = [(x["before"], x["after"]) for x in row["path"]]
        proofs, folded, n = [], [], len(row["ids"])
        for i in range(n):
            path = siblings(log, i, n, row["levels"]) + higher
            proofs.append(node_digest([x for pair in path for x in pair]).hex())
            folded.append(fold(altered[i], path).hex())
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "leaf": [log[position(0, i, n)].hex() for i in range(n)],
                "subroot": [row["top"].hex()] * n,
                "root": [root.hex()] * n,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [x == root.hex() for x in folded],
            }
        )

    segments = _joined(rounds[0], _above_leaves(rounds, roots))
    return segments.groupBy("tree", "block").applyInArrow(prove, schema)
