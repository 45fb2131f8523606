"""Operator 1: documents linked by the Jaccard similarity of their word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kerbside.llm import setjoin as S
from kerbside.llm import words as W
from kerbside.llm.common import sized, small_batches, stored
from kerbside.llm.components import components

#: Three words, similarity 0.9.
QUERY = S.Join(k=3, num=90, den=100)
#: Pairs to a posting that are compared without further rounds, and the share of components apart after
#: a round, of those before it, beyond which no more rounds follow. Results do not depend on them.
PAIRS_LEFT, LEAST_PROGRESS = 1, 0.9
#: Shingles of the sets that are compared with each other in one task, about, and what a smaller set counts for.
BLOCK, LEAST_SET = 1 << 18, 1 << 8


def similar_documents(docs: DataFrame, join: S.Join = QUERY) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``links`` per row of ``docs``.

    Two rows are linked when ``den * |intersection| >= num * |union|`` for their sets of word
    n-grams (words at ASCII white space, A-Z as a-z). ``component_id`` is the smallest
    ``doc_id`` reachable by links, the row's own included. ``links`` counts all other sets that the
    row's set is linked to; equal sets are one.

    A null or empty text, or one without words, has an empty set and no links. A set of fewer
    words than ``k`` is the whole sequence. Rows with the same ``doc_id`` are told apart by
    their texts; a null ``doc_id`` is linked like any other but is never a component's id
    unless the component has no other (then it is null). Other columns are not read.
    """
    base = S.base(docs)
    return linked(base, S.digests(base, join, "ngram-digest"), join)


def linked(base: DataFrame, digest: DataFrame, join: S.Join) -> DataFrame:
    """What ``similar_documents`` returns, for sets that meet by the tokens of ``digest``."""
    rows = _linked_rows(base, digest, join)
    return rows.select(
        F.col("row").alias("doc_id"),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least.row")).otherwise(F.col("row")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def _linked_rows(base: DataFrame, digest: DataFrame, join: S.Join) -> DataFrame:
    """``_grouped_rows`` with ``links``, null without any."""
    klass, labels = _grouped(base, digest, join)
    return _grouped_rows(digest, klass, labels, _link_counts(klass, labels, base, join))


def _grouped(base: DataFrame, digest: DataFrame, join: S.Join) -> tuple[DataFrame, DataFrame]:
    """The classes with their ``least`` (see ``_grouped_rows``), and ``key`` and ``component`` of the linked ones."""
    least = F.min(F.struct(F.col("row").isNull().alias("none"), "row", "hash")).alias("least")
    klass = S.classes(digest, "ngram-classes", least)
    edges = S.star_edges(digest, join, "ngram-edges")

    tested = stored(S.likely_pairs(edges, digest, join, "ngram"), "ngram-pairs")
    links = S.verified(tested, klass, base, join, "ngram-links")
    labels = components(links.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")), "ngram-near")
    # a shingle stays open if its classes are not all in one component yet
    near = stored(klass.select("id", "key").join(labels, "key").select("id", "component"), "ngram-ids")
    near = sized(near, 32)
    a = near.select(F.col("id").alias("a"), F.col("component").alias("a_in"))
    b = near.select(F.col("id").alias("b"), F.col("component").alias("b_in"))
    apart = F.col("a_in").isNull() | F.col("b_in").isNull() | (F.col("a_in") != F.col("b_in"))
    open_tokens = edges.where("size > 2").join(a, "a", "left").join(b, "b", "left").where(apart)
    open_tokens = stored(open_tokens.select("token").distinct(), "ngram-open")

    posts = S.open_postings(digest, open_tokens, "ngram-postings")
    return klass, _contracted(posts, tested, links, labels, klass, base, join)


def _grouped_rows(digest: DataFrame, klass: DataFrame, labels: DataFrame, *counts: DataFrame) -> DataFrame:
    """``row``, ``hash``, ``n_shingles`` and ``least`` per row: the smallest ``row`` of its component (null
    last) and, there, ``hash``. No shingles have no ``least``. With the columns of ``counts``, by ``key``."""
    groups = klass.join(labels, "key", "left").withColumn("group", F.coalesce("component", "key"))
    least = groups.groupBy("group").agg(F.min("least").alias("least"))
    groups = groups.select("key", "group").join(least, "group").select("key", "least")
    for count in counts:
        groups = groups.join(count, "key", "left")
    rows = digest.select("row", "hash", F.col("n").cast("long").alias("n_shingles"), "key")
    return rows.join(groups, "key", "left").drop("key")


def _link_counts(klass: DataFrame, labels: DataFrame, base: DataFrame, join: S.Join) -> DataFrame:
    """``key`` and ``links`` of the linked sets: how many other sets each is linked to.

    All links of a set are in its component, and two sets that are a component are linked. In a larger one
    every set is compared with every other: its sets are dealt into blocks of about ``BLOCK`` shingles,
    any two blocks meet in one task, and a set leaves that with one count. So a set is sent once for each
    block of its component, there is no row for a pair, and a task holds two blocks.
    """
    near = stored(klass.select("key", "id", "n", "row", "hash").join(labels, "key"), "ngram-linked")
    size = F.sum(F.greatest("n", F.lit(LEAST_SET)).cast("long"))
    held = near.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.ceil(size / BLOCK).cast("int").alias("blocks"))
    near = stored(near.join(held, "component"), "ngram-members")
    two = near.where("sets = 2").select("key", F.lit(1).cast("long").alias("links"))
    more = near.where("sets > 2").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    more = stored(
        more.select(F.col("row").alias("wanted"), F.col("hash").alias("of"), "key", "component", "blocks", "block"), "ngram-wanted"
    )
    n = more.count()
    same = F.col("row").eqNullSafe(F.col("wanted")) & (F.col("hash") == F.col("of"))
    texts = stored(base.join(sized(more, 96, n), same).select("key", "component", "blocks", "block", "text"), "ngram-texts")
    if texts.count() > n:  # rows that repeat: one text per set
        texts = stored(texts.dropDuplicates(["key"]), "ngram-once")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, part in W.slices(batch.column(4), W.SMALL):
                for low, s in S.distinct(W.words(part), join.k):
                    found, first = S.set_keys(s), at + low
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(s.first, len(s.hash)).astype(np.int32)), pa.array(s.hash.view(np.int64))
                    )
                    same = [found[i].tobytes() == keys[first + i] for i in range(len(s.n))]
                    columns = [batch.column(i).slice(first, len(s.n)) for i in range(4)]
                    out = pa.RecordBatch.from_arrays([*columns, lists], ["key", "component", "blocks", "block", "shingles"])
                    yield out.filter(pa.array(same, pa.bool_()))

    made = texts.mapInArrow(sets, "key binary, component binary, blocks int, block int, shingles array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = made.withColumn("other", other).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "shingles"
    )

    def count(table: pa.Table) -> pa.Table:
        lists = table["shingles"].combine_chunks()
        first = table["block"].to_numpy() == table["low"][0].as_py()
        links = links_within(lists, first, table["low"][0].as_py() == table["high"][0].as_py(), join)
        return pa.table({"key": table["key"], "links": links}).filter(pa.array(links > 0))

    with small_batches(base.sparkSession):
        counted = stored(met.groupBy("component", "low", "high").applyInArrow(count, "key binary, links long"), "ngram-counts")
    return two.union(counted).groupBy("key").agg(F.sum("links").alias("links"))


def links_within(lists: pa.ListArray, first: np.ndarray, one: bool, join: S.Join) -> np.ndarray:
    """To how many others each of some sets is linked. Sets of the ``first`` block are compared with those of
    the second or, if there is ``one`` block only, with each other."""
    size = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    _, at = np.unique(values, return_inverse=True)
    start = np.cumsum(size) - size
    x = np.flatnonzero(first)
    y = x if one else np.flatnonzero(~first)
    y = y[np.argsort(size[y], kind="stable")]
    n = size[y]
    ends = np.concatenate([[0], np.cumsum(n)])
    held = at[np.repeat(start[y] - ends[:-1], n) + np.arange(ends[-1])]
    links = np.zeros(len(size), np.int64)
    mark = np.zeros(len(values), np.int32)
    for i in x:
        own = at[start[i] : start[i] + size[i]]
        low = np.searchsorted(n, -(-size[i] * join.num // join.den))
        high = np.searchsorted(n, size[i] * join.den // join.num, "right")
        if low >= high:
            continue
        mark[own] = 1
        shared = np.add.reduceat(mark[held[ends[low] : ends[high]]], ends[low:high] - ends[low])
        mark[own] = 0
        linked = y[low:high][join.den * shared.astype(np.int64) >= join.num * (size[i] + n[low:high] - shared)]
        if one:
            links[i] = np.count_nonzero(linked != i)
        else:
            links[i] += len(linked)
            links[linked] += 1
    return links


def _contracted(
    posts: DataFrame, tested: DataFrame, links: DataFrame, labels: DataFrame, klass: DataFrame,
    base: DataFrame, join: S.Join,
) -> DataFrame:
    """``labels`` (components of the linked keys) with what the open shingles add.

    ``posts`` are the postings of the open shingles, ``tested`` the pairs of ids compared so far. In a
    round every open shingle has one new leader, the class with the most links yet, which is compared with the
    shingle's classes in other components; then components are joined up, and a shingle with one
    component left is closed. So a round compares at most as many pairs as there are postings, and of a large
    group of near copies only some are paired. When few pairs are left, or a round joins hardly anything
    up, all that is still in different components is compared.
    """
    apart = None
    posts = posts.withColumn("led", F.lit(False))
    none = F.array().cast("array<bigint>").alias("before")  # leaders meet others at every shingle
    while True:
        parts, stand = _parts(posts, links, labels, klass)
        if not stand["apart"]:
            return labels
        left = stand["pairs"] <= PAIRS_LEFT * stand["postings"]
        last = left or (apart is not None and stand["apart"] > LEAST_PROGRESS * apart)
        apart = stand["apart"]
        differ = F.col("x.component") != F.col("y.component")
        if last:
            differ &= F.col("y.main") | (F.col("x.id") < F.col("y.id"))
            more = S.cross_pairs(parts.where("not main"), parts, differ, join)
        else:
            order = F.struct(~F.col("led"), "degree", F.xxhash64("id"), "id")
            lead = stored(parts.groupBy("token").agg(F.max_by("id", order).alias("id")), "ngram-leaders")
            held = lead.count()
            shared = parts.select("token", "id", "n", "s0", "s1", "s2", "s3", "at", "component", none)
            leaders = shared.join(sized(lead, 24, held), ["token", "id"], "left_semi")
            more = S.cross_pairs(sized(leaders, 128, held), shared, differ, join)
        done = tested.union(tested.select("b", "a"))
        more = stored(more.join(done, ["a", "b"], "left_anti"), "ngram-more")
        found = S.verified(more, klass, base, join, "ngram-rest")
        tested, links = tested.union(more), links.union(found).distinct()
        labels = _joined_up(labels, found)
        if last:
            return labels
        now = sized(lead.withColumn("now", F.lit(True)), 24, held)
        posts = parts.select(posts.columns).join(now, ["token", "id"], "left")  # closed shingles stay closed
        posts = posts.withColumn("led", F.col("led") | F.col("now").isNotNull()).drop("now")


def _parts(posts: DataFrame, links: DataFrame, labels: DataFrame, klass: DataFrame) -> tuple[DataFrame, Row]:
    """Postings of shingles with more than one component, stored: with ``component``, ``degree`` (links of the
    class), ``led`` (it has been a leader there) and ``main`` (in the shingle's largest component). And how
    many there are: ``postings``, ``pairs`` across components, and components too many (``apart``)."""
    degree = links.select(F.explode(F.array("a_key", "b_key")).alias("key")).groupBy("key")
    near = labels.join(degree.agg(F.count(F.lit(1)).alias("degree")), "key").join(klass.select("id", "key"), "key")
    near = stored(near.select("id", "component", "degree").dropDuplicates(["id"]), "ngram-near-ids")
    parts = posts.join(sized(near, 48), "id", "left")
    parts = parts.withColumn("component", F.coalesce("component", F.encode(F.col("id").cast("string"), "UTF-8")))
    parts = parts.withColumn("degree", F.coalesce("degree", F.lit(0)))
    held = parts.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    held = held.groupBy("token").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"),
        F.sum("size").alias("postings"),
        F.sum(F.col("size").cast("double") * F.col("size")).alias("within"),
        F.count(F.lit(1)).alias("components"),
    )
    held = stored(held.where("components > 1"), "ngram-open-tokens")
    stand = held.agg(
        F.coalesce(F.sum("postings"), F.lit(0)).alias("postings"),
        F.coalesce(F.sum((F.col("postings").cast("double") * F.col("postings") - F.col("within")) / 2), F.lit(0.0)).alias("pairs"),
        F.coalesce(F.sum(F.col("components") - 1), F.lit(0)).alias("apart"),
    ).first()
    parts = parts.join(sized(held.select("token", "main"), 64), "token")
    return stored(parts.withColumn("main", F.col("main") == F.col("component")), "ngram-parts"), stand


def _joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components that new ``links`` join, and with their new keys; stored."""
    a = labels.select(F.col("key").alias("a_key"), F.col("component").alias("a_in"))
    b = labels.select(F.col("key").alias("b_key"), F.col("component").alias("b_in"))
    nodes = links.join(a, "a_key", "left").join(b, "b_key", "left").select(
        F.coalesce("a_in", "a_key").alias("a"), F.coalesce("b_in", "b_key").alias("b")
    )
    further = components(nodes.where("a != b").distinct(), "ngram-components")
    further = stored(further.select(F.col("key").alias("group"), F.col("component").alias("further")), "ngram-further")
    # a node is the label of a component or a key that had none
    known = labels.select("key", F.col("component").alias("group"))
    alone = further.select(F.col("group").alias("key"), "group").join(labels.select("key"), "key", "left_anti")
    out = known.union(alone).join(further, "group", "left")
    return stored(out.select("key", F.coalesce("further", "group").alias("component")), "ngram-labels")


def keep_one(docs: DataFrame, join: S.Join = QUERY) -> DataFrame:
    """``docs`` with one row per component: the one with the smallest ``doc_id`` (null last) and, there,
    the smallest hash of the text; of rows that have both in common, any one. Texts without words
    have no component and stay."""
    base = S.base(docs)
    digest = S.digests(base, join, "ngram-digest")
    found = _grouped_rows(digest, *_grouped(base, digest, join)).where("n_shingles > 0")
    found = found.select("row", "hash", (F.struct("row", "hash") == F.struct("least.row", "least.hash")).alias("first"))
    found = stored(found.groupBy("row", "hash", "first").agg(F.count(F.lit(1)).alias("copies")), "ngram-found")
    drop, again = stored(found.where("not first"), "ngram-drop"), stored(found.where("first and copies > 1"), "ngram-again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__row", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64(F.col("text").cast("string")))

    def listed(some: DataFrame, how: str) -> DataFrame:
        same = rows["__row"].eqNullSafe(some["row"]) & (rows["__hash"] == some["hash"])
        return rows.join(sized(some.select("row", "hash"), 24), same, how)

    left = listed(drop.union(again), "left_anti").select(columns)
    if again.isEmpty():
        return left
    return left.union(listed(again, "left_semi").dropDuplicates(["__row", "__hash"]).select(columns))
