"""Operator 2: lines that repeat, exactly or nearly, an earlier line are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import setjoin as S
from kerbside.llm.common import sized, stored

#: Five words, similarity 0.8.
QUERY = S.Join(k=5, num=80, den=100, lines=True)


def repeated_lines(docs: DataFrame, join: S.Join = QUERY) -> DataFrame:
    """``row`` (the ``doc_id``), ``hash`` (of the text) and ``line`` (from 0) of every line to remove.

    A line is what stands between line feeds. Its tokens are its distinct word n-grams (words
    at ASCII white space, A-Z as a-z; fewer than ``k`` words are one token). A line is removed
    if any earlier line, in order of ``doc_id`` and place, has a similarity of ``num/den`` or
    more, whether or not that one is removed too. Lines without words always stay. Rows of one
    ``doc_id`` and text are one document; texts of one ``doc_id``, or without one, are each a
    document and in order of their hashes (``setjoin.place``). Nulls of ``doc_id`` come first.
    """
    base = S.base(docs)
    digest = S.digests(base, join, "line-digest")
    klass = S.classes(digest, "line-classes", F.count(F.lit(1)).alias("copies"))
    edges = S.star_edges(digest, join, "line-edges")

    pairs = stored(S.likely_pairs(edges, digest, join, "line"), "line-pairs")
    links = S.verified(pairs, klass, base, join, "line-links")
    gone = stored(_later(links, klass, "line-links"), "line-gone")
    settled = sized(gone.select("id").distinct(), 16, gone.count())
    # leaders are the earliest of their token, so only the others can have an earlier match
    open_tokens = edges.where("size > 2").join(settled.withColumnRenamed("id", "b"), "b", "left_anti")
    open_tokens = stored(open_tokens.select("token").distinct(), "line-open")
    posts = S.open_postings(digest, open_tokens, "line-postings")
    ids = stored(posts.select("id").distinct(), "line-ids")
    order = klass.join(sized(ids, 16), "id", "left_semi").groupBy("id").agg(F.min(_first()).alias("first"))
    posts = stored(posts.join(sized(stored(order, "line-order"), 64), "id"), "line-ordered")
    earlier = F.col("y.first") < F.col("x.first")
    more = S.cross_pairs(posts.join(settled, "id", "left_anti"), posts, earlier, join)
    done = pairs.union(pairs.select("b", "a"))
    more = stored(more.join(done, ["a", "b"], "left_anti"), "line-more")
    rest = S.verified(more, klass, base, join, "line-rest")

    gone = stored(gone.union(_later(rest, klass, "line-rest")).select("key").distinct(), "line-all-gone")
    # only classes that are gone or have copies lose lines
    state = klass.join(sized(gone.withColumn("gone", F.lit(True)), 40), "key", "left").where("gone or copies > 1")
    state = state.select("key", F.struct("row", "hash", "line").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    own = F.struct("row", "hash", "line")
    lines = digest.select("row", "hash", "line", "key").join(sized(stored(state, "line-state"), 72), "key")
    return lines.where(F.col("gone") | (own != F.col("first"))).select("row", "hash", "line")


def _first() -> Column:
    """The order of classes by ``setjoin.place``, without ties."""
    return F.struct("row", S.part().alias("part"), "line", "id")


def _later(links: DataFrame, klass: DataFrame, name: str) -> DataFrame:
    """Key and id of the later class of each link."""
    keys = stored(links.select(F.explode(F.array("a_key", "b_key")).alias("key")).distinct(), name + "-keys")
    n = keys.count()
    first = klass.join(sized(keys, 40, n), "key", "left_semi").select("key", "id", _first().alias("first"))
    first = stored(first, name + "-firsts")
    a, b = sized(first.alias("x"), 96, n), sized(first.alias("y"), 96, n)
    both = links.join(a, F.col("a_key") == F.col("x.key")).join(b, F.col("b_key") == F.col("y.key"))
    later = F.when(F.col("x.first") > F.col("y.first"), F.struct("x.key", "x.id")).otherwise(F.struct("y.key", "y.id"))
    return both.select(later.alias("later")).select("later.key", "later.id").distinct()


def _without(lines: Column, drop: Column) -> Column:
    """The text of ``lines`` but those numbered in ``drop`` (ascending, from 0): the spans before each of
    these, and what follows the last. The work follows the number of lines."""

    def before(line: Column, i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)
        return F.slice(lines, first + 1, line - first)

    rest = F.slice(lines, F.element_at(drop, -1) + 2, F.size(lines))
    return F.array_join(F.concat(F.flatten(F.transform(drop, before)), rest), "\n")


def dedup_lines(docs: DataFrame, join: S.Join = QUERY) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and the columns ``n_lines`` and
    ``n_removed`` added (replaced if they exist).

    A null text has no lines and stays null, an empty text has one, empty line and stays."""
    drop = repeated_lines(docs, join).groupBy("row", "hash")
    drop = stored(drop.agg(F.sort_array(F.collect_set("line")).alias("drop")), "line-drop")
    lines = drop.agg(F.sum(F.size("drop"))).first()[0] or 0
    drop = drop.select(F.col("row").alias("__row"), F.col("hash").alias("__hash"), F.col("drop").alias("__drop"))
    drop = sized(drop, 32, lines + drop.count())
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__row"))
    same &= F.xxhash64(docs["text"].cast("string")) == F.col("__hash")
    found = docs.drop("n_lines", "n_removed").join(drop, same, "left")
    some = F.col("__drop").isNotNull()
    lines = F.col("__lines")
    # a column of its own that is used more than once: the plan keeps it, and a text that loses lines is split once
    found = found.withColumn("__lines", F.when(some, F.split("text", "\n", -1)))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).when(some, F.size(lines)).otherwise(feeds + 1)
    return (
        found.withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_removed", F.when(some, F.size("__drop")).otherwise(0).cast("long"))
        .withColumn("text", F.when(some, _without(lines, F.col("__drop"))).otherwise(F.col("text")))
        .drop("__row", "__hash", "__drop", "__lines")
    )


def without_emptied(docs: DataFrame) -> DataFrame:
    """What ``dedup_lines`` returned, without the rows that lost lines and have no word left,
    and with ``n_chars`` (if there) as the length of the new text."""
    word = F.regexp_like(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    docs = docs.where((F.col("n_removed") == 0) | word)
    if "n_chars" in docs.columns:
        new = F.length("text").cast(docs.schema["n_chars"].dataType)
        docs = docs.withColumn("n_chars", F.when(F.col("n_removed") > 0, new).otherwise(F.col("n_chars")))
    return docs
