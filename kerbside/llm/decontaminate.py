"""Operator 4: benchmark passages in documents, by a positional inverted index.

Built from DataFrame functions only. The index has a posting (term, document, position) for
every occurrence of an item word in a document, stored once. A window of item words is looked up
from its rarest term: that term's list gives the places where the window could start, and the
lists of its other terms, moved by their offsets, are intersected with those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import ascii_lower, sized, stored

#: Words of a window.
WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ("doc_id", "text_hash")


def word_list(text: Column) -> Column:
    """Words of a text: A-Z as a-z, cut at ASCII that is no letter or digit. Null has none."""
    words = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS)
    return F.array_remove(words, "")


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the items as ``window, n_terms, offset, word``, and ``window, item_id``.
    An item of fewer words than ``size``, but not none, is one window. Both stored."""
    words = items.select("item_id", word_list(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = words.select("item_id", "words", F.explode(starts).alias("at"))
    each = each.select("item_id", F.slice("words", F.col("at"), size).alias("words"))
    distinct = each.select("words").distinct().withColumn("window", F.monotonically_increasing_id())
    distinct = stored(distinct, "windows")
    of = stored(each.join(distinct, "words").select("window", "item_id").distinct(), "window-items")
    terms = distinct.select("window", F.size("words").alias("n_terms"), F.posexplode("words").alias("offset", "word"))
    return terms, of


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of the words in ``vocabulary`` (``term``, ``word``): ``term, doc_id, text_hash,
    position``; stored. The last word of every document has a row too, with a null ``term`` if it
    is no such word, and so has a document without words (null ``position``)."""
    rows = docs.select(
        F.col("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        word_list(F.col("text")).alias("words"),
    )
    each = rows.select(*_DOC, F.size("words").alias("n"), F.posexplode_outer("words").alias("position", "word"))
    known = each.join(sized(vocabulary, 64), "word", "left")
    known = known.where("term is not null or position is null or position = n - 1")
    return stored(known.select("term", *_DOC, "position"), "index")


def _ranked(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``terms`` with ``term`` ranked by rarity in the index; windows with a word that no document
    has are gone, since nothing can match them."""
    counts = index.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("window").orderBy("held", "offset")
    found = terms.join(counts, "term").withColumn("rank", F.row_number().over(order))
    found = found.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("window")))
    return stored(found.where("known = n_terms").drop("known", "held", "word"), "window-terms")


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact occurrences of windows: ``window, doc_id, text_hash, start, n_terms``; stored."""
    ranked = _ranked(terms, index)
    postings = index.where("term is not null")
    first = ranked.where("rank = 1")
    found = postings.join(sized(first, 40), "term").where("position >= offset")
    found = found.select("window", "n_terms", *_DOC, (F.col("position") - F.col("offset")).alias("start"))
    found = stored(found.distinct(), "phrase-1")
    # one list more at a time while candidates fall fast, then all the other lists at once
    for low, high in ((2, 2), (3, 3), (4, 1 << 30)):
        some = ranked.where(F.col("rank").between(low, high))
        wanted = found.join(sized(some, 40), "window").select(
            found["window"], found["n_terms"], *[found[c] for c in _DOC], found["start"],
            "term", (F.col("start") + F.col("offset")).alias("position"),
        )
        lists = sized(stored(some.select("term").distinct(), "phrase-lists"), 16)
        seen = postings.join(lists, "term", "left_semi")
        if low > 2:  # few documents are left: only their postings are dealt out
            left = sized(stored(found.select(*_DOC).distinct(), "phrase-docs"), 16)
            same = [seen[c].eqNullSafe(left[c]) for c in _DOC]
            seen = seen.join(left, same, "left_semi")
        on = [F.col("w.term") == F.col("p.term"), F.col("w.position") == F.col("p.position")]
        on += [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in _DOC]
        both = stored(wanted, f"phrase-{low}-wanted").alias("w").join(seen.alias("p"), on)
        keys = ["window", "n_terms", *_DOC, "start"]
        held = both.select(*[F.col(f"w.{c}").alias(c) for c in keys], F.col("w.position").alias("position"))
        held = held.groupBy(*keys).agg(F.count_distinct("position").alias("held"))
        need = F.least(F.col("n_terms"), F.lit(high)) - low + 1
        longer = held.where(F.col("held") == need).select(keys)
        # windows of fewer terms than this rank are complete already
        found = stored(longer.union(found.where(F.col("n_terms") < low).select(keys)), f"phrase-{low}")
    return found


def proximity_matches(index: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """``window, doc_id, text_hash`` where all distinct words of a window occur, in any order,
    within ``span`` consecutive words of a document.

    Postings are grouped by stretches of ``2 * span`` words that overlap by half, so every span
    lies in one of them, and no group holds more than that."""
    ranked = _ranked(terms, index).select("window", "term").distinct()
    need = ranked.groupBy("window").agg(F.count(F.lit(1)).alias("need"))
    block = F.floor(F.col("position") / span)
    each = index.where("term is not null").join(sized(stored(ranked, "near-terms"), 24), "term")
    each = each.withColumn("block", F.explode(F.array(block, block - 1)))
    held = each.groupBy("window", *_DOC, "block").agg(
        F.count_distinct("term").alias("n"), F.collect_set(F.struct("position", "term")).alias("held")
    )
    held = held.join(need, "window").where("n = need")

    def complete(p: Column) -> Column:
        inside = F.filter(
            "held", lambda q: (q["position"] >= p["position"]) & (q["position"] < p["position"] + span)
        )
        return F.size(F.array_distinct(F.transform(inside, lambda q: q["term"]))) == F.col("need")

    return held.where(F.exists("held", complete)).select("window", *_DOC).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``.

    A word is hit if it lies inside an exact occurrence of a window of ``items`` (``item_id``,
    ``text``). Null and empty texts have no words and are clean; items without words match
    nothing; a null ``item_id`` hits words but is not listed. Rows that repeat are returned each;
    rows of one ``doc_id`` are told apart by their texts. Other columns are not read."""
    return _contamination(docs, items, size).drop("text_hash")


def _contamination(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """What ``contamination`` returns, and ``text_hash``."""
    terms, of = windows(items, size)
    vocabulary = stored(
        terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary"
    )
    terms = terms.join(vocabulary, "word")
    index = build_index(docs, vocabulary)
    found = phrase_matches(index, terms)

    n_words = index.groupBy(*_DOC).agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("n_words"))
    # words in the union of the occurrences: what each adds to those that start before it
    spans = found.groupBy(*_DOC, "start").agg(F.max(F.col("start") + F.col("n_terms")).alias("stop"))
    before = Window.partitionBy(*_DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    spans = spans.withColumn("new", F.greatest(F.col("stop") - reached, F.lit(0)))
    hits = spans.groupBy(*_DOC).agg(F.sum("new").alias("n_hit"))
    listed = found.select("window", *_DOC).distinct().join(sized(of, 24), "window")
    listed = listed.groupBy(*_DOC).agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    some = hits.alias("h").join(
        listed.alias("l"), [F.col(f"h.{c}").eqNullSafe(F.col(f"l.{c}")) for c in _DOC], "left"
    ).select(*[F.col(f"h.{c}").alias(c) for c in _DOC], "n_hit", "items")
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    for part, name in ((n_words, "n"), (some, "s")):
        part = part.select(*[F.col(c).alias(f"{name}_{c}") for c in _DOC], *[c for c in part.columns if c not in _DOC])
        rows = rows.join(part, [rows[c].eqNullSafe(part[f"{name}_{c}"]) for c in _DOC], "left")
    none = F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        F.col("doc_id"),
        F.col("text_hash"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` has a text with an occurrence of a window. Rows
    with a null ``doc_id`` stay."""
    bad = contamination(docs, items, size).where("contaminated").select("doc_id").distinct()
    bad = sized(stored(bad, "contaminated"), 16)
    return docs.join(bad, docs["doc_id"] == bad["doc_id"], "left_anti")


def clean_rows(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose own text has an occurrence of a window, whatever their
    ``doc_id``, null or shared with other texts."""
    bad = _contamination(docs, items, size).where("contaminated").select(*_DOC).distinct()
    bad = sized(stored(bad, "contaminated"), 24)
    same = docs["doc_id"].eqNullSafe(bad["doc_id"])
    same &= F.xxhash64(docs["text"].cast("string")) == bad["text_hash"]
    return docs.join(bad, same, "left_anti")
