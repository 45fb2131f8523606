"""Set joins, line dedup and decontamination against brute force on small fixtures."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbside.llm import decontaminate, fingerprints, line_dedup, ngram_join, setjoin
from kerbside.llm import words as W

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).replace(b"\x0b", b" ").split()


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def corpus(seed, families=6, copies=14):
    """Families of near copies, exact copies, unrelated and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5)))
    texts = ["", None, "  \t\n", "One", "one", "Two words", "two  WORDS", "the of", "é É", "é x y"]
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    texts += [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(40)]
    texts.append(" ".join(word() for _ in range(30_000)))
    rng.shuffle(texts)
    return texts


def linked(sets, num, den):
    """Smallest row reachable, by union of all pairs."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and den * shared >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", [1])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs).collect()}
    sets = [shingles(t, 3) for t in texts]
    want = linked(sets, 90, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


@pytest.mark.parametrize("block", [1 << 18, 300])
def test_ngram_join_counts_every_link(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block, raising=False)
    monkeypatch.setattr(ngram_join, "LEAST_SET", 1, raising=False)
    texts = corpus(4, copies=20)
    rows = [*enumerate(texts), *enumerate(texts[:60]), *((i + 1000, t) for i, t in enumerate(texts[:60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [shingles(t, 3) for _, t in rows]
    linked_to = {
        s: sum(1 for t in set(sets) if t != s and t and 100 * len(s & t) >= 90 * len(s | t)) if s else 0 for s in set(sets)
    }
    got = sorted((r.doc_id, r.n_shingles, r.links) for r in ngram_join.similar_documents(docs).collect())
    assert got == sorted((i, len(s), linked_to[s]) for (i, _), s in zip(rows, sets))
    assert max(linked_to.values()) > 4


def test_banded_fingerprints_equal_brute_force(spark):
    texts = corpus(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.near_groups(docs).collect()}
    sets = [shingles(t, 5) for t in texts]
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == linked(sets, 80, 100)
    assert fingerprints.near_groups(docs.limit(0)).count() == 0


def test_ngram_join_odd_rows(spark):
    schema = "doc_id long, text string, row int, id string, key string"
    rows = [(1, "a b c d", 1, "x", "y"), (1, "a b c d", 1, "x", "y"), (None, "A B c d", 2, None, None), (3, None, 0, "", "")]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, schema)).collect()
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got)
    assert found == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (3, 0, 3)]
    empty = spark.createDataFrame([], schema)
    assert ngram_join.similar_documents(empty).count() == 0
    assert ngram_join.keep_one(empty).columns == empty.columns


def without_repeats(rows):
    """Lines left of (doc_id, text), in order, comparing each line with all earlier ones."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc] = None
            continue
        left = []
        for line in text.split("\n"):
            s = shingles(line, 5)
            if not s or not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                left.append(line)
            if s:
                seen.append(s)
        out[doc] = "\n".join(left)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    lines = [t for t in corpus(3, families=5, copies=10) if t is not None and len(t) < 5000]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Of.\nOf.\nof.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == without_repeats(rows)


def test_line_dedup_keeps_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, n_lines int, line int, row int, `drop` string"
    docs = spark.createDataFrame([(2, "a b\nc", 9, 9, 9, "z"), (1, "A  b", 9, 9, 9, "z"), (None, "c", 9, 9, 9, "z")], schema)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.row) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {None: ("c", 1, 0, 9), 1: ("A  b", 1, 0, 9), 2: ("", 2, 2, 9)}
    left = line_dedup.without_emptied(line_dedup.dedup_lines(docs))
    assert {r.doc_id for r in left.collect()} == {None, 1}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_saturated_lengths_pass_the_filters():
    import numpy as np

    join = setjoin.Join(3, 90, 100)
    n = np.array([100, 65535, 100], np.uint16)
    m = np.array([89, 65535, 90], np.uint16)
    assert setjoin._passes(n, m, n * 0, m * 0, join).tolist() == [False, True, True]


CUT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(docs, items):
    low = lambda t: CUT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, text in items:
        w = low(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = low(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in wins[tuple(w[i : i + n])] if x is not None}
        out[doc] = (len(w), len(hit), len(found), ",".join(sorted(found)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    pool = "the of a is Zed qu'x 7 éa b-c and to in".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(3, 15)] + [(20, ""), (21, None), (22, "Zed! zed")]
    long = [t for _, t in items if t and len(t) > 25]
    docs = [(i, text(rng.randint(0, 40)) + " " + (rng.choice(long).upper() if i % 3 else "")) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, long[0] + ". " + long[0]), (104, "x " * 5000 + long[1])]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    import hashlib

    want = brute_contamination(docs, items)
    for r in got.collect():
        n, hit, k, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, k, hit > 0), r.doc_id
        assert r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest()


def test_contamination_odd_rows(spark):
    schema = "doc_id long, text string, term string, position int"
    docs = spark.createDataFrame([(1, "a b", "t", 1), (1, "a b", "t", 1), (1, "c", "t", 1), (None, "A!b", None, None)], schema)
    items = spark.createDataFrame([(None, "a b")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(0, 2, 2, 0), (1, 1, 0, 0), (1, 2, 2, 0), (1, 2, 2, 0)]
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [None]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x b y a z"), (2, "a " + "x " * 9 + "b"), (3, "a"), (4, "q " * 7 + "b a")], "doc_id long, text string")
    terms, _ = decontaminate.windows(spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    vocabulary = terms.select("word").distinct().withColumn("term", F.xxhash64("word"))
    index = decontaminate.build_index(docs, vocabulary)
    near = decontaminate.proximity_matches(index, terms.join(vocabulary, "word"), 4)
    assert {r.doc_id for r in near.collect()} == {1, 4}


def test_fingerprints(spark):
    texts = corpus(7, families=2, copies=4)
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    import hashlib

    assert len(got) == len(rows)
    by_text = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for value, other in ((r.near_edited, changed), (r.near_next, after)):
            a, b = shingles(text, 5), shingles(other, 5)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - true) < 0.22
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    one = fingerprints.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    rows = [(None, "a\nb"), (None, "c\na"), (None, "d\ne\nf"), (7, "g\nh"), (7, "i\ng"), (7, "i\ng"), (8, "h\nj")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(r[2] for r in got) == [2, 2, 2, 2, 2, 2, 3]
    lines = lambda some: sorted("\n".join(t for d, t, *_ in got if d in some).split("\n"))
    assert [x for x in lines([None]) if x] == list("abcdef")
    # of two rows with one doc_id and text, which are one document, both keep their lines
    assert sorted(set(lines([7, 8])) - {""}) == list("ghij") and lines([8]) == ["j"]
    assert sorted(r[3] for r in got if r[0] is None) == [0, 0, 1]
    assert sorted(r[3] for r in got if r[0] == 7) in ([0, 0, 1], [0, 1, 1]) and [r[3] for r in got if r[0] == 8] == [1]


def test_one_text_per_class_is_verified(spark):
    base = " ".join(f"w{i}" for i in range(70))
    rows = [(None, base)] * 5 + [(None, base + " x")] * 4 + [(None, f"other {i}") for i in range(6)]
    docs = setjoin.base(spark.createDataFrame(rows, "doc_id long, text string"))
    digest = setjoin.digests(docs, ngram_join.QUERY, "once")
    klass = setjoin.classes(digest, "once-classes")
    ids = klass.where("n > 60").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    read = []
    keep = setjoin.stored
    setjoin.stored = lambda df, name: read.append((name, keep(df, name))) or read[-1][1]
    try:
        assert setjoin.verified(ids, klass, docs, ngram_join.QUERY, "once").count() == 1
    finally:
        setjoin.stored = keep
    texts = [t for name, t in read if name in ("once-texts", "once-once")]
    assert texts[0].count() == 9 and texts[-1].count() == 2


def test_stages_decide_by_row(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(70))
    near, other = base + " x", "nothing like the others"
    rows = [(None, base, 1), (None, near, 2), (None, base, 3), (4, near, 4), (4, other, 5), (4, near, 6), (None, None, 7)]
    rows += [(5, base, 8), (None, "", 9), (None, "one more text", 10), (None, "one more text", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert left == sorted([(4, near), (4, other), (0, ""), (0, ""), (0, "one more text")])
    assert ngram_join.keep_one(docs.where("n < 3")).count() == 1
    items = spark.createDataFrame([(1, "nothing like")], "item_id long, text string")
    clean = decontaminate.clean_rows(docs.unionByName(docs.where("n = 5").selectExpr("null doc_id", "text", "12 n")), items)
    assert {r.n for r in clean.collect()} == {r[2] for r in rows} - {5}
    called = corpus_pipeline.decontamination_stage.__code__.co_names
    assert "clean_rows" in called


def test_slots_are_counted_together(monkeypatch):
    monkeypatch.setattr(setjoin, "SKETCH_BITS", 6)
    rng, tally, want = np.random.default_rng(1), setjoin.Tally(), np.zeros(64, int)
    for n in (0, 5, 100, 1, 3, 40):
        slots = rng.integers(0, 64, n)
        tally.add(slots)
        np.add.at(want, slots, 1)
    assert (tally.flush() == want).all() and (tally.flush() == want).all()
    assert (setjoin.Tally().flush() == 0).all()


def test_words_of_empty_lines_and_sketches():
    texts = pa.array(["", "a b\n\n\nc", None, "\n", "d d e", "\n\nf"], pa.large_string()).fill_null("")
    w = W.words(texts, lines=True)
    assert (w.unit == np.searchsorted(w.unit_start, w.start, "right") - 1).all() and len(w.unit) == 7
    for _, sets in setjoin.distinct(w, 1):
        bits = [sum(bin(int(x) & (2**64 - 1)).count("1") for x in row) for row in setjoin._parity(sets)]
        assert bits == [int(n) for n in sets.n]
