"""Set joins when the postings of a shingle lie in several chunks."""

import random

import numpy as np
import pytest

from kerbside.llm import line_dedup, ngram_join, setjoin
from test_joins import corpus, linked, shingles, without_repeats


def families(seed, count=8, words=64):
    """An original, two copies with one edit each, which are similar to it but not to each other, and
    short texts that make the words around the edits common, so that no copy meets it by these."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    out = []
    for _ in range(count):
        base = [word() for _ in range(words)]
        copies = [base[:at] + [word()] + base[at + 1 :] for at in (20, 40)]
        short = [base[at - 4 : at + 5] + [word() for _ in range(12)] for at in (20, 20, 20, 40, 40, 40)]
        out.append([" ".join(x) for x in (base, *copies, *short)])
    return out


@pytest.fixture
def tiny(spark, monkeypatch):
    """Every three rows are a chunk."""
    monkeypatch.setattr(setjoin, "_FLUSH", 1)
    monkeypatch.setattr(setjoin, "_POSTINGS", 50)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", [1])
def test_original_and_copies_in_two_chunks(spark, tiny, seed):
    rows, want = [], {}
    for i, (original, *copies) in enumerate(families(seed)):
        copies, short = copies[:2], copies[2:]
        ids = [i, 200 + 6 * i, 201 + 6 * i, 100 + 2 * i, 101 + 2 * i, *range(202 + 6 * i, 206 + 6 * i)]
        rows += zip(ids, [original, *short[:2], *copies, *short[2:]])
        want |= {x: i if x < 200 else x for x in ids}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs).collect()}
    assert got == want
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left == {i: "" if 100 <= i < 200 else text for i, text in rows}


@pytest.mark.parametrize("seed", [11, 12])
def test_tiny_chunks_equal_brute_force(spark, tiny, seed):
    texts = [t for t in corpus(seed, families=4, copies=8) if t is None or len(t) < 5000]
    texts += [t for f in families(seed, 4) for t in f]
    rng = random.Random(seed)
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == linked([shingles(t, 3) for t in texts], 90, 100)
    rows = [(i, "\n".join(rng.choice([t for t in texts if t]) for _ in range(3))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left == without_repeats(rows)


def postings(*rows):
    p = np.zeros(len(rows), setjoin._POSTING)
    for i, (row, ident) in enumerate(rows):
        p[i]["token"], p[i]["row"], p[i]["id"], p[i]["n"], p[i]["held"] = 7, row, ident, 60, 1
    return p


def test_two_classes_of_a_chunk_are_both_sent():
    join = ngram_join.QUERY
    sent = [setjoin._stars(p, join, last=False) for p in (postings((1, 10), (3, 30)), postings((1, 10), (2, 20)))]
    assert [len(edges) for _, edges in sent] == [0, 0]
    edges = setjoin._stars(np.concatenate([s for s, _ in sent]), join, last=True)[1].to_pydict()
    assert sorted(zip(edges["a"], edges["b"])) == [(10, 20), (10, 30)] and min(edges["size"]) > 2
    # the same two classes in every chunk are settled by their one pair
    sent = [setjoin._stars(postings((1, 10), (3, 30), (4, 30)), join, last=False)[0] for _ in range(3)]
    assert set(setjoin._stars(np.concatenate(sent), join, last=True)[1].to_pydict()["size"]) == {2}
