"""Learned scores on held-out rows, extraction, and the pipeline's stages."""

import os

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from kerbside.llm import extraction, quality, toxicity
from kerbside.llm import words as W
from kerbside.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.95), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    run = module.toxicity if label == "toxic" else module.quality
    got = run(docs, labels).where("held_out").join(labels, "doc_id").selectExpr("predicted", f"{label} as wanted").collect()
    assert sum(r.predicted == r.wanted for r in got) >= least * len(got)


def test_texts_are_scored_in_small_slices(monkeypatch):
    model = toxicity.Model(np.array([1], np.uint64), np.ones(1), 1.0, [0.5] * toxicity.BINS)
    seen, words = [], W.words
    monkeypatch.setattr(W, "words", lambda texts, *more: seen.append(W.body(texts)[0].size) or words(texts, *more))
    assert len(list(toxicity._scored(pa.array(["some words " * 5_000] * 40), model))) == 40
    assert max(seen) <= W.SMALL


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality.quality):
        assert sorted(r.score for r in run(docs, none).collect()) == [0.5] * 3
        assert run(docs.limit(0), none).count() == 0


def brute_segments(scores):
    """Maximal segments by definition: the best one, then the same left and right of it."""
    best = max(((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, i, j = max(b for b in [best])
    right = [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]
    return brute_segments(scores[:i]) + [(i, j - 1, best[0])] + right


def test_segments_equal_the_definition():
    import random

    rng = random.Random(1)
    for _ in range(60):
        hits = {i: rng.choice([0.07, 0.13, 0.31, 1.7]) for i in range(25) if rng.random() < 0.3}
        got = toxicity.segments(sorted(hits), [hits[i] for i in sorted(hits)])
        want = brute_segments([hits.get(i, -toxicity.COST) for i in range(25)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_extraction():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body><nav><a>Menu</a></nav>"
        "<div class='cookie-notice'>We use</div><article><h1>A &amp; B</h1><p>One  two<br>three<p><b>four</p></article>"
        "<div id='comments'><p>First!</p></div><form><p>Mail</p></form><footer>(c)</footer></body></html>"
    )
    assert extraction.main_text(page) == "A & B One two three four"
    plain = "<body><div>" + "".join(f"<p>{'word ' * 40}{i}.</p>" for i in range(5)) + "</div><ul>" + "<li><a>x</a></li>" * 9 + "</ul>"
    assert extraction.main_text(plain).count("word") == 200 and "x" not in extraction.main_text(plain)
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<p></p>") == ""


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= left
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len({r.doc_id for r in packed}) == left
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"


def test_broken_markup_and_odd_rows(spark):
    words = "many plain words of an article " * 20
    for odd in ("<![foo[bar]]>", "<![if !IE]>", "<![", "<![ >", "<!DOCTYPE [x", "<![CDATA[x]]>", "<!-- x", "</ >", "<a b='"):
        text = extraction.main_text(f"<article><p>Before</p>{odd}<p>{words}</p></article>")
        assert text.startswith("Before"), odd
    for odd in ("<![foo[bar]]>", "<![if !IE]>", "<![ >"):
        assert extraction.main_text(f"<article>{odd}<p>{words}</p></article>").endswith(words.strip()), odd
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(1, "u", long, 7), (1, "u", "<article>A</article>", 7), (1, "u", "<article>A</article>", 7), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.n_chars) for r in extraction.extract(pages).collect()), key=str)
    assert got == [(1, 1), (1, 1), (1, 50_000 * 10 - 1), (None, 0)]
    assert extraction.extract(pages.limit(0)).count() == 0
