"""Line dedup of one text with very many lines, and the plans that cut it."""

import random
import time

from pyspark.sql import functions as F

from kerbside.llm import line_dedup, setjoin
from test_joins import without_repeats


def many_lines(n, seed=3):
    """Lines of nine words, every other one with one word of the line before it changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    out = []
    for _ in range(n // 2):
        line = [word() for _ in range(60)]
        out += [" ".join(line), " ".join([*line[:-1], word()])]
    return out


def test_many_similar_lines_of_one_text(spark):
    rows = [(1, "\n".join(many_lines(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == without_repeats(rows)

    def seconds(n):
        docs = spark.createDataFrame([(1, "\n".join(many_lines(n)))], "doc_id long, text string")
        start = time.time()
        assert line_dedup.dedup_lines(docs).first()["n_removed"] == n // 2
        return time.time() - start

    seconds(400)
    assert seconds(16_000) < 4 * seconds(4_000) + 10


def test_a_text_is_cut_once_for_all_its_lines(spark):
    picks = "picks array<struct<line: int, id: bigint, key: binary>>"
    docs = spark.createDataFrame([("a\nb\nc", [(2, 5, b"x"), (0, 6, b"y")])], f"text string, {picks}")
    got = setjoin.picked_lines(docs)
    assert [tuple(r) for r in got.collect()] == [(5, b"x", "c"), (6, b"y", "a")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "lambdafunction(split" not in plan


def test_taking_lines_out(spark):
    docs = spark.createDataFrame(
        [("a\nb\nc\nd", [0, 2]), ("a\nb", [0, 1]), ("a\nb\n", [1]), ("", [0]), ("x\ny\nz", [2])],
        "text string, drop array<int>",
    ).withColumn("lines", F.split("text", "\n", -1))
    got = [r.t for r in docs.select(line_dedup._without(F.col("lines"), F.col("drop")).alias("t")).collect()]
    assert got == ["b\nd", "", "a\n", "", "x\ny"]
