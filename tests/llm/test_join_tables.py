"""Intermediate tables of the set joins: only what is asked for is looked up."""

from pyspark.sql import functions as F

from kerbside.llm import line_dedup, setjoin
from kerbside.llm.common import small_batches


def test_open_postings_come_once_with_what_is_earlier(spark):
    rows = [(1, 20, [5, 7, 9]), (1, 20, [5, 7, 9]), (2, 30, list(range(9, 21))), (3, 1, None)]
    digest = spark.createDataFrame(rows, "id long, n int, prefix array<long>")
    digest = digest.select("*", *[F.lit(0).cast("long").alias(f"s{i}") for i in range(4)])
    tokens = spark.createDataFrame([(t,) for t in (5, 9, *range(10, 21))], "token long")
    posts = setjoin.open_postings(digest, tokens, "posts")
    got = {(r.id, r.token): (r.n, r["at"], r.before) for r in posts.collect()}
    want = {(1, 5): (20, 0, []), (1, 9): (20, 2, [5])}
    want |= {(2, t): (30, t - 9, list(range(9, min(t, 17)))) for t in range(9, 21)}
    assert got == want and posts.count() == len(want)


def test_later_classes_are_named_by_key_and_id(spark):
    rows = [(b"a", 1, 3, 0, 0), (b"b", 2, 1, 0, 4), (b"c", 3, 1, 0, 2), (b"d", 4, None, 0, 9)]
    klass = spark.createDataFrame(rows, "key binary, id long, row long, hash long, line int")
    links = spark.createDataFrame([(b"a", b"b"), (b"c", b"b"), (b"d", b"c")], "a_key binary, b_key binary")
    got = {(bytes(r.key), r.id) for r in line_dedup._later(links, klass, "later").collect()}
    assert got == {(b"a", 1), (b"b", 2), (b"c", 3)}


def test_small_batches_are_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 7):
        sizes = spark.range(20, numPartitions=1).mapInArrow(
            lambda batches: (b.select(["id"]).slice(0, 1) for b in batches), "id long"
        )
        assert [r.id for r in sizes.collect()] == [0, 7, 14]
    assert spark.conf.get(name) == before
