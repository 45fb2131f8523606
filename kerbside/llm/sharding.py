"""Operator 8: shards of bounded size by extendible hashing, from DataFrame functions only.

A row's hash has 60 bits: 30 of its key, then 30 of its ``doc_id`` and text, so a key that
holds very many rows is split like any other bucket. The directory starts as one bucket; a
bucket over the byte limit is split on its next bit until every shard fits. Sizes are summed for
``STEP`` bits at a time, before anything is split, so a pass over the rows settles that many
levels, and only rows of buckets that are still too large are passed over again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import sized, stored

BITS = 60
STEP = 12
#: Bytes of text in a shard.
LIMIT = 64 << 20


def _bits(value: Column) -> Column:
    """The first 30 bits of the md5 of a text."""
    return F.shiftright(F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long"), 2)


def row_hash(key: str) -> Column:
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.shiftleft(_bits(own), 30) + _bits(row)


def _prefix(hash_: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({hash_}, {BITS} - {depth})")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``prefix``, ``depth``, ``bytes`` and ``rows`` of every shard of ``rows`` (``hash``, ``bytes``):
    the shallowest prefix whose rows fit in ``limit``, or all have one hash. Also ``fine`` and
    ``fine_depth``: one row for each prefix of the pass that settled the shard. Stored."""
    left, settled = rows, None
    for low in range(0, BITS, STEP):
        high = low + STEP
        fine = left.groupBy(_prefix("hash", high).alias("fine")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"),
            F.min("hash").alias("least"), F.max("hash").alias("most"),
        )
        fine = stored(fine, "shard-sizes")
        levels = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        each = fine.select("*", levels).withColumn("prefix", F.expr(f"shiftright(fine, {high} - depth)"))
        sums = each.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
            F.min("least").alias("least"), F.max("most").alias("most"),
        )
        fits = (F.col("bytes") <= limit) | (F.col("least") == F.col("most"))
        if high == BITS:
            fits |= F.col("depth") == BITS
        sums = sums.where(fits).select("depth", "prefix", "bytes", "rows")
        # a prefix fits in all of its own longer ones too: the shortest is the shard
        found = each.select("fine", "depth", "prefix").join(sums, ["depth", "prefix"])
        found = found.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "bytes", "rows")).alias("shard"))
        found = stored(found.select("fine", F.lit(high).alias("fine_depth"), "shard.*"), "shards")
        settled = found if settled is None else settled.union(found)
        open_ = fine.join(sized(found, 64).select("fine"), "fine", "left_anti").select("fine")
        open_ = stored(open_, "shard-open")
        if open_.isEmpty():
            break
        open_ = sized(open_, 16)
        left = left.join(open_, _prefix("hash", high) == open_["fine"], "left_semi")
    return settled


def assign(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``shard`` (its bits), ``depth``, ``shard_bytes`` and ``over_limit`` per
    row of ``docs``.

    Null keys and texts count as empty. Rows equal in key, ``doc_id`` and text have one hash and
    cannot be told apart: they share a shard, which is over the limit if they are too large
    together or the one row is (``over_limit``). No rows: no shards."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"),
        row_hash(key).alias("hash"),
    )
    rows = stored(rows, "shard-rows")
    shards = directory(rows.select("hash", "bytes"), limit)
    out = None
    depths = [r[0] for r in shards.select("fine_depth").distinct().collect()]  # at most BITS / STEP
    for depth in sorted(depths) or [STEP]:
        some = shards.where(F.col("fine_depth") == depth).withColumnRenamed("bytes", "shard_bytes")
        part = rows.join(sized(some, 64), _prefix("hash", depth) == F.col("fine"))
        out = part if out is None else out.union(part)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select(
        "doc_id",
        F.col("bytes").alias("n_bytes"),
        bits.alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        F.col("shard_bytes").cast("long").alias("shard_bytes"),
        (F.col("shard_bytes") > limit).alias("over_limit"),
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> None:
    """``docs`` as Parquet, one folder ``shard=<bits>`` (``shard=all`` for a single one) per shard. A
    column ``shard`` of ``docs`` is replaced."""
    hashed = docs.drop("shard").withColumn("__hash", row_hash(key))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    rows = stored(hashed.select(F.col("__hash").alias("hash"), size.alias("bytes")), "shard-rows")
    shards = directory(rows, limit)
    bits = F.when(F.col("depth") == 0, "all").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    named = shards.select("fine", "fine_depth", bits.alias("shard"))
    out = None
    for depth in [r[0] for r in shards.select("fine_depth").distinct().collect()]:
        some = sized(named.where(F.col("fine_depth") == depth), 64)
        part = hashed.join(some, _prefix("__hash", depth) == some["fine"])
        part = part.drop("fine", "fine_depth", "__hash")
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.withColumn("shard", F.lit("all"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
