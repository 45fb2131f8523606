"""Operator 5: token ids in Parquet files.

Files hold one row per document: ``doc_id``, ``n_tokens``, ``part`` and ``start`` (its place in
the part) as metadata columns, and ``ids`` as a list. Rows are in ascending ``doc_id`` order,
within files and by ``part`` over files. Row groups and pages are small enough to read a few
documents; the page indexes that Spark's Parquet writer adds let a reader skip pages by
``doc_id`` or ``start``. Ids repeat, so they get a dictionary; the ordered columns get
version-2 pages with delta encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import new_path, tasks
from kerbside.llm.tokens import encoder

FILE_SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``text`` of every row of ``docs`` (``doc_id``, ``text``; null text is empty), append
    ``end_id`` and write the files. Rows of one ``doc_id`` are ordered by their texts; a null
    ``doc_id`` comes first. Other columns are not read. No rows: no data in the files."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.slice(low, 500)
                ids = [np.append(x, np.uint32(end_id)) for x in own.batch(batch.column(1))]
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                    pa.array(np.concatenate(ids).view(np.int32)),
                )
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(ids), part, np.int32)),
                        "doc_id": batch.column(0),
                        "start": start + ends - size,
                        "n_tokens": size,
                        "ids": lists,
                    }
                )
                start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(2 * tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }
    rows.mapInArrow(encode, FILE_SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of the files, ``start`` counted over all documents. Only ``columns`` are read
    (and, for ``start``, the metadata columns of the parts). ``doc_id`` filters reach the files."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row per part of the write: as many as tasks, whatever the documents
    sums = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    before = spark.createDataFrame(before, "part int, before long")
    rows = rows.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before"))
    return rows.select(columns or ["doc_id", "start", "n_tokens", "ids"])


def crc32(ids: pa.Array) -> np.ndarray:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return np.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder, read them back and return ``doc_id``, ``start``,
    ``n_tokens`` and ``ids_crc32`` of every document from them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[:3], pa.array(crc32(batch.column(3)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = read_tokens(docs.sparkSession, path)
    return rows.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
