"""Labelled rows to learn from, and the folds that scores are not learned on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import sized, stored

#: Most labelled rows that a model is learned from, chosen by a hash of ``doc_id``.
MOST_LABELLED = 200_000


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """``text`` (null is empty) and ``label`` (0 or 1) of the rows to learn from; stored. Only these
    two columns: no id, language or source can become an input."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.where(remainder(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"))
    known = stored(known, f"{label}-known")
    n = known.count()
    if n > MOST_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * MOST_LABELLED // n)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(sized(known, 16, n), "doc_id")
    return stored(rows.select("text", F.col("label").cast("int").alias("label")), f"{label}-training")


def isotonic(positive: list[float], total: list[float], prior: float = 1.0) -> list[float]:
    """Rising rates for counts in rising bins (pooled neighbours), each drawn to the mean rate by
    ``prior`` rows. Bins without rows lie between their neighbours; without any rows all are 0.5."""
    mean = (sum(positive) + 0.5) / (sum(total) + 1.0)
    pools: list[list[float]] = []  # positive, rows, bins
    used = [i for i, n in enumerate(total) if n]
    for i in used:
        pools.append([positive[i], total[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + p, pools[-1][1] + n, pools[-1][2] + k]
    rates = [(p + prior * mean) / (n + prior) for p, n, k in pools for _ in range(int(k))]
    if not used:
        return [mean] * len(total)
    rates = np.maximum.accumulate(rates)
    return np.interp(np.arange(len(total)), used, rates).tolist()
