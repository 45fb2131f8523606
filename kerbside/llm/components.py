"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import stored


def components(links: DataFrame, name: str) -> DataFrame:
    """``key``, ``component`` (smallest key reachable) for every key in ``links`` (``a``, ``b``).

    Each round every key takes the smallest label among its neighbours, then the label of its
    label, so the rounds grow with the logarithm of a chain's length. The minimum is combined
    before the shuffle, so a key with very many links is no hot task. Each round is stored.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = stored(both, name + "-links")
    labels = both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    while True:
        labels = stored(labels, name)
        near = (
            both.join(labels.select(F.col("key").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("key"))
            .agg(F.min("component").alias("near"))
        )
        own = labels.select("key", F.col("component").alias("was"))
        step = own.join(near, "key").select("key", "was", F.least("was", "near").alias("to"))
        # the label's own label, as it stood before this round
        jump = labels.select(F.col("key").alias("to"), F.col("component").alias("further"))
        after = stored(
            step.join(jump, "to").select("key", "was", F.least("to", "further").alias("component")),
            name + "-round",
        )
        if after.where("was != component").isEmpty():
            return labels
        labels = after.select("key", "component")
