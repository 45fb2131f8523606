"""Places within walking distance over a street network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.lineage import checkpointed


def network_reach(
    edges: DataFrame, sources: DataFrame, max_m: float, directed: bool = False
) -> DataFrame:
    """Shortest distance from every source to every node at most ``max_m`` away.

    ``edges``: ``src, dst, length`` (not negative); ``sources``: ``source, node``; result:
    ``source, node, distance``.

    Each round walks one edge on from the nodes whose distance fell in the last round, so
    the work follows the walking area and not the network. The table of distances is
    checkpointed every round: a lost executor costs one round, and the plan stays short.
    """
    steps = edges.where(F.col("length") <= max_m).select("src", "dst", "length")
    if not directed:
        steps = steps.unionByName(
            steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length")
        )
    # parallel edges and loops never shorten a way: keep the shortest of each pair
    steps = checkpointed(
        steps.where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.min("length").cast("double").alias("length"))
    )
    never = F.lit(None).cast("double")
    known = checkpointed(
        sources.select("source", "node")
        .distinct()
        .withColumns({"distance": F.lit(0.0), "old": never})
    )
    while True:
        front = known.where(F.col("old").isNull() | (F.col("distance") < F.col("old")))
        if front.isEmpty():
            return known.select("source", "node", "distance")
        walked = (
            front.select("source", F.col("node").alias("src"), "distance")
            .join(steps, "src")
            .select(
                "source", F.col("dst").alias("node"),
                (F.col("distance") + F.col("length")).alias("distance"),
                never.alias("old"),
            )
            .where(F.col("distance") <= max_m)
        )
        kept = known.select("source", "node", "distance", F.col("distance").alias("old"))
        known = checkpointed(
            kept.unionByName(walked)
            .groupBy("source", "node")
            .agg(F.min("distance").alias("distance"), F.min("old").alias("old"))
        )
