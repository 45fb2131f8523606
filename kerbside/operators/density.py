"""Kernel density on a lattice, its classes and their outlines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.lineage import checkpointed

BINS = 1024
#: Values of a kernel that a task works on at a time: few enough to stay in a core's cache.
BLOCK = 1 << 17


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], weight: str | None = None
) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation between order statistics. With ``weight`` a
    row stands for that many equal ones.

    The rows around each wanted rank are narrowed down by counting over ``BINS`` equal
    bins, again and again inside the bin that holds the rank, until that bin has a single
    value. Each round is one grouping with at most ``BINS`` rows per rank, so no task ever
    holds or sorts a column.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    first = df.agg(
        *[F.sum(F.when(F.col(c).isNotNull(), one)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(cols)],
    ).first()
    wanted, open_ranks = {}, {}
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        if not n:
            raise ValueError(f"no values in {c}")
        for p in probs:
            for rank in (math.floor((n - 1) * p), math.ceil((n - 1) * p)):
                open_ranks[(i, rank)] = (first[f"lo{i}"], first[f"hi{i}"], rank)
    while True:
        for key in [k for k, (lo, hi, _) in open_ranks.items() if lo == hi]:
            wanted[key] = open_ranks.pop(key)[0]
        if not open_ranks:
            break
        keys = list(open_ranks)
        entries = []
        for j, (i, rank) in enumerate(keys):
            lo, hi, _ = open_ranks[(i, rank)]
            value = F.col(cols[i]).cast("double")
            # halves first, so that the width of the widest range does not overflow
            place = (value / 2 - lo / 2) / (hi / 2 - lo / 2)
            number = F.least(F.floor(place * BINS), F.lit(BINS - 1))
            entries.append(
                F.when(
                    value.between(lo, hi),
                    F.struct(F.lit(j).alias("j"), number.alias("bin"), value.alias("value")),
                )
            )
        counted = (
            df.select(one.alias("w"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
            .groupBy("e.j", "e.bin")
            .agg(
                F.sum("w").alias("n"),
                F.min("e.value").alias("lo"),
                F.max("e.value").alias("hi"),
            )
            .collect()
        )
        for j, key in enumerate(keys):
            left = open_ranks[key][2]
            for row in sorted((r for r in counted if r["j"] == j), key=lambda r: r["bin"]):
                if left < row["n"]:
                    open_ranks[key] = (row["lo"], row["hi"], left)
                    break
                left -= row["n"]
    out = {}
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        values = []
        for p in probs:
            h = (n - 1) * p
            low, high = wanted[(i, math.floor(h))], wanted[(i, math.ceil(h))]
            values.append(low + (h - math.floor(h)) * (high - low))
        out[c] = values
    return out


def bandwidths(
    places: DataFrame, cols: list[str], weight: str, n: int, means: dict[str, float]
) -> dict[str, float]:
    """Kernel standard deviation per axis by the normal reference rule,
    ``1.06 * min(sd, IQR / 1.34) * n ** (-1/5)``."""
    quartiles = exact_quantiles(places, cols, [0.25, 0.75], weight)
    squares = places.agg(
        *[F.sum(F.col(weight) * (F.col(c) - means[c]) ** 2).alias(c) for c in cols]
    ).first()
    out = {}
    for c in cols:
        low, high = quartiles[c]
        sd = math.sqrt(squares[c] / (n - 1)) if n > 1 else 0.0
        out[c] = 1.06 * min(sd, (high - low) / 1.34) * n**-0.2
        if not out[c] > 0:
            raise ValueError(f"no spread in {c}: the density has no bandwidth")
    return out


def kde_grid(
    df: DataFrame, n: int = 200, x: str = "longitude", y: str = "latitude"
) -> DataFrame:
    """Gaussian kernel density at the ``n * n`` nodes of a lattice over the points' range.

    Points at the same place are counted once and checkpointed, so the input is read a single
    time. The kernel is a product of one factor per axis, so a task adds its batches into one
    matrix by a matrix product and emits that matrix once; the partial matrices are summed by
    node. The result is ``ix, iy, x, y, z`` with 1-based ``ix`` and ``iy``, checkpointed too:
    it has ``n * n`` rows whatever the input, and classes and outlines use it repeatedly.
    """
    places = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    places = checkpointed(places)
    row = places.agg(
        F.sum("w").alias("n"),
        F.min("px").alias("x0"), F.max("px").alias("x1"),
        F.min("py").alias("y0"), F.max("py").alias("y1"),
        F.sum(F.col("w") * F.col("px")).alias("sx"), F.sum(F.col("w") * F.col("py")).alias("sy"),
    ).first()
    count = row["n"]
    if not count:
        raise ValueError("no points")
    means = {"px": row["sx"] / count, "py": row["sy"] / count}
    h = bandwidths(places, ["px", "py"], "w", count, means)
    gx = np.linspace(row["x0"], row["x1"], n)
    gy = np.linspace(row["y0"], row["y1"], n)
    hx, hy = h["px"], h["py"]
    scale = 1.0 / (2.0 * math.pi * count * hx * hy)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        seen = False
        for batch in batches:
            px, py, w = (batch.column(i).to_numpy() for i in range(3))
            step = max(1, BLOCK // n)
            for at in range(0, len(px), step):
                part = slice(at, at + step)
                kx = np.exp(-0.5 * ((gx[:, None] - px[None, part]) / hx) ** 2) * w[None, part]
                ky = np.exp(-0.5 * ((gy[:, None] - py[None, part]) / hy) ** 2)
                total += kx @ ky.T
                seen = True
        if seen:
            ix, iy = np.divmod(np.arange(n * n, dtype=np.int32), np.int32(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ix + 1), pa.array(iy + 1), pa.array(total.ravel())],
                names=["ix", "iy", "z"],
            )

    parts = places.mapInArrow(partial, "ix int, iy int, z double")
    dx = (row["x1"] - row["x0"]) / (n - 1)
    dy = (row["y1"] - row["y0"]) / (n - 1)
    nodes = parts.groupBy("ix", "iy").agg((F.sum("z") * scale).alias("z"))
    return checkpointed(
        nodes.select(
            "ix",
            "iy",
            (F.lit(row["x0"]) + (F.col("ix") - 1) * dx).alias("x"),
            (F.lit(row["y0"]) + (F.col("iy") - 1) * dy).alias("y"),
            "z",
        )
    )


def classify(df: DataFrame, col: str = "z", classes: int = 10, out: str = "class") -> DataFrame:
    """Equal-width classes, closed on the right; the smallest value is in class 1."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    width = (span["hi"] - span["lo"]) / classes
    number = F.ceil(F.try_divide(F.col(col) - span["lo"], width))
    return df.withColumn(
        out,
        F.when(
            F.col(col).isNotNull(),
            F.greatest(F.least(F.coalesce(number, F.lit(1)), F.lit(classes)), F.lit(1)),
        ).cast("int"),
    )


def dissolve_cells(df: DataFrame, by: str = "class") -> DataFrame:
    """Outline of the cells of each class, as unit sides between lattice corners.

    Cell (ix, iy) reaches from corner (ix, iy) to (ix + 1, iy + 1). A side between two cells
    of one class appears twice and cancels. ``way`` is ``h`` (from ``ax, ay`` one step in x)
    or ``v`` (one step in y).
    """

    def side(dx: int, dy: int, way: str) -> Column:
        return F.struct(
            (F.col("ix") + dx).alias("ax"), (F.col("iy") + dy).alias("ay"), F.lit(way).alias("way")
        )

    sides = F.array(side(0, 0, "h"), side(0, 1, "h"), side(0, 0, "v"), side(1, 0, "v"))
    return (
        df.select(by, F.explode(sides).alias("s"))
        .select(by, "s.*")
        .groupBy(by, "ax", "ay", "way")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )
