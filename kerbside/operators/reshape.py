"""Long to wide, wide to long, completing combinations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widen(
    df: DataFrame, ids: Iterable[str], names: str, values: str, levels: Iterable
) -> DataFrame:
    """One row per id and one column per level. Levels are given, so no extra job reads
    them; a level without rows is a null column. Of several values for
    one cell the largest is taken."""
    return df.groupBy(*ids).pivot(names, list(levels)).agg(F.max(values))


def lengthen(
    df: DataFrame,
    ids: Iterable[str],
    cols: Iterable[str],
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def zero_fill(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Zero instead of null in every column that is not a key."""
    keys = set(keys)
    return df.fillna(0, subset=[c for c in df.columns if c not in keys])


def row_total(df: DataFrame, cols: Iterable[str], out: str = "total") -> DataFrame:
    """Sum of columns; a missing part makes the sum missing."""
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c)
    return df.withColumn(out, total)


def complete(
    df: DataFrame, keys: Iterable[str], dims: dict[str, Column], fill: str = "count"
) -> DataFrame:
    """Every combination of the dimensions' levels for every key, ``fill`` zero where there
    was no row.

    ``dims`` gives the levels of each column as an array value. A null counts as a further
    level for the keys that have one. The combinations come from exploding the arrays on
    the distinct keys; the rows of ``df`` are already grouped, so both sides are small.

    Both sides read the same columns of ``df``, so that Spark computes its grouping once and
    reuses the exchange.
    """
    keys, names = list(keys), list(dims)
    grid = (
        df.groupBy(*keys)
        .agg(
            *[F.max(F.col(c).isNull()).alias(f"_null_{c}") for c in names],
            F.max(fill).alias("_most"),
        )
        .where(F.col("_most").isNotNull())
    )
    for c, levels in dims.items():
        none = F.lit(None).cast(df.schema[c].dataType)
        grid = grid.withColumn(
            c, F.explode(F.when(F.col(f"_null_{c}"), F.array_append(levels, none)).otherwise(levels))
        )
    on = keys + names
    grid = grid.select(*on)
    right = df.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(fill).alias("_fill"))
    match = reduce(lambda a, b: a & b, [grid[c].eqNullSafe(right[f"_{c}"]) for c in on])
    return grid.join(right, match, "left").select(
        *on, F.coalesce("_fill", F.lit(0)).alias(fill)
    )
