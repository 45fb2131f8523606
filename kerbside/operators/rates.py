"""Rates per resident, top places and value scales."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import SEVERE_CODES
from kerbside.functions.nulls import as_col, one_of, safe_div
from kerbside.operators.lookups import join_suffix
from kerbside.operators.spatial import area_counts
from kerbside.operators.summaries import count_by
from kerbside.sources.dims import INJURED_NAMES


def per_100k(count: Column | str, population: Column | str) -> Column:
    return safe_div(as_col(count), as_col(population) / 100000)


def county_mean(df: DataFrame, names: Iterable[str] = INJURED_NAMES) -> DataFrame:
    """Mean crashes per year and mean position of each county.

    First per county and year, then over the years that have crashes; years without are
    not counted as zero.
    """
    yearly = (
        df.where(one_of("ped_inj_name", names))
        .groupBy(F.col("CNTYNAME").alias("County"), "year")
        .agg(
            F.count(F.lit(1)).alias("TotalCrashes"),
            F.avg("longitude").alias("longitude"),
            F.avg("latitude").alias("latitude"),
        )
    )
    return yearly.groupBy("County").agg(
        F.avg("TotalCrashes").alias("MeanCrashes"),
        F.avg("longitude").alias("longitude"),
        F.avg("latitude").alias("latitude"),
    )


def fill_rate(df: DataFrame, col: str = "CrashesPerPopulation") -> DataFrame:
    return df.fillna(0, subset=[col])


def county_rates(mean: DataFrame, population: DataFrame) -> DataFrame:
    """Crashes per year and 100,000 residents; a county without crashes has rate zero."""
    joined = population.join(mean, "County", "left")
    return fill_rate(
        joined.withColumn("CrashesPerPopulation", per_100k("MeanCrashes", "value"))
    )


def county_year_rate(
    df: DataFrame, population: DataFrame, codes: Iterable[str] = SEVERE_CODES
) -> DataFrame:
    """Severe crashes per county and year and per 100,000 residents. Both sides have a
    ``year``: the crash year is ``year_x``, that of the estimate ``year_y``."""
    counts = count_by(df, ["CNTYNAME", "year"], codes, out="TotalCrashes").withColumnRenamed(
        "CNTYNAME", "County"
    )
    joined = join_suffix(counts, population, "County")
    return joined.withColumn("CrashesPerPopulation", per_100k("TotalCrashes", "value"))


def top_places(df: DataFrame, n: int = 8, place: str = "CNTYNAME") -> DataFrame:
    """The ``n`` places with most crashes; places tied with the last one stay.

    The n-th largest count comes from a distributed top-k, so there is no global window.
    """
    totals = count_by(df, [place], out="TotalCrashes")
    last = totals.orderBy(F.desc("TotalCrashes")).limit(n).agg(F.min("TotalCrashes"))
    return totals.where(F.col("TotalCrashes") >= last.scalar())


def value_range(df: DataFrame, col: str) -> DataFrame:
    """One row: smallest and largest value."""
    return df.agg(F.min(col).alias("lowest"), F.max(col).alias("highest"))


def year_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def rescale(df: DataFrame, col: str, out: str = "scaled") -> DataFrame:
    """Position of a value between the column's smallest (0) and largest (1)."""
    span = value_range(df, col).select(F.struct("lowest", "highest")).scalar()
    low, high = span["lowest"], span["highest"]
    return df.withColumn(out, safe_div(F.col(col) - low, high - low))


def squish(c: Column | str, low: float, high: float) -> Column:
    """Values outside the limits are moved to the limit; null stays null."""
    c = as_col(c)
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def area_rates(
    polygons: DataFrame,
    crashes: DataFrame,
    key: str = "GEOID",
    min_population: float = 0,
    names: Iterable[str] = INJURED_NAMES,
    **options,
) -> DataFrame:
    """Crashes inside each area and per 100,000 residents, for areas with more than
    ``min_population`` residents. An area without crashes has zero."""
    points = crashes.where(
        one_of("ped_inj_name", names) & (F.col("latitude") > 0) & F.col("longitude").isNotNull()
    )
    lived_in = polygons.where(F.col("value") > min_population)
    return area_counts(lived_in, points, key, **options).withColumn(
        "CrashesPerPopulation", per_100k("crash_count", "value")
    )
