"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import (
    INJURY_CODES,
    NARROW_ROLES,
    SEVERE_CODES,
    VULNERABLE_ROLES,
    RunConfig,
)
from kerbside.functions.nulls import one_of, unless_any
from kerbside.functions.roles import is_severe_vulnerable, is_youth


class Box(NamedTuple):
    left: float
    bottom: float
    right: float
    top: float


def extract_filter(df: DataFrame, start_month: str, end_month: str) -> DataFrame:
    """Crashes from the start of one month to the end of another (``yyyy-MM``) that
    involve a bicycle or a pedestrian."""
    start = F.to_date(F.lit(f"{start_month}-01"))
    end = F.last_day(F.to_date(F.lit(f"{end_month}-01")))
    return df.where(
        F.col("date").between(start, end)
        & ((F.col("BIKEFLAG") == "Y") | (F.col("PEDFLAG") == "Y"))
    )


def focus(
    df: DataFrame,
    config: RunConfig,
    county: str = "COUNTY",
    school_type: str = "SCHOOLTYPE",
    district: str = "DISTRICT",
) -> DataFrame:
    """Schools of the configured counties, types and districts, ignoring case.

    A district counts only inside the chosen counties, which the county condition on the
    same row already says.
    """
    for col, values in (
        (county, config.county_focus),
        (school_type, config.school_type_focus),
        (district, config.district_focus),
    ):
        if values is not None:
            df = df.where(one_of(F.upper(col), [v.upper() for v in values]))
    return df


def in_counties(df: DataFrame, counties: Iterable[str], col: str = "COUNTY") -> DataFrame:
    return df.where(one_of(F.upper(col), [n.upper() for n in counties]))


def valid_schools(df: DataFrame) -> DataFrame:
    """Drop virtual schools and schools without coordinates or code."""
    return df.where(
        unless_any(
            F.col("VIRTUAL") == "Yes",
            F.col("LAT").isNull(),
            F.col("LON").isNull(),
            F.col("NCES_CODE").isNull(),
        )
    )


def placed_schools(df: DataFrame) -> DataFrame:
    """The older school filter: a positive latitude."""
    return df.where(F.col("LAT") > 0)


def with_coordinates(df: DataFrame) -> DataFrame:
    """Rows that can be placed on a map."""
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def youth(
    df: DataFrame, roles: Iterable[str] = VULNERABLE_ROLES, max_age: float | None = 18
) -> DataFrame:
    return df.where(is_youth(roles, max_age))


def severity_in(df: DataFrame, codes: Iterable[str] = INJURY_CODES) -> DataFrame:
    return df.where(one_of("ped_inj", codes))


def severe_vulnerable(
    df: DataFrame,
    roles: Iterable[str] = NARROW_ROLES,
    codes: Iterable[str] = SEVERE_CODES,
) -> DataFrame:
    return df.where(is_severe_vulnerable(roles, codes))


def box_condition(box: Box, lon: str = "longitude", lat: str = "latitude") -> Column:
    return F.col(lon).between(box.left, box.right) & F.col(lat).between(box.bottom, box.top)


def in_box(
    df: DataFrame, box: Box, lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """Points inside a constant box, all four sides included."""
    return df.where(box_condition(box, lon, lat))


def non_null(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def drop_totals(df: DataFrame, *cols: str, label: str = "Total") -> DataFrame:
    """Drop the total rows of a published table."""
    for c in cols:
        df = df.where(F.col(c) != label)
    return df


def of_year(df: DataFrame, year: int | str, col: str = "Year") -> DataFrame:
    """Rows of one year of a published table, whose year is text."""
    return df.where(F.col(col) == str(year))


def point_layer(
    df: DataFrame,
    box: Box,
    roles: Iterable[str] = ("Pedestrian",),
    year: int | None = None,
    not_year: int | None = None,
    after: Column | None = None,
    before: Column | None = None,
) -> DataFrame:
    """Crash points of a map: role, year or date window and box. Draw them ordered by
    ``severity_rank`` so that severe ones come last (``by_severity``)."""
    df = df.where(one_of("vulnerable_role", roles))
    if year is not None:
        df = df.where(F.col("year") == year)
    if not_year is not None:
        df = df.where(F.col("year") != not_year)
    if after is not None:
        df = df.where(F.col("date") > after)
    if before is not None:
        df = df.where(F.col("date") < before)
    return in_box(df, box)


def by_severity(df: DataFrame, rank: str = "severity_rank") -> DataFrame:
    """Severe rows last, rows without a severity at the very end.

    Rows of one severity are ordered by a hash of the row, only so that the sort can spread a
    frequent severity over several tasks.
    """
    spread = [c for c, kind in df.dtypes if "map<" not in kind]  # maps have no hash
    return df.orderBy(F.col(rank).asc_nulls_last(), F.xxhash64(*spread))
