"""Summary tables by place: distinct crash documents per group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.config import DRIVER_VEHICLE_TYPES, FATAL_CODES, INJURY_CODES, VULNERABLE_ROLES
from kerbside.functions.nulls import n_distinct, one_of
from kerbside.functions.roles import is_youth, pick_by_role
from kerbside.functions.text import number_text
from kerbside.operators.curate import with_person_attributes
from kerbside.operators.filters import severity_in
from kerbside.operators.reshape import complete, lengthen, row_total, widen
from kerbside.sources.dims import INJURED_NAMES, SEVERITY_NAMES

# name of the summary -> (grouped by year, attribute)
SUMMARIES = {
    "crash_by_year": (True, None),
    "crash_by_race": (False, "vulnerable_race"),
    "crash_by_driver_race": (True, "driver_race"),
    "crash_by_age": (True, "vulnerable_age"),
    "crash_by_driver_age": (True, "driver_age"),
    "crash_by_sex": (True, "vulnerable_sex"),
    "crash_by_driver_sex": (True, "driver_sex"),
}


def _crashes_of(df: DataFrame, place: str, codes, values) -> DataFrame:
    if values is not None:
        df = df.where(one_of(place, values))
    return with_person_attributes(severity_in(df, codes))


def summary(
    df: DataFrame,
    place: str,
    by: Iterable[str] = ("year",),
    codes: Iterable[str] = INJURY_CODES,
    values: Iterable[str] | None = None,
) -> DataFrame:
    """Distinct documents per place, role, severity and ``by``; all places at once unless
    ``values`` lists some."""
    keys = [place, *by, "vulnerable_role", "ped_inj_name"]
    return (
        _crashes_of(df, place, codes, values)
        .groupBy(*keys)
        .agg(n_distinct("DOCTNMBR").alias("count"))
    )


def all_summaries(
    df: DataFrame,
    place: str,
    codes: Iterable[str] = INJURY_CODES,
    values: Iterable[str] | None = None,
) -> DataFrame:
    """The seven summaries of every place in one grouping.

    The filtered rows are read once; each gives seven (summary, year, value) entries. The
    distinct count combines entries before its first shuffle, which is keyed on the group
    and the document, so neither a large place nor a repeated document fills one task.
    """
    people = _crashes_of(df, place, codes, values)
    entries = []
    for name, (by_year, attribute) in SUMMARIES.items():
        if attribute is None:
            value = F.lit(None).cast("string")
        elif attribute.endswith("_age"):
            value = number_text(attribute)
        else:
            value = F.col(attribute)
        year = F.col("year") if by_year else F.lit(None).cast("int")
        entries.append(
            F.struct(F.lit(name).alias("summary"), year.alias("year"), value.alias("value"))
        )
    return (
        people.select(
            place, "vulnerable_role", "ped_inj_name", "DOCTNMBR",
            F.explode(F.array(*entries)).alias("entry"),
        )
        .select(place, "vulnerable_role", "ped_inj_name", "DOCTNMBR", "entry.*")
        .groupBy("summary", place, "year", "vulnerable_role", "ped_inj_name", "value")
        .agg(n_distinct("DOCTNMBR").alias("count"))
    )


def split_summaries(summaries: DataFrame, place: str) -> dict[str, DataFrame]:
    """``all_summaries`` as one table per summary, with the attribute under its name."""
    out = {}
    for name, (by_year, attribute) in SUMMARIES.items():
        cols = [place, *(["year"] if by_year else []), "vulnerable_role", "ped_inj_name"]
        part = summaries.where(F.col("summary") == name)
        picked = [F.col(c) for c in cols]
        if attribute:
            value = F.col("value")
            if attribute.endswith("_age"):
                value = value.cast("double")
            picked.append(value.alias(attribute))
        out[name] = part.select(*picked, "count")
    return out


def youth_by_year(
    by_age: DataFrame, max_age: float = 18, partial_year: int | None = None
) -> DataFrame:
    """Crashes of the young per year and severity, from the summary by age."""
    young = by_age.where(F.col("vulnerable_age") < max_age)
    if partial_year is not None:
        young = young.where(F.col("year") != partial_year)
    return young.groupBy("year", "ped_inj_name").agg(F.sum("count").alias("count"))


def youth_county(
    df: DataFrame,
    county: str = "CNTYNAME",
    roles: Iterable[str] = VULNERABLE_ROLES,
    max_age: float = 18,
    names: Iterable[str] | None = INJURED_NAMES,
) -> DataFrame:
    """Crashes of the young per county, year and severity, zero where there were none.

    Years are those of the whole table, so a county without a crash in a year has a zero.
    """
    young = df.where(is_youth(roles, max_age))
    counts = young.groupBy(county, "year", "ped_inj_name").agg(
        n_distinct("DOCTNMBR").alias("count")
    )
    years = df.agg(F.array_sort(F.collect_set("year"))).scalar()
    severities = F.array(*[F.lit(name) for name in SEVERITY_NAMES])
    out = complete(counts, [county], {"year": years, "ped_inj_name": severities})
    return out if names is None else out.where(one_of("ped_inj_name", names))


def youth_per_year(
    df: DataFrame, county: str = "CNTYNAME", roles: Iterable[str] = VULNERABLE_ROLES
) -> DataFrame:
    """The older form: per county and year only, nothing filled in."""
    return (
        df.where(is_youth(roles))
        .groupBy(county, "year")
        .agg(n_distinct("DOCTNMBR").alias("count"))
    )


def young_fatalities(
    df: DataFrame,
    counties: Iterable[str] | None,
    year: int,
    max_age: float = 18,
) -> DataFrame:
    """Listing of the fatal crashes of the young in one year."""
    if counties is not None:
        df = df.where(one_of("CNTYNAME", counties))
    return (
        severity_in(df.where(F.col("year") == year), FATAL_CODES)
        .withColumn("vulnerable_age", pick_by_role("age1", "age2"))
        .where(F.col("vulnerable_age") < max_age)
    )


# --- fixed values: legend names of the vehicle types -------------------------------------
VEHICLE_NAMES = {"CAR": "Car", "SUV": "SUV", "UT TRK": "Pickup Truck"}
# ------------------------------------------------------------------------------------------


def vehicle_share(
    df: DataFrame,
    by: Iterable[str] = ("ped_inj_name",),
    codes: Iterable[str] | None = None,
) -> DataFrame:
    """Percent of pedestrian crashes by the driver's vehicle type, in long form.

    A group in which one of the types has no crash has no total and so no shares.
    """
    by = list(by)
    df = df.where(F.col("vulnerable_role") == "Pedestrian")
    if codes is not None:
        df = severity_in(df, codes)
    counts = (
        with_person_attributes(df)
        .where(one_of("driver_vehtype", DRIVER_VEHICLE_TYPES))
        .groupBy("vulnerable_role", *by, "driver_vehtype")
        .agg(n_distinct("DOCTNMBR").alias("count"))
    )
    ids = ["vulnerable_role", *by]
    wide = row_total(
        widen(counts, ids, "driver_vehtype", "count", DRIVER_VEHICLE_TYPES),
        DRIVER_VEHICLE_TYPES,
    )
    shares = wide.select(
        *ids, *[(F.col(t) / F.col("total") * 100).alias(n) for t, n in VEHICLE_NAMES.items()]
    )
    return lengthen(shares, ids, VEHICLE_NAMES.values())


def count_by(
    df: DataFrame, by: Iterable[str], codes: Iterable[str] | None = None, out: str = "count"
) -> DataFrame:
    """Row counts."""
    if codes is not None:
        df = severity_in(df, codes)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def county_severity(df: DataFrame) -> DataFrame:
    return count_by(df, ["CNTYNAME", "year", "ped_inj_name"])


def state_severity(
    counties: DataFrame, names: Iterable[str] = INJURED_NAMES
) -> DataFrame:
    """All counties together, from the table per county."""
    return (
        counties.where(one_of("ped_inj_name", names))
        .groupBy("year", "ped_inj_name")
        .agg(F.sum("count").alias("count"))
    )
