"""From raw crash exports to the curated crash table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import BIKE_ROLES, DRIVER_ROLES, VULNERABLE_ROLES, YMD_FORMATS
from kerbside.functions.calendar import month_label, parse_date
from kerbside.functions.roles import ROLE_LABELS, is_role, pick_by_role, vehicle_bucket
from kerbside.operators.lookups import race_name, severity_name, severity_rank


def type_crashes(df: DataFrame, date_formats: Iterable[str] = YMD_FORMATS) -> DataFrame:
    """Typed date, ages and coordinates; text that does not parse becomes null.

    Column names ignore case, so the typed ``age1`` takes the place of the text ``AGE1``.
    """
    return df.withColumns(
        {
            "date": parse_date("CRSHDATE", date_formats),
            "age1": F.col("AGE1").try_cast("double"),
            "age2": F.col("AGE2").try_cast("double"),
            "latitude": F.col("LATDECDG").try_cast("double"),
            "longitude": F.col("LONDECDG").try_cast("double"),
        }
    )


def add_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "month": F.month("date"),
            "month_label": month_label("date"),
            "year": F.year("date"),
        }
    )


def curate(df: DataFrame, date_formats: Iterable[str] = YMD_FORMATS) -> DataFrame:
    """The curated crash table: one pass over the exports, no join and no shuffle.

    The role tests are made once per unit (``_one`` and ``_two``: vulnerable; ``_bike`` and
    ``_ped``: either unit), which keeps the generated code small enough to be compiled.
    """
    df = add_calendar(type_crashes(df, date_formats))
    df = df.withColumns(
        {
            "_one": is_role(1, VULNERABLE_ROLES),
            "_two": is_role(2, VULNERABLE_ROLES),
            "_bike": is_role(1, BIKE_ROLES) | is_role(2, BIKE_ROLES),
        }
    )

    def of_vulnerable(a1: str, a2: str) -> Column:
        return F.when(F.col("_one"), F.col(a1)).when(F.col("_two"), F.col(a2))

    def role_label(lang: str) -> Column:
        bicyclist, pedestrian = ROLE_LABELS[lang]
        return F.when(F.col("_bike"), bicyclist).when(F.col("_one") | F.col("_two"), pedestrian)

    df = df.withColumns(
        {
            "ped_inj": of_vulnerable("INJSVR1", "INJSVR2"),
            "ped_age": F.when(F.col("_one"), F.col("age1")).otherwise(F.col("age2")),
            "vulnerable_role": role_label("en"),
            "vulnerable_role_es": role_label("es"),
            "nonvuln_vehicletype": vehicle_bucket(
                F.when(F.col("_one"), F.col("VEHTYPE2")).otherwise(F.col("VEHTYPE1"))
            ),
            "InjSevName1": severity_name("INJSVR1"),
            "InjSevName2": severity_name("INJSVR2"),
            "race_name1": race_name("RACE1"),
            "race_name2": race_name("RACE2"),
            "vulnerable_race": race_name(of_vulnerable("RACE1", "RACE2")),
        }
    )
    return df.withColumns(
        {"ped_inj_name": severity_name("ped_inj"), "severity_rank": severity_rank("ped_inj")}
    ).drop("_one", "_two", "_bike")


# The person attributes that summaries group by: (output, attribute of unit 1, of unit 2,
# roles). The two race names exist after ``curate``.
PERSON_ATTRIBUTES = (
    ("vulnerable_age", "age1", "age2", VULNERABLE_ROLES),
    ("vulnerable_sex", "SEX1", "SEX2", VULNERABLE_ROLES),
    ("driver_race", "race_name1", "race_name2", DRIVER_ROLES),
    ("driver_age", "age1", "age2", DRIVER_ROLES),
    ("driver_sex", "SEX1", "SEX2", DRIVER_ROLES),
    ("driver_vehtype", "VEHTYPE1", "VEHTYPE2", DRIVER_ROLES),
)


def with_person_attributes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {out: pick_by_role(a1, a2, roles) for out, a1, a2, roles in PERSON_ATTRIBUTES}
    )


def retrieve_date(df: DataFrame) -> DataFrame:
    """One row: the latest retrieval time among the rows of the newest year."""
    newest = F.max(F.struct("year", "retreive_date"))
    return df.where(F.col("year").isNotNull()).agg(
        newest["retreive_date"].alias("retrieve_date")
    )
