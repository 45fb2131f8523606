"""Tables behind the map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.roles import pick_by_role
from kerbside.functions.text import county_tooltip, point_tooltip, school_tooltip
from kerbside.operators.lookups import lookup
from kerbside.sources.dims import SCHOOL_TYPE, SEVERITY

# --- fixed values: column names of the map tables ------------------------------------------
MAP_COLUMNS = {
    "PedestrianInjurySeverity": "ped_inj_name",
    "CrashDate": "CRSHDATE",
    "CrashTime": "CRSHTIME",
    "County": "CNTYNAME",
    "Street": "ONSTR",
    "CrossStreet": "ATSTR",
    "Year": "year",
    "vulnerable_role": "vulnerable_role",
    "vulnerable_role_es": "vulnerable_role_es",
    "longitude": "longitude",
    "latitude": "latitude",
}
# --------------------------------------------------------------------------------------------


def map_columns(df: DataFrame) -> DataFrame:
    """The columns of the point layer, under their published names."""
    return df.select(
        *[F.col(c).alias(name) for name, c in MAP_COLUMNS.items()],
        pick_by_role("age1", "age2", fallback=True).alias("PedestrianAge"),
    )


def point_labels(points: DataFrame, lang: str = "en") -> DataFrame:
    """Point layer with the severity's colour and the hover text."""
    role, severity = "vulnerable_role", F.col("PedestrianInjurySeverity")
    if lang == "es":
        role = "vulnerable_role_es"
        severity = lookup(severity, [(row[0], row[1]) for row in SEVERITY])
    colour = lookup("PedestrianInjurySeverity", [(row[0], row[3]) for row in SEVERITY])
    label = point_tooltip(role, "CrashDate", severity, "PedestrianAge", lang)
    return points.withColumns({"color": colour, "label": label})


def county_labels(counties: DataFrame, lang: str = "en") -> DataFrame:
    return counties.withColumn(
        "label", county_tooltip("County", "value", "MeanCrashes", "CrashesPerPopulation", lang)
    )


def school_labels(schools: DataFrame, lang: str = "en") -> DataFrame:
    """School layer; in Spanish with the translated school type as ``SCHOOLTYPE_es``."""
    kind = "SCHOOLTYPE"
    if lang == "es":
        schools = schools.withColumn("SCHOOLTYPE_es", lookup(kind, SCHOOL_TYPE))
        kind = "SCHOOLTYPE_es"
    return schools.withColumn("label", school_tooltip("SCHOOL", "DISTRICT", kind, lang))
