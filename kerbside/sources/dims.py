"""Inline dimension tables. All have a fixed handful of rows, so broadcasting is safe."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# --- fixed values: codes, names, colours and policies of the source data -----------------
SEVERITY = [
    ("Injury Severity Unknown", "Gravedad de la herida desconocida", None, "grey", 1),
    ("No apparent injury", "Sin herida aparente", "O", "#fafa6e", 2),
    ("Possible Injury", "Posible herida", "C", "#edc346", 3),
    ("Suspected Minor Injury", "Sospecha de herida menor", "B", "#d88d2d", 4),
    ("Suspected Serious Injury", "Sospecha de herida grave", "A", "#bd5721", 5),
    ("Fatality", "Fatalidad", "K", "#9b1c1c", 6),
]
RACE = [
    ("Asian", "A"),
    ("Black", "B"),
    ("Indian", "I"),
    ("Hispanic", "H"),
    ("White", "W"),
]
SCHOOL_TYPE = [
    ("Elementary School", "Escuela primaria"),
    ("High School", "Escuela secundaria"),
    ("Combined Elementary/Secondary School", "Escuela primaria/secundaria combinada"),
    ("Middle School", "Escuela secundaria"),
    ("Junior High School", "Escuela secundaria"),
]
WALK_POLICY = [
    ("Madison Metropolitan", "3269", 1.5, 1.5, 1.5),
    ("Milwaukee", "3619", 2.0, 2.0, 1.0),
]
LTS = [
    (1, "#1a9641"),
    (2, "#a6d96a"),
    (3, "#fdae61"),
    (4, "#d7191c"),
    (9, "#d7191c"),
]
COUNTY = [
    ("Dane", 13, "DANE"),
    ("Milwaukee", 40, "MILWAUKEE"),
]
INJURED_NAMES = ("Suspected Minor Injury", "Suspected Serious Injury", "Fatality")
# ------------------------------------------------------------------------------------------

SEVERITY_NAMES = [row[0] for row in SEVERITY]


def _inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table held in the plan itself: an Arrow table of a few rows needs no job to read."""
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame(
        pa.table({n: [row[i] for row in rows] for i, n in enumerate(names)}), schema
    )


def severity_dim(spark: SparkSession) -> DataFrame:
    return _inline(
        spark,
        SEVERITY,
        "InjSevName string, InjSevName_es string, code string, color string, severity_rank int",
    )


def race_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, RACE, "race_name string, code string")


def school_type_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, SCHOOL_TYPE, "en string, es string")


def walk_policy_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, WALK_POLICY, "name string, code string, hs double, ms double, es double")


def lts_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, LTS, "code int, color string")


def county_dim(spark: SparkSession) -> DataFrame:
    return _inline(spark, COUNTY, "name string, CNTYCODE int, COUNTY string")
