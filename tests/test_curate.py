"""Null rules, role picks, labels and types of the curated table."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kerbside.config import MDY_FORMATS
from kerbside.functions import nulls, roles
from kerbside.operators.curate import curate, retrieve_date, with_person_attributes
from kerbside.operators.lookups import keep_in, not_in, translate
from kerbside.operators.trends import without_year
from kerbside.sources import dims


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_membership_is_two_valued(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert [r[0] for r in df.select(nulls.in_set("c", ["a"])).collect()] == [True, False, False]
    assert [r["c"] for r in df.where(nulls.not_in_set("c", ["a"])).collect()] == ["b", None]


def test_unless_keeps_null_conditions(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None), (2, 1)], "a int, b int")
    kept = df.where(nulls.unless_all(F.col("a") == 1, F.col("b") == 1))
    assert kept.count() == 3
    dropped = df.where(nulls.unless_any(F.col("a") == 1, F.col("b") == 1))
    assert [tuple(r) for r in dropped.collect()] == [(None, None)]


def test_division(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0)], "a double, b double"
    )
    got = [r[0] for r in df.select(nulls.safe_div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3] == 0.25 and got[4] is None


def test_distinct_count_has_null_as_value(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", None), ("h", "b")], "k string, v string")
    got = {r["k"]: r["n"] for r in df.groupBy("k").agg(nulls.n_distinct("v").alias("n")).collect()}
    assert got == {"g": 2, "h": 1}


def test_bad_text_becomes_null(curated):
    row = one(curated({"CRSHDATE": "someday", "AGE1": "x", "AGE2": "17", "LATDECDG": "", "LONDECDG": "-88.5"}))
    assert row["date"] is None and row["year"] is None and row["month_label"] is None
    assert row["age1"] is None and row["age2"] == 17.0
    assert row["latitude"] is None and row["longitude"] == -88.5


@pytest.mark.parametrize("text", ["2024-02-29", "2024/2/29", "20240229"])
def test_date_formats(curated, text):
    row = one(curated({"CRSHDATE": text}))
    assert row["date"] == dt.date(2024, 2, 29) and row["year"] == 2024 and row["month_label"] == "Feb"


def test_month_first_dates(raw):
    df = curate(raw({"CRSHDATE": "02/03/2024"}), MDY_FORMATS)
    assert one(df)["date"] == dt.date(2024, 2, 3)


def test_severity_names(curated):
    cases = [("K", "Fatality", 6), (None, "Injury Severity Unknown", 1), ("Z", None, None)]
    for code, name, rank in cases:
        row = one(curated({"ROLE1": "PED", "INJSVR1": code}))
        assert (row["ped_inj"], row["ped_inj_name"], row["severity_rank"]) == (code, name, rank)


def test_both_units_vulnerable_takes_the_first(curated):
    row = one(curated({"ROLE1": "O PED", "ROLE2": "BIKE", "INJSVR1": "C", "INJSVR2": "K",
                       "AGE1": "8", "AGE2": "40", "RACE1": "A", "RACE2": "W"}))
    assert row["ped_inj"] == "C" and row["ped_age"] == 8.0 and row["vulnerable_race"] == "Asian"
    assert row["vulnerable_role"] == "Bicyclist" and row["vulnerable_role_es"] == "Ciclista"


def test_nobody_vulnerable(curated):
    row = one(curated({"ROLE1": "DR", "ROLE2": None, "INJSVR1": "K", "AGE1": "8", "AGE2": "40",
                       "RACE1": "X", "RACE2": "W"}))
    assert row["ped_inj"] is None and row["ped_inj_name"] == "Injury Severity Unknown"
    assert row["ped_age"] == 40.0  # falls back to unit 2
    assert row["vulnerable_role"] is None and row["vulnerable_race"] is None
    assert row["race_name1"] is None and row["race_name2"] == "White"


def test_vehicle_of_the_other_unit(curated):
    def bucket(role1, v1, v2):
        return one(curated({"ROLE1": role1, "VEHTYPE1": v1, "VEHTYPE2": v2}))["nonvuln_vehicletype"]

    assert bucket("PED", "CAR", "UT TRK") == "Truck/SUV"
    assert bucket("DR", "CAR", "SUV") == "Car"
    assert bucket("DR", None, "SUV") == "Other"
    assert bucket(None, "SUV", "CAR") == "Truck/SUV"


def test_curate_agrees_with_the_role_expressions(curated):
    kinds = [None, "DR", "PED", "O PED", "PED NO", "BIKE", "O BIKE"]
    df = curated(*[{"ROLE1": a, "ROLE2": b, "INJSVR1": "A", "INJSVR2": "B", "AGE1": "1", "AGE2": "2",
                    "VEHTYPE1": "CAR", "VEHTYPE2": "SUV"} for a in kinds for b in kinds])
    again = df.select(
        F.col("vulnerable_role").eqNullSafe(roles.vulnerable_role()).alias("role"),
        F.col("ped_inj").eqNullSafe(roles.pick_by_role("INJSVR1", "INJSVR2")).alias("injury"),
        F.col("ped_age").eqNullSafe(roles.pick_by_role("age1", "age2", fallback=True)).alias("age"),
        F.col("nonvuln_vehicletype").eqNullSafe(roles.vehicle_bucket()).alias("vehicle"),
    )
    assert all(all(r) for r in again.collect())


def test_person_attributes(curated):
    row = one(with_person_attributes(curated(
        {"ROLE1": "DR", "ROLE2": "PED", "AGE1": "50", "AGE2": "9", "SEX1": "M", "SEX2": "F",
         "RACE1": "H", "VEHTYPE1": "CAR"})))
    assert row["vulnerable_age"] == 9.0 and row["driver_age"] == 50.0
    assert row["vulnerable_sex"] == "F" and row["driver_sex"] == "M"
    assert row["driver_race"] == "Hispanic" and row["driver_vehtype"] == "CAR"


def test_youth_and_severe_filters(curated):
    df = curated(
        {"DOCTNMBR": "1", "ROLE1": "PED", "AGE1": "17", "INJSVR1": "O", "INJSVR2": "K"},
        {"DOCTNMBR": "2", "ROLE1": "PED", "AGE1": "18", "ROLE2": "DR", "AGE2": "9", "INJSVR1": "K"},
        {"DOCTNMBR": "3", "ROLE1": "DR", "ROLE2": "BIKE", "AGE2": None, "INJSVR2": "A"},
        {"DOCTNMBR": "4", "ROLE1": None, "ROLE2": "BIKE", "AGE2": "3"},
    )
    young = df.where(roles.is_youth()).select("DOCTNMBR").collect()
    assert sorted(r[0] for r in young) == ["1", "4"]
    assert df.where(roles.is_youth(max_age=None)).count() == 4
    severe = df.where(roles.is_severe_vulnerable(["BIKE", "PED"], ["A", "K"])).select("DOCTNMBR")
    assert sorted(r[0] for r in severe.collect()) == ["2", "3"]


def test_retrieve_date_is_of_the_newest_year(curated):
    t = [dt.datetime(2024, 5, d) for d in (1, 2, 3)]
    df = curated({"CRSHDATE": "2023-01-01", "retreive_date": t[2]},
                 {"CRSHDATE": "2024-01-01", "retreive_date": t[0]},
                 {"CRSHDATE": "2024-03-01", "retreive_date": t[1]},
                 {"CRSHDATE": "bad", "retreive_date": t[2]})
    assert one(retrieve_date(df))["retrieve_date"] == t[1]


def test_without_year_keeps_missing_years(curated):
    df = curated({"CRSHDATE": "2023-01-01"}, {"CRSHDATE": "2024-01-01"}, {"CRSHDATE": None})
    assert sorted(str(r["year"]) for r in without_year(df, 2024).collect()) == ["2023", "None"]


def test_semi_and_anti_joins_match_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    other = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(str(r[0]) for r in keep_in(df, other, "k").collect()) == ["None", "a"]
    assert [r[0] for r in not_in(df, other, "k").collect()] == ["b"]
    no_null = spark.createDataFrame([("a",)], "k string")
    assert sorted(str(r[0]) for r in not_in(df, no_null, "k").collect()) == ["None", "b"]


def test_dimensions(spark):
    assert dims.severity_dim(spark).where("code is null").count() == 1
    counts = [d(spark).count() for d in (dims.severity_dim, dims.race_dim, dims.school_type_dim,
                                         dims.walk_policy_dim, dims.lts_dim, dims.county_dim)]
    assert counts == [6, 5, 5, 2, 5, 2]
    df = spark.createDataFrame([("High School",), ("Other",)], "t string")
    out = translate(df, dims.school_type_dim(spark), "t", "es")
    assert {r["t"]: r["es"] for r in out.collect()} == {"High School": "Escuela secundaria", "Other": None}
