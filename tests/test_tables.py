"""Summaries, rates, trends and reshaping on small tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kerbside.operators import rates, reshape, summaries, trends


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def crashes(curated):
    base = {"CNTYNAME": "DANE", "MUNINAME": "MADISON", "ROLE1": "PED", "CRSHDATE": "2023-05-01"}
    return curated(
        {**base, "DOCTNMBR": "1", "INJSVR1": "K", "AGE1": "9", "SEX1": "M", "ROLE2": "DR", "AGE2": "30", "SEX2": "F", "VEHTYPE2": "CAR"},
        {**base, "DOCTNMBR": "1", "INJSVR1": "K", "AGE1": "9", "SEX1": "M", "ROLE2": "DR", "AGE2": "30", "SEX2": "F", "VEHTYPE2": "CAR"},
        {**base, "DOCTNMBR": None, "INJSVR1": "K", "AGE1": "12", "SEX1": "F"},
        {**base, "DOCTNMBR": "2", "INJSVR1": "C", "AGE1": "9"},
        {**base, "DOCTNMBR": "3", "INJSVR1": "A", "AGE1": "40", "CRSHDATE": "2024-07-04", "CNTYNAME": None},
        {**base, "DOCTNMBR": "4", "INJSVR1": "B", "AGE1": "17", "CRSHDATE": "2024-02-29", "CNTYNAME": "ROCK", "MUNINAME": "BELOIT"},
    ).cache()


def test_summary_counts_documents(crashes):
    got = rows(summaries.summary(crashes, "CNTYNAME"), "CNTYNAME", "year", "ped_inj_name", "count")
    assert got == sorted([
        ("DANE", 2023, "Fatality", 2), (None, 2024, "Suspected Serious Injury", 1),
        ("ROCK", 2024, "Suspected Minor Injury", 1)], key=str)
    only = summaries.summary(crashes, "CNTYNAME", values=["ROCK"])
    assert only.count() == 1


def test_all_summaries_equal_the_single_ones(crashes):
    parts = summaries.split_summaries(summaries.all_summaries(crashes, "CNTYNAME"), "CNTYNAME")
    assert list(parts) == list(summaries.SUMMARIES)
    for name, (by_year, attribute) in summaries.SUMMARIES.items():
        by = [*(["year"] if by_year else []), *([attribute] if attribute else [])]
        single = summaries.summary(crashes, "CNTYNAME", by)
        assert rows(parts[name], *single.columns) == rows(single, *single.columns), name


def test_youth_county_fills_zeros(crashes):
    got = rows(summaries.youth_county(crashes), "CNTYNAME", "year", "ped_inj_name", "count")
    assert len(got) == 2 * 2 * 3
    assert ("ROCK", 2023, "Fatality", 0) in got and ("ROCK", 2024, "Suspected Minor Injury", 1) in got
    assert ("DANE", 2023, "Fatality", 2) in got


def test_complete_keeps_null_levels_only_where_seen(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("b", 2, "x", 7)], "k string, y int, s string, count int")
    years, labels = F.array(F.lit(1), F.lit(2)), F.array(F.lit("x"))
    got = rows(reshape.complete(df, ["k"], {"y": years, "s": labels}), "k", "y", "s", "count")
    assert got == sorted([("a", 1, None, 5), ("a", 1, "x", 0), ("a", 2, None, 0), ("a", 2, "x", 0),
                          ("b", 1, "x", 0), ("b", 2, "x", 7)], key=str)


def test_young_fatalities_and_youth_by_year(crashes):
    assert summaries.young_fatalities(crashes, ["DANE"], 2023).count() == 3
    by_age = summaries.summary(crashes, "CNTYNAME", ["year", "vulnerable_age"])
    got = rows(summaries.youth_by_year(by_age, partial_year=2024), "year", "ped_inj_name", "count")
    assert got == [(2023, "Fatality", 2)]


def test_vehicle_share_needs_all_types(curated):
    def crash(doc, vehicle, injury="K"):
        return {"DOCTNMBR": doc, "ROLE1": "PED", "ROLE2": "DR", "VEHTYPE2": vehicle, "INJSVR1": injury}

    df = curated(crash("1", "CAR"), crash("2", "CAR"), crash("3", "SUV"), crash("4", "UT TRK"),
                 crash("5", "CAR", "A"), crash("6", "BUS"))
    got = {(r["ped_inj_name"], r["name"]): r["value"] for r in summaries.vehicle_share(df).collect()}
    assert got[("Fatality", "Car")] == 50 and got[("Fatality", "Pickup Truck")] == 25
    assert got[("Suspected Serious Injury", "Car")] is None


def test_top_places_keep_ties(spark):
    names = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"] * 3 + ["e"]
    df = spark.createDataFrame([(n,) for n in names], "CNTYNAME string")
    assert rows(rates.top_places(df, 2), "CNTYNAME") == [("a",), ("b",), ("c",), ("d",)]
    assert rates.top_places(df, 9).count() == 5


def test_county_rates(spark, crashes):
    population = spark.createDataFrame(
        [("DANE", 2022, 200000), ("ROCK", 2022, 100000), ("IRON", 2022, 5000)], "County string, year int, value int")
    out = {r["County"]: r for r in rates.county_rates(rates.county_mean(crashes), population).collect()}
    assert out["DANE"]["CrashesPerPopulation"] == 1.5 and out["IRON"]["CrashesPerPopulation"] == 0
    assert out["IRON"]["MeanCrashes"] is None
    yearly = rates.county_year_rate(crashes, population)
    assert {"year_x", "year_y"} <= set(yearly.columns)
    scaled = {r["County"]: r["scaled"] for r in rates.rescale(rates.county_rates(rates.county_mean(crashes), population), "CrashesPerPopulation").collect()}
    assert scaled["IRON"] == 0 and scaled["DANE"] == 1


def test_squish(spark):
    df = spark.createDataFrame([(-3.0,), (0.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(rates.squish("x", -2, 2)).collect()] == [-2.0, 0.5, 2.0, None]


def test_monthly_profile(curated):
    def crash(date):
        return {"ROLE1": "PED", "CRSHDATE": date, "AGE1": "18"}

    df = curated(*[crash(d) for d in ("2021-01-05", "2022-01-05", "2022-01-06", "2023-01-09", "2021-03-01", "x")])
    got = rows(trends.monthly_profile(df), "month", "average", "current")
    assert got == sorted([(1, 1.5, 1), (3, 0.5, None), (None, 0.5, None)], key=str)
    ages = rows(trends.monthly_profile(df, "age"), "month", "age", "average")
    assert (1, "child", 1.5) in ages


def test_running_total_skips_missing_months(curated):
    df = curated(*[{"ROLE1": "PED", "INJSVR1": "K", "CRSHDATE": d} for d in ("2022-01-05", "2022-01-06", "2022-04-01", "2023-02-01")])
    got = rows(trends.cumulative_by_year(df), "year", "month", "cumcrashes")
    assert got == [(2022, 1, 2), (2022, 4, 3), (2023, 2, 1)]


def test_severity_share(curated):
    df = curated(*[{"ROLE1": "PED", "VEHTYPE2": v, "INJSVR1": i, "AGE1": "9"}
                   for v, i in (("CAR", "K"), ("CAR", "C"), ("CAR", "C"), ("CAR", "Z"), ("SUV", "O"), ("BUS", "K"))])
    got = rows(trends.severity_share(df), "nonvuln_vehicletype", "ped_inj_name", "percent", "cumpercent")
    assert got == sorted([("Car", "Fatality", 0.25, 0.75), ("Car", "Possible Injury", 0.5, 0.5),
                          ("Car", None, 0.25, 1.0), ("Truck/SUV", "No apparent injury", 1.0, 1.0)], key=str)


def test_weekly_divisor(curated):
    df = curated(*[{"ROLE1": "PED", "AGE1": "30", "CRSHDATE": d} for d in ("2021-10-01", "2022-10-02", "2023-10-03")])
    assert rows(trends.weekly_profile(df), "weekdate", "average") == [(dt.date(2025, 10, 1), 1.0)]
    assert rows(trends.weekly_profile(df, count_open_year=True), "average")[0][0] == pytest.approx(2 / 3)


def test_daily_profile_keeps_leap_day(curated):
    df = curated({"ROLE1": "PED", "CRSHDATE": "2024-02-29"}).withColumn("trickortreat", F.lit(False))
    assert rows(trends.daily_profile(df), "date_yearagnostic", "year", "total") == [(None, 2024, 1)]


def test_widen_lengthen_round_trip(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, n string, v int")
    wide = reshape.widen(df, ["k"], "n", "v", ["x", "y", "z"])
    assert wide.columns == ["k", "x", "y", "z"]
    back = reshape.lengthen(wide, ["k"], ["x", "y", "z"], "n", "v").where("v is not null")
    assert rows(back, "k", "n", "v") == rows(df, "k", "n", "v")
    filled = reshape.row_total(reshape.zero_fill(wide, ["k"]), ["x", "y"])
    assert rows(filled, "k", "total") == [("a", 3), ("b", 3)]
    assert {r["k"]: r["total"] for r in reshape.row_total(wide, ["x", "y"]).collect()}["b"] is None


def test_hex_change_division(spark):
    from kerbside.functions.nulls import safe_div

    assert spark.range(1).select(safe_div(F.lit(3), F.lit(0))).first()[0] == math.inf
