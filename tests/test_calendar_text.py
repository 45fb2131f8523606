import datetime as dt

from pyspark.sql import functions as F

from kerbside.functions import calendar, text
from kerbside.operators import trends
from kerbside.sources.exports import file_year


def values(spark, expression):
    return [r[0] for r in spark.range(1).select(expression).collect()][0]


def day(s):
    return F.to_date(F.lit(s))


def test_year_agnostic(spark):
    assert values(spark, calendar.year_agnostic(day("2019-03-31"))) == dt.date(2025, 3, 31)
    assert values(spark, calendar.year_agnostic(day("2024-02-29"))) is None
    assert values(spark, calendar.year_agnostic(day("2024-02-29"), 2028)) == dt.date(2028, 2, 29)
    assert values(spark, calendar.year_agnostic(F.lit(None).cast("date"))) is None


def test_week_of_year_is_not_iso(spark):
    got = [values(spark, calendar.week_of_year(day(d))) for d in ("2025-01-01", "2025-01-07", "2025-01-08", "2024-12-31")]
    assert got == [1, 1, 2, 53]


def test_week_floor(spark):
    # 2025-10-01 is a Wednesday
    assert values(spark, calendar.week_floor(day("2025-10-01"), "WED")) == dt.date(2025, 10, 1)
    assert values(spark, calendar.week_floor(day("2025-10-07"), "WED")) == dt.date(2025, 10, 1)


def test_halloween_days_against_a_loop(spark):
    years = spark.createDataFrame([(2017, 2026)], "year_min int, year_max int")
    got = {(r["year"], r["day"]) for r in trends.trick_or_treat_days(years).collect()}
    want = set()
    for y in range(2017, 2027):
        h = dt.date(y, 10, 31)
        want.add((y, h))
        for weekday in (5, 6):
            want.add((y, h - dt.timedelta((h.weekday() - weekday) % 7)))
    assert got == want


def test_flag_dates_is_false_without_a_date(spark):
    df = spark.createDataFrame([(dt.date(2020, 10, 31),), (dt.date(2020, 7, 1),), (None,)], "date date")
    days = spark.createDataFrame([(dt.date(2020, 10, 31),)], "day date")
    assert [r["trickortreat"] for r in trends.flag_dates(df, days).collect()] == [True, False, False]


def test_report_window_works_for_december(spark):
    df = spark.createDataFrame([(2018,), (2023,), (None,)], "year int")
    w = trends.report_window(df, 12).first()
    assert (w["year_min"], w["year_max"], w["prior_years"]) == (2018, 2023, 4)
    assert w["date_max"] == dt.date(2023, 12, 31) and w["label"] == "01/2023 - 12/2023"


def test_period_edges(spark):
    dates = [dt.date(2023, 9, 30), dt.date(2022, 10, 1), dt.date(2022, 9, 30), None]
    df = spark.createDataFrame([(d,) for d in dates], "date date")
    got = [r[0] for r in df.select(calendar.period_tag("date", day("2023-09-30"))).collect()]
    assert got == ["lastyear", "lastyear", "prior", None]


def test_title_and_names(spark):
    assert values(spark, text.title(F.lit("MID-TOWN/EAST SIDE"))) == "Mid-Town/East Side"
    assert values(spark, text.school_name(F.lit("Lake School"))) == "Lake School"
    assert values(spark, text.school_name(F.lit("School Lake"))) == "School Lake School"
    path = text.output_path(F.lit("DANE"), F.lit("Madison"), F.lit("Combined Elementary/Secondary School"), F.lit("A/B School"))
    assert values(spark, path) == (
        "school_maps/Dane County/Madison School District/Combined Elementary-Secondary Schools/A-B School.pdf"
    )


def test_numbers(spark):
    assert values(spark, text.number_text(F.lit(17.0))) == "17"
    assert values(spark, text.number_text(F.lit(17.5))) == "17.5"
    labels = [values(spark, text.pct_label(F.lit(x))) for x in (0.125, -0.1, 0.0, 0.135)]
    assert labels == ["+12%", "-10%", "0%", "+14%"]


def test_wrap_text(spark):
    t = "Accidental drowning and submersion, unspecified cause"
    lines = values(spark, text.wrap_text(F.lit(t), 30)).split("\n")
    assert " ".join(lines) == t and all(len(x) <= 30 for x in lines)
    long = "a " + "b" * 40 + " c"
    assert values(spark, text.wrap_text(F.lit(long), 30)).split("\n") == ["a", "b" * 40, "c"]
    assert values(spark, text.wrap_text(F.lit("  x \n y "), 30)) == "x y"


def test_tooltips(spark):
    got = values(spark, text.point_tooltip(F.lit(None).cast("string"), F.lit("2024-01-02"), F.lit(None).cast("string"), F.lit(None).cast("double")))
    assert got == "<b> </b><br>2024-01-02</br>NA</br> age: unknown age"
    got = values(spark, text.point_tooltip(F.lit("Ciclista"), F.lit("d"), F.lit("Fatalidad"), F.lit(9.0), "es"))
    assert got == "<b>Ciclista </b><br>d</br>Fatalidad</br>edad de Ciclista: 9"
    got = values(spark, text.county_tooltip(F.lit("FOND DU LAC"), F.lit(1234567), F.lit(2.5), F.lit(0.0)))
    assert got == (
        "<b>Fond Du Lac County</b></br>population: 1,234,567<br>average crashes per year: 2"
        "</br>average crashes/year per 100k residents: 0"
    )
    got = values(spark, text.school_tooltip(F.lit("Lake"), F.lit("D"), F.lit("High School")))
    assert got == "<b>Lake School</b></br>D School District</br>High School"


def test_file_year(spark):
    name = F.lit("crash-data-download_2023.csv")
    assert values(spark, file_year(name)) == "2023"
