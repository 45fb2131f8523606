"""Profiles over months, weeks and days, running totals and shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.config import SEVERE_CODES
from kerbside.functions.calendar import (
    is_weekend,
    period_tag,
    report_month_end,
    week_floor,
    weekday_label,
    weekday_number,
    year_agnostic,
)
from kerbside.functions.nulls import in_set, not_in_set, safe_div
from kerbside.functions.roles import age_band
from kerbside.operators.filters import severity_in


def report_window(df: DataFrame, month_end: int = 9, days: int = 365) -> DataFrame:
    """One row: first and last year, end of the report month, number of prior years, label
    of the last twelve months."""
    bounds = df.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    bounds = bounds.withColumns(
        {
            "date_max": report_month_end(F.col("year_max"), month_end),
            "prior_years": F.col("year_max") - F.col("year_min") - 1,
        }
    )
    first = F.date_add(F.date_sub("date_max", days), 1)
    return bounds.withColumn(
        "label",
        F.concat(
            F.date_format(first, "MM/yyyy"), F.lit(" - "), F.date_format("date_max", "MM/yyyy")
        ),
    )


def window_of(df: DataFrame, month_end: int = 9) -> Column:
    """``report_window`` as one struct value, to use in expressions."""
    return report_window(df, month_end).select(F.struct("*").alias("w")).scalar()


def tag_periods(df: DataFrame, window: Column, days: int = 365) -> DataFrame:
    """Keep the prior years and the last year, tagged in ``period``."""
    end = window["date_max"]
    start = F.date_sub(end, (window["prior_years"] + 1) * days)
    return df.where(F.col("date") > start).withColumn("period", period_tag("date", end, days))


def event_window(
    df: DataFrame, start: str, split: str, end: str, out: str = "in_event", base: int = 2025
) -> DataFrame:
    """Keep the days from ``start`` to ``end`` of any year (``MM-dd``); flag those up to
    ``split``."""

    def day(text: str) -> Column:
        return F.to_date(F.lit(f"{base}-{text}"))

    moved = df.withColumn("date_yearagnostic", year_agnostic("date", base))
    return moved.where(F.col("date_yearagnostic").between(day(start), day(end))).withColumn(
        out, F.col("date_yearagnostic") <= day(split)
    )


def trick_or_treat_days(years: DataFrame) -> DataFrame:
    """31 October of every year, and the last Saturday and Sunday on or before it.

    ``years`` has one row with ``year_min`` and ``year_max``.
    """
    halloween = F.make_date("y", F.lit(10), F.lit(31))
    days = F.array(halloween, week_floor(halloween, "SAT"), week_floor(halloween, "SUN"))
    return (
        years.select(F.explode(F.sequence("year_min", "year_max")).alias("y"))
        .select(F.col("y").alias("year"), F.explode(days).alias("day"))
        .distinct()
    )


def flag_dates(df: DataFrame, days: DataFrame, out: str = "trickortreat") -> DataFrame:
    """Whether the row's date is one of ``days``; FALSE for a row without a date.

    A left join on the distinct days, which Spark broadcasts if they are few.
    """
    listed = days.select(F.col("day").alias("_day")).distinct()
    found = df.join(listed, df["date"] == listed["_day"], "left")
    return found.withColumn(out, F.col("_day").isNotNull()).drop("_day")


def inside_city(
    df: DataFrame, name: str, inside: str, outside: str = "Other municipalities"
) -> DataFrame:
    """Label of the city against the rest, with a rank that puts the rest first."""
    here = in_set("MUNINAME", [name])
    return df.withColumns(
        {
            "city": F.when(here, inside).otherwise(outside),
            "city_rank": F.when(here, 2).otherwise(1),
        }
    )


def year_to_date(df: DataFrame, month_end: int = 9) -> DataFrame:
    return df.where(F.col("month") <= month_end)


def ytd(
    df: DataFrame,
    by: Iterable[str] = (),
    month_end: int = 9,
    codes: Iterable[str] | None = None,
) -> DataFrame:
    """Crashes up to the end of a month, per year and ``by``."""
    df = year_to_date(df, month_end)
    if codes is not None:
        df = severity_in(df, codes)
    return df.groupBy("year", *by).agg(F.count(F.lit(1)).alias("total"))


def monthly_profile(df: DataFrame, by: str = "vulnerable_role") -> DataFrame:
    """Average crashes per month over the complete years, and those of the current year.

    ``by`` is ``vulnerable_role`` or ``age`` (age band, pedestrians only). A row without a
    year counts as a prior one. Null means no crash in that part, not zero.
    """
    years = df.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    span = years.select(F.struct("lo", "hi")).scalar()
    n_years = span["hi"] - span["lo"]
    if by == "age":
        df = df.where((F.col("vulnerable_role") == "Pedestrian") & F.col("ped_age").isNotNull())
        df = df.withColumn("age", age_band("ped_age"))
    else:
        df = df.where(F.col(by).isNotNull())
    df = df.withColumn("_now", F.coalesce(F.col("year") == span["hi"], F.lit(False)))
    counts = df.groupBy("month", by).agg(
        F.count_if(~F.col("_now")).alias("_prior"), F.count_if("_now").alias("_current")
    )
    prior = F.nullif("_prior", F.lit(0))
    return counts.select(
        "month",
        by,
        safe_div(prior, n_years).alias("average"),
        F.nullif("_current", F.lit(0)).alias("current"),
    )


def cumulative_by_year(
    df: DataFrame, codes: Iterable[str] = SEVERE_CODES, by: Iterable[str] = ()
) -> DataFrame:
    """Running total of monthly crashes within a year; absent months stay absent."""
    by = list(by)
    monthly = severity_in(df, codes).groupBy(*by, "year", "month").agg(
        F.count(F.lit(1)).alias("total")
    )
    months = (
        Window.partitionBy(*by, "year")
        .orderBy(F.col("month").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return monthly.withColumn("cumcrashes", F.sum("total").over(months))


def daily_profile(df: DataFrame, base: int = 2025) -> DataFrame:
    """Pedestrian crashes per calendar day and year, with the day's flag."""
    return (
        df.where(F.col("vulnerable_role") == "Pedestrian")
        .groupBy(
            year_agnostic("date", base).alias("date_yearagnostic"), "year", "trickortreat"
        )
        .agg(F.count(F.lit(1)).alias("total"))
    )


def weekend_average(df: DataFrame) -> DataFrame:
    """Mean pedestrian crashes per Saturday and Sunday, flagged days against others. Days
    without a crash do not count."""
    per_day = (
        df.where((F.col("vulnerable_role") == "Pedestrian") & is_weekend("date"))
        .groupBy("date", "trickortreat")
        .agg(F.count(F.lit(1)).alias("total"))
    )
    return per_day.groupBy(
        weekday_number("date").alias("wday"),
        weekday_label("date").alias("wday_label"),
        "trickortreat",
    ).agg(F.avg("total").alias("average"))


def weekly_profile(
    df: DataFrame,
    city: str | None = None,
    min_age: float = 18,
    first_day: str = "WED",
    base: int = 2025,
    count_open_year: bool = False,
) -> DataFrame:
    """Average pedestrian crashes of adults per week over the complete years.

    The divisor is the number of years kept; ``count_open_year`` adds the open one.
    """
    span = (
        df.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
        .select(F.struct("lo", "hi"))
        .scalar()
    )
    kept = df.where(
        (F.col("ped_age") >= min_age)
        & (F.col("vulnerable_role") == "Pedestrian")
        & (F.col("year") != span["hi"])
    )
    if city is not None:
        kept = kept.where(F.col("MUNINAME") == city)
    n_years = span["hi"] - span["lo"] + (1 if count_open_year else 0)
    weeks = kept.groupBy(
        week_floor(year_agnostic("date", base), first_day).alias("weekdate")
    ).agg(F.count(F.lit(1)).alias("_n"))
    return weeks.select("weekdate", safe_div("_n", n_years).alias("average"))


def share(col: str, by: Iterable[str]) -> Column:
    return safe_div(F.col(col), F.sum(col).over(Window.partitionBy(*by)))


def cum_share(col: str, by: Iterable[str], order: str) -> Column:
    by = list(by)
    so_far = F.sum(col).over(
        Window.partitionBy(*by)
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return safe_div(so_far, F.sum(col).over(Window.partitionBy(*by)))


def severity_share(df: DataFrame, max_age: float = 18) -> DataFrame:
    """Share and running share of severities per vehicle bucket, child pedestrians."""
    counts = (
        df.where(
            (F.col("ped_age") < max_age)
            & (F.col("nonvuln_vehicletype") != "Other")
            & (F.col("vulnerable_role") == "Pedestrian")
        )
        .groupBy("nonvuln_vehicletype", "ped_inj_name", "severity_rank")
        .agg(F.count(F.lit(1)).alias("total"))
    )
    by = ["nonvuln_vehicletype"]
    return counts.withColumns(
        {
            "percent": share("total", by),
            "cumpercent": cum_share("total", by, "severity_rank"),
        }
    )


def caption(df: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """One row: "first year - last year" and, if given, the month of retrieval."""
    out = df.agg(
        F.concat(
            F.min("year").cast("string"), F.lit(" - "), F.max("year").cast("string")
        ).alias("years")
    )
    if retrieved is None:
        return out
    return out.withColumn(
        "retrieved", F.date_format(retrieved.select("retrieve_date").scalar(), "MM/yyyy")
    )


def without_year(df: DataFrame, *years: int) -> DataFrame:
    """Drop whole years; rows without a year stay."""
    return df.where(not_in_set("year", years))
