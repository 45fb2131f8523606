"""Date expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.nulls import as_col


def parse_date(c: Column | str, formats: Iterable[str]) -> Column:
    """First format that fits; text that fits none becomes null."""
    return F.coalesce(*[F.try_to_date(as_col(c), f) for f in formats])


def month_label(c: Column | str) -> Column:
    return F.date_format(as_col(c), "MMM")


def week_of_year(c: Column | str) -> Column:
    """Week number counted from 1 January in steps of seven days (not the ISO week)."""
    return (F.floor((F.dayofyear(as_col(c)) - 1) / 7) + 1).cast("int")


def week_floor(c: Column | str, first_day: str = "SUN") -> Column:
    """Latest ``first_day`` on or before the date."""
    return F.next_day(F.date_sub(as_col(c), 7), first_day)


def weekday_number(c: Column | str) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(as_col(c))


def weekday_label(c: Column | str) -> Column:
    return F.date_format(as_col(c), "E")


def is_weekend(c: Column | str) -> Column:
    return weekday_number(c).isin(1, 7)


def year_agnostic(c: Column | str, base: int = 2025) -> Column:
    """The same month and day in ``base``; null if that day does not exist there."""
    c = as_col(c)
    moved = F.add_months(c, (F.lit(base) - F.year(c)) * 12)
    return F.when(F.dayofmonth(moved) == F.dayofmonth(c), moved)


def period_tag(c: Column | str, date_max: Column, days: int = 365) -> Column:
    """``lastyear`` for the last ``days`` days up to ``date_max``, else ``prior``."""
    c = as_col(c)
    return F.when(c <= F.date_sub(date_max, days), "prior").when(c.isNotNull(), "lastyear")


def report_month_end(year: Column, month: int) -> Column:
    return F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
