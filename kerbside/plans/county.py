"""Result tables of the report on one county, and of the county comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.config import SEVERE_CODES
from kerbside.operators import hexes, trends
from kerbside.operators.lookups import keep_in
from kerbside.operators.rates import county_year_rate, top_places, year_range


def county_report(
    crashes: DataFrame,
    county: str,
    city: str,
    month_end: int = 9,
    cells_m: tuple[float, ...] = (3000, 500),
) -> dict[str, DataFrame]:
    """All tables of the report. They are lazy; the county filter is part of each scan."""
    own = crashes.where(F.col("CNTYNAME") == county)
    flagged = trends.flag_dates(own, trends.trick_or_treat_days(year_range(own)))
    in_city = trends.inside_city(own, city, f"City of {city.title()}")
    tables = {
        "window": trends.report_window(own, month_end),
        "month_role": trends.monthly_profile(own),
        "month_age": trends.monthly_profile(own, "age"),
        "years": trends.ytd(own, (), month_end),
        "years_severe": trends.ytd(own, ["ped_inj_name"], month_end, SEVERE_CODES),
        "years_city": trends.ytd(in_city, ["city", "city_rank"], month_end, SEVERE_CODES),
        "cumulative": trends.cumulative_by_year(own),
        "halloween": trends.daily_profile(flagged),
        "halloween_weekend": trends.weekend_average(flagged),
        "vehicles": trends.severity_share(own),
        "adult_weeks": trends.weekly_profile(own, city),
    }
    for cell_m in cells_m:
        tables[f"hex_{int(cell_m)}"] = hexes.hex_change(own, cell_m, month_end)
    tables["october"] = hexes.hex_event(own, min(cells_m), city=city)
    return tables


def county_comparison(crashes: DataFrame, population: DataFrame, n: int = 8) -> DataFrame:
    """Yearly severe crashes per resident of the counties with most crashes."""
    top = top_places(crashes, n).withColumnRenamed("CNTYNAME", "County")
    return keep_in(county_year_rate(crashes, population), top, "County")
