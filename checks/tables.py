"""Queries over summaries, rates and trends: Spark on one side, SQL on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import V1, V2, on_crashes, race_name, severity_name, severity_rank
from checks.surrogate import crashes, raw_crashes, table
from kerbside.config import FATAL_CODES, INJURY_CODES, SEVERE_CODES
from kerbside.functions.roles import age_band
from kerbside.operators import filters, lookups, rates, summaries, trends
from kerbside.operators.curate import retrieve_date, with_person_attributes
from kerbside.sources.population import population_dim

QUERIES = {}
ORACLES = {}


def registrar(queries: dict, oracles: dict):
    """Decorator that registers a query and its SQL. Dates and times are compared as text:
    ``dates`` names such columns of the SQL."""

    def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
        def register(fn):
            queries[name] = fn
            if dates:

                def as_text(spark, sf):
                    df = fn(spark, sf)
                    return df.withColumns({c: F.col(c).cast("string") for c in dates})

                queries[name] = as_text
            if sql is not None:
                replaced = ", ".join(f"{c}::VARCHAR AS {c}" for c in dates)
                oracles[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if dates else sql
            return fn

        return register

    return query


query = registrar(QUERIES, ORACLES)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


ROW = "row_order, row_line, row_part"
ROW_COLS = ["row_order", "row_line", "row_part"]

# ---- curation ---------------------------------------------------------------------------

CURATED = [
    "DOCTNMBR", "CNTYNAME", "MUNINAME", "ROLE1", "ROLE2", "age1", "age2", "date", "month",
    "month_label", "year", "latitude", "longitude", "InjSevName1", "InjSevName2", "ped_inj",
    "ped_inj_name", "severity_rank", "ped_age", "vulnerable_role", "vulnerable_role_es",
    "race_name1", "race_name2", "vulnerable_race", "nonvuln_vehicletype",
]


def _round_coords(sql: str) -> str:
    return sql.replace("latitude", "round(latitude, 6) AS latitude").replace(
        "longitude", "round(longitude, 6) AS longitude"
    )


@query("curated_crashes", on_crashes(_round_coords(f"SELECT {ROW}, {', '.join(CURATED)} FROM crashes")), dates=("date",))
def curated_crashes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crashes(spark, sf).select(*ROW_COLS, *CURATED), "latitude", "longitude")


@query(
    "person_attributes",
    on_crashes(
        f"SELECT {ROW}, vulnerable_age, vulnerable_sex, driver_race, driver_age, driver_sex, "
        "driver_vehtype FROM people"
    ),
)
def person_attributes(spark, sf):
    return with_person_attributes(crashes(spark, sf)).select(
        *ROW_COLS, "vulnerable_age", "vulnerable_sex", "driver_race", "driver_age",
        "driver_sex", "driver_vehtype",
    )


@query(
    "retrieve_date",
    on_crashes(
        "SELECT max(retreive_date) AS retrieve_date FROM crashes "
        "WHERE year = (SELECT max(year) FROM crashes)"
    ),
    dates=("retrieve_date",),
)
def retrieve_date_q(spark, sf):
    return retrieve_date(crashes(spark, sf))


@query(
    "extract_filter",
    on_crashes(
        f"SELECT {ROW}, DOCTNMBR, date FROM crashes WHERE date BETWEEN DATE '1996-03-01' "
        "AND DATE '1998-02-28' AND (BIKEFLAG = 'Y' OR PEDFLAG = 'Y')"
    ),
    dates=("date",),
)
def extract_filter_q(spark, sf):
    return filters.extract_filter(crashes(spark, sf), "1996-03", "1998-02").select(
        *ROW_COLS, "DOCTNMBR", "date"
    )


@query(
    "severity_and_race",
    on_crashes(
        f"SELECT {ROW}, {severity_name('INJSVR2')} AS name, {severity_rank('INJSVR2')} AS rank, "
        f"{race_name('RACE2')} AS race FROM raw"
    ),
)
def severity_and_race(spark, sf):
    named = lookups.with_severity(raw_crashes(spark, sf), "INJSVR2", "name", rank="rank")
    return lookups.with_race(named, "RACE2", "race").select(*ROW_COLS, "name", "rank", "race")


# ---- summaries (one per place kind) --------------------------------------------------------

_INJURED = "ped_inj IN ('A', 'K', 'B')"

for _place, _prefix in (("CNTYNAME", "county"), ("MUNINAME", "city")):
    for _name, (_by_year, _attr) in summaries.SUMMARIES.items():
        _by = ([*["year"] * _by_year, *([_attr] if _attr else [])])
        _keys = ", ".join([_place, *_by, "vulnerable_role", "ped_inj_name"])

        def _summary(spark, sf, place=_place, by=tuple(_by)):
            return summaries.summary(crashes(spark, sf), place, by)

        query(
            f"{_prefix}_{_name}",
            on_crashes(
                f"SELECT {_keys}, count(DISTINCT DOCTNMBR) AS count FROM people "
                f"WHERE {_INJURED} GROUP BY {_keys}"
            ),
        )(_summary)


def _all_summaries_sql(place: str) -> str:
    parts = []
    for name, (by_year, attr) in summaries.SUMMARIES.items():
        year = "year" if by_year else "NULL::INTEGER"
        value = "NULL::VARCHAR"
        if attr:
            value = f"{attr}::BIGINT::VARCHAR" if attr.endswith("_age") else attr
        parts.append(
            f"SELECT '{name}' AS summary, {place}, {year} AS year, vulnerable_role, "
            f"ped_inj_name, {value} AS value, count(DISTINCT DOCTNMBR) AS count "
            f"FROM people WHERE {_INJURED} GROUP BY ALL"
        )
    return on_crashes("\nUNION ALL\n".join(parts))


@query("all_summaries_county", _all_summaries_sql("CNTYNAME"))
def all_summaries_county(spark, sf):
    return summaries.all_summaries(crashes(spark, sf), "CNTYNAME")


@query("all_summaries_city", _all_summaries_sql("MUNINAME"))
def all_summaries_city(spark, sf):
    return summaries.all_summaries(crashes(spark, sf), "MUNINAME")


@query(
    "youth_by_year",
    on_crashes(
        "SELECT year, ped_inj_name, sum(count)::BIGINT AS count FROM by_age "
        "WHERE vulnerable_age < 18 AND year <> 2001 GROUP BY year, ped_inj_name",
        "by_age AS (SELECT CNTYNAME, year, vulnerable_role, ped_inj_name, vulnerable_age, "
        f"count(DISTINCT DOCTNMBR) AS count FROM people WHERE {_INJURED} GROUP BY ALL)",
    ),
)
def youth_by_year(spark, sf):
    by_age = summaries.summary(crashes(spark, sf), "CNTYNAME", ["year", "vulnerable_age"])
    return summaries.youth_by_year(by_age, partial_year=2001)


_YOUTH = f"(({V1} AND age1 < 18) OR ({V2} AND age2 < 18))"


@query(
    "youth_county",
    on_crashes(
        "SELECT g.CNTYNAME, g.year, g.ped_inj_name, coalesce(c.count, 0)::BIGINT AS count "
        "FROM grid g LEFT JOIN counted c ON g.CNTYNAME IS NOT DISTINCT FROM c.CNTYNAME "
        "AND g.year IS NOT DISTINCT FROM c.year "
        "AND g.ped_inj_name IS NOT DISTINCT FROM c.ped_inj_name "
        "WHERE g.ped_inj_name IN "
        "('Suspected Minor Injury', 'Suspected Serious Injury', 'Fatality')",
        "counted AS (SELECT CNTYNAME, year, ped_inj_name, count(DISTINCT DOCTNMBR) AS count "
        f"FROM crashes WHERE {_YOUTH} GROUP BY ALL)",
        "lv AS (SELECT DISTINCT year FROM crashes WHERE year IS NOT NULL)",
        "yr AS (SELECT k.CNTYNAME, lv.year FROM (SELECT DISTINCT CNTYNAME FROM counted) k, lv "
        "UNION ALL SELECT DISTINCT CNTYNAME, year FROM counted WHERE year IS NULL)",
        "grid AS (SELECT yr.CNTYNAME, yr.year, s.ped_inj_name FROM yr, (SELECT unnest(["
        "'Suspected Minor Injury', 'Suspected Serious Injury', 'Fatality']) "
        "AS ped_inj_name) s)",
    ),
)
def youth_county(spark, sf):
    return summaries.youth_county(crashes(spark, sf))


@query(
    "youth_per_year",
    on_crashes(
        "SELECT CNTYNAME, year, count(DISTINCT DOCTNMBR) AS count FROM crashes "
        f"WHERE {_YOUTH} GROUP BY CNTYNAME, year"
    ),
)
def youth_per_year(spark, sf):
    return summaries.youth_per_year(crashes(spark, sf))


@query(
    "young_fatalities",
    on_crashes(
        f"SELECT {ROW}, DOCTNMBR, CNTYNAME, date, vulnerable_age, vulnerable_role FROM people "
        "WHERE year = 1999 AND ped_inj = 'K' AND vulnerable_age < 18 "
        "AND CNTYNAME IN ('NATION_3', 'NATION_7')"
    ),
    dates=("date",),
)
def young_fatalities(spark, sf):
    found = summaries.young_fatalities(crashes(spark, sf), ["NATION_3", "NATION_7"], 1999)
    return found.select(
        *ROW_COLS, "DOCTNMBR", "CNTYNAME", "date", "vulnerable_age", "vulnerable_role"
    )


def _vehicle_share_sql(by: str, where: str = "TRUE") -> str:
    return on_crashes(
        f"SELECT 'Pedestrian' AS vulnerable_role, {by}, name, round(value, 6) AS value FROM ("
        f"SELECT {by}, 'Car' AS name, car / (car + suv + ut) * 100 AS value FROM w UNION ALL "
        f"SELECT {by}, 'SUV', suv / (car + suv + ut) * 100 FROM w UNION ALL "
        f"SELECT {by}, 'Pickup Truck', ut / (car + suv + ut) * 100 FROM w)",
        f"w AS (SELECT {by}, "
        "nullif(count(DISTINCT CASE WHEN driver_vehtype = 'CAR' THEN DOCTNMBR END), 0)::DOUBLE car, "
        "nullif(count(DISTINCT CASE WHEN driver_vehtype = 'SUV' THEN DOCTNMBR END), 0)::DOUBLE suv, "
        "nullif(count(DISTINCT CASE WHEN driver_vehtype = 'UT TRK' THEN DOCTNMBR END), 0)::DOUBLE ut "
        "FROM people WHERE vulnerable_role = 'Pedestrian' "
        f"AND driver_vehtype IN ('CAR', 'SUV', 'UT TRK') AND {where} GROUP BY {by})",
    )


@query("vehicle_share_by_severity", _vehicle_share_sql("ped_inj_name"))
def vehicle_share_by_severity(spark, sf):
    return rounded(summaries.vehicle_share(crashes(spark, sf)), "value")


@query("vehicle_share_by_year", _vehicle_share_sql("year", _INJURED))
def vehicle_share_by_year(spark, sf):
    return rounded(summaries.vehicle_share(crashes(spark, sf), ["year"], INJURY_CODES), "value")


@query("vehicle_share_fatal", _vehicle_share_sql("year", "ped_inj = 'K'"))
def vehicle_share_fatal(spark, sf):
    return rounded(summaries.vehicle_share(crashes(spark, sf), ["year"], FATAL_CODES), "value")


_COUNTY_SEVERITY = (
    "cs AS (SELECT CNTYNAME, year, ped_inj_name, count(*) AS count FROM crashes GROUP BY ALL)"
)


@query("county_severity", on_crashes("SELECT * FROM cs", _COUNTY_SEVERITY))
def county_severity(spark, sf):
    return summaries.county_severity(crashes(spark, sf))


@query(
    "state_severity",
    on_crashes(
        "SELECT year, ped_inj_name, sum(count)::BIGINT AS count FROM cs WHERE ped_inj_name IN "
        "('Suspected Minor Injury', 'Suspected Serious Injury', 'Fatality') GROUP BY ALL",
        _COUNTY_SEVERITY,
    ),
)
def state_severity(spark, sf):
    return summaries.state_severity(summaries.county_severity(crashes(spark, sf)))


@query(
    "county_severity_of",
    on_crashes("SELECT * FROM cs WHERE CNTYNAME = 'NATION_3'", _COUNTY_SEVERITY),
)
def county_severity_of(spark, sf):
    return summaries.county_severity(crashes(spark, sf)).where(F.col("CNTYNAME") == "NATION_3")


@query(
    "county_role_counts",
    on_crashes(
        "SELECT CNTYNAME, vulnerable_role, count(*) AS count FROM crashes GROUP BY ALL"
    ),
)
def county_role_counts(spark, sf):
    return summaries.count_by(crashes(spark, sf), ["CNTYNAME", "vulnerable_role"])


@query(
    "county_role_year_counts",
    on_crashes(
        "SELECT CNTYNAME, vulnerable_role, year, count(*) AS count FROM crashes "
        f"WHERE {_INJURED} GROUP BY ALL"
    ),
)
def county_role_year_counts(spark, sf):
    return summaries.count_by(
        crashes(spark, sf), ["CNTYNAME", "vulnerable_role", "year"], INJURY_CODES
    )


# ---- rates -------------------------------------------------------------------------------


def population_estimates(spark, sf) -> DataFrame:
    """County estimates in long form: people counted per nation, and a second measure."""
    people = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg((F.count(F.lit(1)) * 1000).alias("value"))
    )
    counted = table(spark, sf, "nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"))
    return counted.select(
        F.concat(F.initcap("n_name"), F.lit(" County, Example State")).alias("NAME"),
        F.explode(F.array(F.lit("POPESTIMATE"), F.lit("BIRTHS"))).alias("variable"),
        F.lit(2022).alias("year"),
        F.col("value"),
    )


_POP = (
    "pop AS (SELECT upper(n_name) AS County, 2022 AS year, count(*) * 1000 AS value "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"
)


def population(spark, sf) -> DataFrame:
    return population_dim(population_estimates(spark, sf))


@query(
    "population_dim",
    f"WITH {_POP} SELECT County, year, value FROM pop",
)
def population_q(spark, sf):
    return population(spark, sf).select("County", "year", "value")


_MEAN = (
    "yearly AS (SELECT CNTYNAME AS County, year, count(*) AS n, avg(longitude) AS lon, "
    "avg(latitude) AS lat FROM crashes WHERE ped_inj_name IN "
    "('Suspected Minor Injury', 'Suspected Serious Injury', 'Fatality') GROUP BY ALL), "
    "mean AS (SELECT County, avg(n) AS MeanCrashes, avg(lon) AS longitude, "
    "avg(lat) AS latitude FROM yearly GROUP BY County)"
)


@query(
    "county_mean",
    on_crashes(
        "SELECT County, round(MeanCrashes, 6) AS MeanCrashes, round(longitude, 6) AS longitude, "
        "round(latitude, 6) AS latitude FROM mean",
        _MEAN,
    ),
)
def county_mean(spark, sf):
    return rounded(rates.county_mean(crashes(spark, sf)), "MeanCrashes", "longitude", "latitude")


_RATES = (
    "rate AS (SELECT pop.County, pop.value, m.MeanCrashes, "
    "coalesce(m.MeanCrashes / (pop.value / 100000e0), 0) AS CrashesPerPopulation "
    "FROM pop LEFT JOIN mean m ON pop.County = m.County)"
)


@query(
    "county_rates",
    on_crashes(
        "SELECT County, value, round(MeanCrashes, 6) AS MeanCrashes, "
        "round(CrashesPerPopulation, 6) AS CrashesPerPopulation FROM rate",
        _POP, _MEAN, _RATES,
    ),
)
def county_rates(spark, sf):
    out = rates.county_rates(rates.county_mean(crashes(spark, sf)), population(spark, sf))
    return rounded(
        out.select("County", "value", "MeanCrashes", "CrashesPerPopulation"),
        "MeanCrashes", "CrashesPerPopulation",
    )


@query(
    "rescaled_rates",
    on_crashes(
        "SELECT County, round((CrashesPerPopulation - lo) / (hi - lo), 6) AS scaled, "
        "round(greatest(least(CrashesPerPopulation, 1000), 100), 6) AS squished FROM rate, "
        "(SELECT min(CrashesPerPopulation) AS lo, max(CrashesPerPopulation) AS hi FROM rate)",
        _POP, _MEAN, _RATES,
    ),
)
def rescaled_rates(spark, sf):
    out = rates.county_rates(rates.county_mean(crashes(spark, sf)), population(spark, sf))
    out = rates.rescale(out, "CrashesPerPopulation").withColumn(
        "squished", rates.squish("CrashesPerPopulation", 100, 1000)
    )
    return rounded(out.select("County", "scaled", "squished"), "scaled", "squished")


@query(
    "value_range",
    on_crashes(
        "SELECT round(min(CrashesPerPopulation), 6) AS lowest, "
        "round(max(CrashesPerPopulation), 6) AS highest FROM rate",
        _POP, _MEAN, _RATES,
    ),
)
def value_range(spark, sf):
    out = rates.county_rates(rates.county_mean(crashes(spark, sf)), population(spark, sf))
    return rounded(rates.value_range(out, "CrashesPerPopulation"), "lowest", "highest")


_SEVERE_YEAR = (
    "sev AS (SELECT CNTYNAME AS County, year AS year_x, count(*) AS TotalCrashes FROM crashes "
    "WHERE ped_inj IN ('A', 'K') GROUP BY ALL)"
)


@query(
    "county_year_rate",
    on_crashes(
        "SELECT s.County, s.year_x, s.TotalCrashes, p.year AS year_y, p.value, "
        "round(s.TotalCrashes / (p.value / 100000e0), 6) AS CrashesPerPopulation "
        "FROM sev s LEFT JOIN pop p ON s.County = p.County",
        _POP, _SEVERE_YEAR,
    ),
)
def county_year_rate(spark, sf):
    out = rates.county_year_rate(crashes(spark, sf), population(spark, sf))
    return rounded(
        out.select("County", "year_x", "TotalCrashes", "year_y", "value", "CrashesPerPopulation"),
        "CrashesPerPopulation",
    )


_TOP = (
    "top AS (SELECT CNTYNAME, TotalCrashes FROM (SELECT *, rank() OVER "
    "(ORDER BY TotalCrashes DESC) AS r FROM (SELECT CNTYNAME, count(*) AS TotalCrashes "
    "FROM crashes GROUP BY CNTYNAME)) WHERE r <= 8)"
)


@query("top_places", on_crashes("SELECT * FROM top", _TOP))
def top_places(spark, sf):
    return rates.top_places(crashes(spark, sf), 8)


@query(
    "keep_in_top_places",
    on_crashes(
        "SELECT County, year_x AS year, TotalCrashes FROM sev WHERE EXISTS "
        "(SELECT 1 FROM top WHERE top.CNTYNAME IS NOT DISTINCT FROM sev.County)",
        _SEVERE_YEAR, _TOP,
    ),
)
def keep_in_top_places(spark, sf):
    data = crashes(spark, sf)
    top = rates.top_places(data, 8).withColumnRenamed("CNTYNAME", "County")
    severe = summaries.count_by(data, ["CNTYNAME", "year"], SEVERE_CODES, out="TotalCrashes")
    return lookups.keep_in(severe.withColumnRenamed("CNTYNAME", "County"), top, "County")


@query(
    "not_in_top_places",
    on_crashes(
        "SELECT County, year_x AS year, TotalCrashes FROM sev WHERE NOT EXISTS "
        "(SELECT 1 FROM top WHERE top.CNTYNAME IS NOT DISTINCT FROM sev.County)",
        _SEVERE_YEAR, _TOP,
    ),
)
def not_in_top_places(spark, sf):
    data = crashes(spark, sf)
    top = rates.top_places(data, 8).withColumnRenamed("CNTYNAME", "County")
    severe = summaries.count_by(data, ["CNTYNAME", "year"], SEVERE_CODES, out="TotalCrashes")
    return lookups.not_in(severe.withColumnRenamed("CNTYNAME", "County"), top, "County")


@query(
    "year_range",
    on_crashes("SELECT min(year)::INTEGER AS year_min, max(year)::INTEGER AS year_max FROM crashes"),
)
def year_range(spark, sf):
    return rates.year_range(crashes(spark, sf))


@query(
    "distinct_counties",
    on_crashes("SELECT DISTINCT CNTYNAME, MUNINAME FROM crashes"),
)
def distinct_counties(spark, sf):
    return lookups.distinct_values(crashes(spark, sf), "CNTYNAME", "MUNINAME")


# ---- trends -------------------------------------------------------------------------------

_SPAN = "span AS (SELECT min(year) AS lo, max(year) AS hi FROM crashes)"


def _month_sql(by: str, where: str) -> str:
    return on_crashes(
        f"SELECT month, {by}, round(nullif(p, 0) / (hi - lo)::DOUBLE, 6) AS average, "
        "nullif(c, 0) AS current FROM (SELECT month, "
        f"{by}, count(*) FILTER (WHERE year IS DISTINCT FROM hi) AS p, "
        f"count(*) FILTER (WHERE year = hi) AS c FROM banded, span WHERE {where} "
        "GROUP BY ALL), span",
        _SPAN,
        "banded AS (SELECT *, CASE WHEN ped_age <= 18 THEN 'child' ELSE 'adult' END AS age "
        "FROM crashes)",
    )


@query("monthly_profile_role", _month_sql("vulnerable_role", "vulnerable_role IS NOT NULL"))
def monthly_profile_role(spark, sf):
    return rounded(trends.monthly_profile(crashes(spark, sf)), "average")


@query(
    "monthly_profile_age",
    _month_sql("age", "vulnerable_role = 'Pedestrian' AND ped_age IS NOT NULL"),
)
def monthly_profile_age(spark, sf):
    return rounded(trends.monthly_profile(crashes(spark, sf), "age"), "average")


@query(
    "age_band",
    on_crashes(
        "SELECT CASE WHEN ped_age <= 18 THEN 'child' ELSE 'adult' END AS age, "
        "count(*) AS count FROM crashes WHERE ped_age IS NOT NULL GROUP BY ALL"
    ),
)
def age_band_q(spark, sf):
    people = filters.non_null(crashes(spark, sf), "ped_age")
    return summaries.count_by(people.withColumn("age", age_band("ped_age")), ["age"])


@query(
    "ytd_total",
    on_crashes("SELECT year, count(*) AS total FROM crashes WHERE month <= 9 GROUP BY year"),
)
def ytd_total(spark, sf):
    return trends.ytd(crashes(spark, sf))


@query(
    "ytd_severity",
    on_crashes(
        "SELECT year, ped_inj_name, count(*) AS total FROM crashes "
        "WHERE month <= 9 AND ped_inj IN ('K', 'A') GROUP BY ALL"
    ),
)
def ytd_severity(spark, sf):
    return trends.ytd(crashes(spark, sf), ["ped_inj_name"], codes=SEVERE_CODES)


@query(
    "ytd_city",
    on_crashes(
        "SELECT year, CASE WHEN MUNINAME = 'MACHINERY' THEN 'City' "
        "ELSE 'Other municipalities' END AS city, count(*) AS total FROM crashes "
        "WHERE month <= 9 AND ped_inj IN ('K', 'A') GROUP BY ALL"
    ),
)
def ytd_city(spark, sf):
    flagged = trends.inside_city(crashes(spark, sf), "MACHINERY", "City")
    return trends.ytd(flagged, ["city"], codes=SEVERE_CODES)


@query(
    "cumulative_by_year",
    on_crashes(
        "SELECT year, month, total, sum(total) OVER (PARTITION BY year ORDER BY month "
        "NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS cumcrashes FROM (SELECT year, month, "
        "count(*) AS total FROM crashes WHERE ped_inj IN ('K', 'A') GROUP BY ALL)"
    ),
)
def cumulative_by_year(spark, sf):
    return trends.cumulative_by_year(crashes(spark, sf))


_WINDOW = (
    "win AS (SELECT lo, hi, last_day(make_date(hi, 9, 1)) AS date_max, hi - lo - 1 AS prior "
    "FROM span)"
)


@query(
    "report_window",
    on_crashes(
        "SELECT lo::INTEGER AS year_min, hi::INTEGER AS year_max, date_max, "
        "prior::INTEGER AS prior_years, "
        "strftime(date_max - 364, '%m/%Y') || ' - ' || strftime(date_max, '%m/%Y') AS label "
        "FROM win",
        _SPAN, _WINDOW,
    ),
    dates=("date_max",),
)
def report_window(spark, sf):
    return trends.report_window(crashes(spark, sf))


@query(
    "period_tag",
    on_crashes(
        "SELECT CNTYNAME, CASE WHEN date <= date_max - 365 THEN 'prior' ELSE 'lastyear' END "
        "AS period, count(*) AS count FROM crashes, win "
        "WHERE date > date_max - (365 * (prior + 1))::INTEGER GROUP BY ALL",
        _SPAN, _WINDOW,
    ),
)
def period_tag(spark, sf):
    data = crashes(spark, sf)
    tagged = trends.tag_periods(data, trends.window_of(data))
    return summaries.count_by(tagged, ["CNTYNAME", "period"])


_AGNOSTIC = "try_cast('2025-' || strftime(date, '%m-%d') AS DATE)"


@query(
    "event_window",
    on_crashes(
        "SELECT d AS date_yearagnostic, d <= DATE '2025-10-07' AS in_event, count(*) AS count "
        f"FROM (SELECT {_AGNOSTIC} AS d FROM crashes) "
        "WHERE d BETWEEN DATE '2025-10-01' AND DATE '2025-10-14' GROUP BY ALL"
    ),
    dates=("date_yearagnostic",),
)
def event_window(spark, sf):
    kept = trends.event_window(crashes(spark, sf), "10-01", "10-07", "10-14")
    return summaries.count_by(kept, ["date_yearagnostic", "in_event"])


_DAYS = (
    "hw AS (SELECT y::INTEGER AS year, make_date(y, 10, 31) AS h FROM "
    "(SELECT unnest(generate_series(lo, hi)) AS y FROM span)), "
    "days AS (SELECT DISTINCT year, day FROM (SELECT year, h AS day FROM hw UNION ALL "
    "SELECT year, h - ((dayofweek(h) + 1) % 7)::INTEGER FROM hw UNION ALL "
    "SELECT year, h - dayofweek(h)::INTEGER FROM hw))"
)


@query("trick_or_treat_days", on_crashes("SELECT year, day FROM days", _SPAN, _DAYS), dates=("day",))
def trick_or_treat_days(spark, sf):
    return trends.trick_or_treat_days(rates.year_range(crashes(spark, sf)))


def _flagged(spark, sf) -> DataFrame:
    data = crashes(spark, sf)
    return trends.flag_dates(data, trends.trick_or_treat_days(rates.year_range(data)))


_FLAGGED = (
    "flagged AS (SELECT *, coalesce(date IN (SELECT day FROM days), FALSE) AS trickortreat "
    "FROM crashes)"
)


@query(
    "flag_dates",
    on_crashes(
        "SELECT CNTYNAME, trickortreat, count(*) AS count FROM flagged GROUP BY ALL",
        _SPAN, _DAYS, _FLAGGED,
    ),
)
def flag_dates(spark, sf):
    return summaries.count_by(_flagged(spark, sf), ["CNTYNAME", "trickortreat"])


@query(
    "daily_profile",
    on_crashes(
        f"SELECT {_AGNOSTIC} AS date_yearagnostic, year, trickortreat, count(*) AS total "
        "FROM flagged WHERE vulnerable_role = 'Pedestrian' GROUP BY ALL",
        _SPAN, _DAYS, _FLAGGED,
    ),
    dates=("date_yearagnostic",),
)
def daily_profile(spark, sf):
    return trends.daily_profile(_flagged(spark, sf))


@query(
    "weekend_average",
    on_crashes(
        "SELECT (dayofweek(date) + 1)::INTEGER AS wday, strftime(date, '%a') AS wday_label, "
        "trickortreat, round(avg(total), 6) AS average FROM (SELECT date, trickortreat, "
        "count(*) AS total FROM flagged WHERE vulnerable_role = 'Pedestrian' "
        "AND dayofweek(date) IN (0, 6) GROUP BY ALL) GROUP BY ALL",
        _SPAN, _DAYS, _FLAGGED,
    ),
)
def weekend_average(spark, sf):
    return rounded(trends.weekend_average(_flagged(spark, sf)), "average")


@query(
    "weekly_profile",
    on_crashes(
        "SELECT d - ((dayofweek(d) + 4) % 7)::INTEGER AS weekdate, "
        "round(count(*) / max(hi - lo)::DOUBLE, 6) AS average "
        f"FROM (SELECT {_AGNOSTIC} AS d, hi, lo FROM crashes, span WHERE ped_age >= 18 "
        "AND vulnerable_role = 'Pedestrian' AND year <> hi) GROUP BY 1",
        _SPAN,
    ),
    dates=("weekdate",),
)
def weekly_profile(spark, sf):
    return rounded(trends.weekly_profile(crashes(spark, sf)), "average")


@query(
    "weekly_profile_city",
    on_crashes(
        "SELECT d - ((dayofweek(d) + 4) % 7)::INTEGER AS weekdate, "
        "round(count(*) / max(hi - lo + 1)::DOUBLE, 6) AS average "
        f"FROM (SELECT {_AGNOSTIC} AS d, hi, lo FROM crashes, span WHERE ped_age >= 18 "
        "AND vulnerable_role = 'Pedestrian' AND year <> hi AND MUNINAME = 'MACHINERY') GROUP BY 1",
        _SPAN,
    ),
    dates=("weekdate",),
)
def weekly_profile_city(spark, sf):
    out = trends.weekly_profile(crashes(spark, sf), "MACHINERY", count_open_year=True)
    return rounded(out, "average")


@query(
    "severity_share",
    on_crashes(
        "SELECT nonvuln_vehicletype, ped_inj_name, severity_rank, total, "
        "round(total / (sum(total) OVER (PARTITION BY nonvuln_vehicletype))::DOUBLE, 6) "
        "AS percent, round((sum(total) OVER (PARTITION BY nonvuln_vehicletype ORDER BY "
        "severity_rank NULLS LAST ROWS UNBOUNDED PRECEDING))::DOUBLE "
        "/ (sum(total) OVER (PARTITION BY nonvuln_vehicletype))::DOUBLE, 6) AS cumpercent "
        "FROM (SELECT nonvuln_vehicletype, ped_inj_name, severity_rank, count(*) AS total "
        "FROM crashes WHERE ped_age < 18 AND nonvuln_vehicletype <> 'Other' "
        "AND vulnerable_role = 'Pedestrian' GROUP BY ALL)"
    ),
)
def severity_share(spark, sf):
    return rounded(trends.severity_share(crashes(spark, sf)), "percent", "cumpercent")


@query(
    "caption",
    on_crashes(
        "SELECT min(year)::VARCHAR || ' - ' || max(year)::VARCHAR AS years, "
        "(SELECT strftime(max(retreive_date), '%m/%Y') FROM crashes WHERE year = "
        "(SELECT max(year) FROM crashes)) AS retrieved FROM crashes"
    ),
)
def caption(spark, sf):
    data = crashes(spark, sf)
    return trends.caption(data, retrieve_date(data))
