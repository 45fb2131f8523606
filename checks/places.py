"""Queries over schools, boxes, polygons, lines, hexes, densities and networks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.oracle import LAT, LON, on_crashes
from checks.surrogate import crashes, lat_of, lon_of, raw_crashes, table
from checks.tables import ORACLES as _ALL_TABLES
from checks.tables import (
    _INJURED,
    _MEAN,
    _POP,
    _RATES,
    _SEVERE_YEAR,
    _SPAN,
    _TOP,
    _WINDOW,
    ROW,
    ROW_COLS,
    population,
    registrar,
    rounded,
)
from kerbside.config import INJURY_CODES, NARROW_ROLES, SEVERE_CODES, RunConfig
from kerbside.functions import projection, text
from kerbside.functions.calendar import (
    month_label,
    week_floor,
    week_of_year,
    weekday_label,
    weekday_number,
    year_agnostic,
)
from kerbside.operators import (
    density,
    filters,
    hexes,
    layers,
    lookups,
    network,
    rates,
    reshape,
    schools,
    spatial,
    summaries,
)
from kerbside.operators.curate import curate
from kerbside.operators.lineage import shared_path
from kerbside.plans import county, maps
from kerbside.plans.runs import schools_of_run
from kerbside.sources import dims, exports, sinks, vector

QUERIES = {}
ORACLES = {}
query = registrar(QUERIES, ORACLES)


# ---- derived place tables -------------------------------------------------------------------

_TYPES = [
    "Elementary School", "Middle School", "Junior High School", "High School",
    "Combined Elementary/Secondary School", "Other/Alternative",
]


def school_table(spark, sf) -> DataFrame:
    """Suppliers as schools."""
    df = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    k = F.col("s_suppkey")
    n = F.col("n_nationkey") % 3
    return df.select(
        k.alias("school_id"),
        F.when(k % 19 != 0, k.cast("string")).alias("NCES_CODE"),
        F.concat(F.col("s_name"), F.when(k % 2 == 0, " School").otherwise("/Annex")).alias("SCHOOL"),
        F.when(n == 0, "Madison Metropolitan").when(n == 1, "Milwaukee")
        .otherwise(F.col("n_name")).alias("DISTRICT"),
        F.get(F.array(*[F.lit(t) for t in _TYPES]), (k % 6).cast("int")).alias("SCHOOLTYPE"),
        F.initcap("n_name").alias("COUNTY"),
        F.when(k % 11 == 0, "Yes").when(k % 13 != 0, "No").alias("VIRTUAL"),
        F.when(k % 17 != 0, lat_of(k)).alias("LAT"),
        lon_of(k).alias("LON"),
        F.col("s_nationkey").cast("string").alias("SDID"),
        k.cast("string").alias("SCH_CODE"),
    )


_TYPE_SQL = "CASE s_suppkey % 6 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)
) + " END"

SCHOOLS = f"""schools AS (
  SELECT s_suppkey AS school_id,
    CASE WHEN s_suppkey % 19 <> 0 THEN s_suppkey::VARCHAR END AS NCES_CODE,
    s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' School' ELSE '/Annex' END AS SCHOOL,
    CASE n_nationkey % 3 WHEN 0 THEN 'Madison Metropolitan' WHEN 1 THEN 'Milwaukee'
         ELSE n_name END AS DISTRICT,
    {_TYPE_SQL} AS SCHOOLTYPE,
    upper(n_name[1]) || lower(n_name[2:]) AS COUNTY,
    CASE WHEN s_suppkey % 11 = 0 THEN 'Yes' WHEN s_suppkey % 13 <> 0 THEN 'No' END AS VIRTUAL,
    CASE WHEN s_suppkey % 17 <> 0 THEN {LAT.format(k='s_suppkey')} END AS LAT,
    {LON.format(k='s_suppkey')} AS LON,
    s_nationkey::VARCHAR AS SDID, s_suppkey::VARCHAR AS SCH_CODE
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
valid AS (
  SELECT * FROM schools WHERE coalesce(VIRTUAL <> 'Yes', TRUE) AND LAT IS NOT NULL
    AND LON IS NOT NULL AND NCES_CODE IS NOT NULL
),
walked AS (
  SELECT *, coalesce(
      CASE WHEN SCHOOLTYPE = 'High School' THEN hs
           WHEN SCHOOLTYPE IN ('Junior High School', 'Middle School') THEN ms
           WHEN SCHOOLTYPE IN ('Combined Elementary/Secondary School', 'Elementary School')
           THEN es END, 2e0) AS walk_boundary_mi
  FROM valid LEFT JOIN (VALUES ('Madison Metropolitan', 1.5e0, 1.5e0, 1.5e0),
    ('Milwaukee', 2e0, 2e0, 1e0)) p(name, hs, ms, es) ON DISTRICT = name
),
named AS (
  SELECT *, walk_boundary_mi * 1609 AS walk_boundary_m,
    regexp_replace(SCHOOL, ' School$', '') || ' School' AS FULLNAME
  FROM walked
),
boxed AS (
  SELECT *, LON - (walk_boundary_m + 500) / 111320 / cos(radians(LAT)) AS "left",
    LAT - (walk_boundary_m + 500) / 111320 AS bottom,
    LON + (walk_boundary_m + 500) / 111320 / cos(radians(LAT)) AS "right",
    LAT + (walk_boundary_m + 500) / 111320 AS top,
    'school_maps/' || COUNTY || ' County/' || DISTRICT || ' School District/'
      || replace(SCHOOLTYPE, '/', '-') || 's/' || replace(FULLNAME, '/', '-') || '.pdf' AS path
  FROM named
)"""

ALL_SCHOOLS = RunConfig.from_dict({"county_focus": "ALL"})


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (*points, points[0])])


def tract_table(spark, sf) -> DataFrame:
    """A five-sided area with a square hole around every supplier."""
    k = F.col("s_suppkey")
    df = table(spark, sf, "supplier").select(
        k.cast("string").alias("GEOID"),
        ((k % 5) * 400).alias("value"),
        lon_of(k).alias("cx"),
        lat_of(k).alias("cy"),
        (F.lit(0.01) + (k % 7).cast("double") * 0.01).alias("s"),
    )
    cx, cy, s = F.col("cx"), F.col("cy"), F.col("s")
    outer = _ring(
        (cx - s, cy - s), (cx + s, cy - s), (cx + s, cy + s / 2), (cx, cy + s), (cx - s, cy + s / 2)
    )
    h = s / 4
    inner = _ring((cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h))
    return df.select("GEOID", "value", F.array(outer, inner).alias("rings"))


def _sides_sql() -> str:
    outer = [("cx - s", "cy - s"), ("cx + s", "cy - s"), ("cx + s", "cy + s / 2"),
             ("cx", "cy + s"), ("cx - s", "cy + s / 2")]
    inner = [("cx - s / 4", "cy - s / 4"), ("cx + s / 4", "cy - s / 4"),
             ("cx + s / 4", "cy + s / 4"), ("cx - s / 4", "cy + s / 4")]
    parts = []
    for number, ring in enumerate((outer, inner)):
        for a, b in zip(ring, ring[1:] + ring[:1]):
            parts.append(
                f"SELECT GEOID, value, {number} AS ring, {a[0]} AS x1, {a[1]} AS y1, "
                f"{b[0]} AS x2, {b[1]} AS y2 FROM tract"
            )
    return " UNION ALL ".join(parts)


TRACTS = f"""tract AS (
  SELECT s_suppkey::VARCHAR AS GEOID, (s_suppkey % 5) * 400 AS value,
    {LON.format(k='s_suppkey')} AS cx, {LAT.format(k='s_suppkey')} AS cy,
    0.01e0 + (s_suppkey % 7)::DOUBLE * 0.01e0 AS s
  FROM supplier
),
sides AS ({_sides_sql()}),
numbered AS (
  SELECT row_number() OVER () AS id, * FROM crashes WHERE latitude IS NOT NULL
),
inside AS (
  SELECT p.id, p.row_order, p.row_line, p.row_part, p.ped_inj, p.year, p.vulnerable_role,
    p.ped_inj_name, e.GEOID
  FROM numbered p
  JOIN tract t ON longitude BETWEEN cx - s AND cx + s AND latitude BETWEEN cy - s AND cy + s
  JOIN sides e ON e.GEOID = t.GEOID AND (e.y1 > latitude) <> (e.y2 > latitude)
    AND longitude < e.x1 + (e.x2 - e.x1) * (latitude - e.y1) / (e.y2 - e.y1)
  GROUP BY ALL HAVING count(*) % 2 = 1
)"""


def line_table(spark, sf) -> DataFrame:
    """A bent line of two pieces per customer, with its county."""
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    x, y = lon_of(k), lat_of(k)
    x1, y1 = x + (k % 5).cast("double") * 0.01, y + F.lit(0.008)
    x2, y2 = x1 + F.lit(0.02), y1 - (k % 3).cast("double") * 0.01
    point = [F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x1, y1), (x2, y2))]
    return df.select(
        k.alias("line_id"),
        F.lower("n_name").alias("county_file"),
        (k % 4 + 1).alias("lts"),
        F.array(*point).alias("path"),
    )


LINES = f"""line AS (
  SELECT c_custkey AS line_id, lower(n_name) AS county_file, c_custkey % 4 + 1 AS lts,
    {LON.format(k='c_custkey')} AS ax, {LAT.format(k='c_custkey')} AS ay,
    {LON.format(k='c_custkey')} + (c_custkey % 5)::DOUBLE * 0.01e0 AS bx,
    {LAT.format(k='c_custkey')} + 0.008e0 AS "by"
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
seg AS (
  SELECT line_id, county_file, lts, ax AS x1, ay AS y1, bx AS x2, "by" AS y2 FROM line
  UNION ALL
  SELECT line_id, county_file, lts, bx, "by", bx + 0.02e0,
    "by" - (line_id % 3)::DOUBLE * 0.01e0 FROM line
)"""


# ---- filters ----------------------------------------------------------------------------------

BOX = filters.Box(-87.967, 42.9, -87.8, 43.051)
_BOX_SQL = "longitude BETWEEN -87.967e0 AND -87.8e0 AND latitude BETWEEN 42.9e0 AND 43.051e0"
_IDS = f"SELECT {ROW} FROM crashes WHERE "


def _ids(df: DataFrame) -> DataFrame:
    return df.select(*ROW_COLS)


@query("with_coordinates", on_crashes(_IDS + "latitude IS NOT NULL AND longitude IS NOT NULL"))
def with_coordinates(spark, sf):
    return _ids(filters.with_coordinates(crashes(spark, sf)))


@query(
    "youth",
    on_crashes(
        _IDS + "(coalesce(ROLE1 IN ('BIKE', 'PED'), FALSE) AND age1 < 18) "
        "OR (coalesce(ROLE2 IN ('BIKE', 'PED'), FALSE) AND age2 < 18)"
    ),
)
def youth(spark, sf):
    return _ids(filters.youth(crashes(spark, sf), NARROW_ROLES))


@query("severity_in", on_crashes(_IDS + _INJURED))
def severity_in(spark, sf):
    return _ids(filters.severity_in(crashes(spark, sf), INJURY_CODES))


@query(
    "severe_vulnerable",
    on_crashes(
        _IDS + "(ROLE1 IN ('BIKE', 'PED') AND INJSVR1 IN ('A', 'K')) "
        "OR (ROLE2 IN ('BIKE', 'PED') AND INJSVR2 IN ('A', 'K'))"
    ),
)
def severe_vulnerable(spark, sf):
    return _ids(filters.severe_vulnerable(crashes(spark, sf)))


@query("in_box", on_crashes(_IDS + _BOX_SQL))
def in_box(spark, sf):
    return _ids(filters.in_box(crashes(spark, sf), BOX))


@query(
    "point_layer",
    on_crashes(
        f"SELECT {ROW}, ped_inj_name, severity_rank FROM crashes WHERE year = 1999 "
        f"AND vulnerable_role = 'Pedestrian' AND {_BOX_SQL}"
    ),
)
def point_layer(spark, sf):
    found = filters.point_layer(crashes(spark, sf), BOX, year=1999)
    return filters.by_severity(found).select(*ROW_COLS, "ped_inj_name", "severity_rank")


@query(
    "box_compare",
    on_crashes(
        "SELECT count(*) FILTER (WHERE date > date_max - 365) AS lastyear, "
        "round(count(*) FILTER (WHERE date > date_max - (365 * (prior + 1))::INTEGER) "
        "/ max(prior + 1)::DOUBLE, 6) AS yearly_mean FROM crashes, win "
        f"WHERE {_BOX_SQL} AND ped_inj IN ('K', 'A') AND vulnerable_role = 'Pedestrian'",
        _SPAN, _WINDOW,
    ),
)
def box_compare(spark, sf):
    out = hexes.box_compare(crashes(spark, sf), filters.box_condition(BOX), SEVERE_CODES)
    return rounded(out, "yearly_mean")


@query(
    "calendar_columns",
    on_crashes(
        "SELECT DISTINCT date, strftime(date, '%b') AS month_label, "
        "try_cast('2025-' || strftime(date, '%m-%d') AS DATE) AS agnostic, "
        "((dayofyear(date) - 1) // 7 + 1)::INTEGER AS week, "
        "date - ((dayofweek(date) + 4) % 7)::INTEGER AS wednesday, "
        "(dayofweek(date) + 1)::INTEGER AS wday, strftime(date, '%a') AS wday_label, "
        "day(date)::INTEGER AS mday FROM crashes"
    ),
    dates=("date", "agnostic", "wednesday",),
)
def calendar_columns(spark, sf):
    return crashes(spark, sf).select(
        "date",
        month_label("date").alias("month_label"),
        year_agnostic("date").alias("agnostic"),
        week_of_year("date").alias("week"),
        week_floor("date", "WED").alias("wednesday"),
        weekday_number("date").alias("wday"),
        weekday_label("date").alias("wday_label"),
        F.dayofmonth("date").alias("mday"),
    ).distinct()


def published_table(spark, sf) -> DataFrame:
    """Orders per year and priority with total rows, like a published table of deaths."""
    counted = (
        table(spark, sf, "orders")
        .groupBy(F.year("o_orderdate").alias("year_code"), F.col("o_orderpriority").alias("cause"))
        .agg(F.count(F.lit(1)).alias("deaths"))
    )
    return counted.rollup("year_code", "cause").agg(F.sum("deaths").alias("deaths")).select(
        F.coalesce(F.col("year_code").cast("string"), F.lit("Total")).alias("year"),
        "year_code",
        F.coalesce("cause", F.lit("Total")).alias("cause"),
        "deaths",
    )


@query(
    "drop_totals",
    "WITH counted AS (SELECT year(o_orderdate)::INTEGER AS year_code, o_orderpriority AS cause, "
    "count(*) AS deaths FROM orders GROUP BY ALL) "
    "SELECT year_code::VARCHAR AS year, year_code, cause, deaths FROM counted",
)
def drop_totals(spark, sf):
    return filters.drop_totals(published_table(spark, sf), "year", "cause")


@query(
    "latest_of_published",
    "SELECT o_orderpriority AS cause, count(*) AS deaths FROM orders "
    "WHERE year(o_orderdate) = 2000 GROUP BY ALL",
)
def latest_of_published(spark, sf):
    rows = filters.of_year(published_table(spark, sf), 2000, "year")
    return filters.drop_totals(rows, "cause").select("cause", "deaths")


@query(
    "wrap_text",
    "SELECT DISTINCT rtrim(regexp_replace(t, '(.{1,30})( |$)', '\\1' || chr(10), 'g'), chr(10)) "
    "AS label FROM (SELECT p_name || ' ' || p_type || ' ' || p_brand || ' causes in ' || "
    "o_orderpriority AS t FROM lineitem JOIN part ON l_partkey = p_partkey "
    "JOIN orders ON l_orderkey = o_orderkey)",
)
def wrap_text(spark, sf):
    line = table(spark, sf, "lineitem")
    df = line.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    cause = F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("causes in"), "o_orderpriority")
    return df.select(text.wrap_text(cause, 30).alias("label")).distinct()


# ---- schools ------------------------------------------------------------------------------------


def with_schools(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SCHOOLS, *ctes]) + "\n" + sql


@query("valid_schools", with_schools("SELECT school_id, NCES_CODE FROM valid"))
def valid_schools(spark, sf):
    return filters.valid_schools(school_table(spark, sf)).select("school_id", "NCES_CODE")


@query("placed_schools", with_schools("SELECT school_id FROM schools WHERE LAT > 0"))
def placed_schools(spark, sf):
    return filters.placed_schools(school_table(spark, sf)).select("school_id")


_FOCUS = {
    "county_focus": ["NATION_3", "nation_4", "Nation_12", "NATION_15"],
    "school_type_focus": ["high school", "Elementary School"],
    "district_focus": "All",
}


@query(
    "focus",
    with_schools(
        "SELECT school_id, COUNTY, DISTRICT, SCHOOLTYPE FROM schools "
        "WHERE upper(COUNTY) IN ('NATION_3', 'NATION_4', 'NATION_12', 'NATION_15') "
        "AND upper(SCHOOLTYPE) IN ('HIGH SCHOOL', 'ELEMENTARY SCHOOL')"
    ),
)
def focus(spark, sf):
    found = filters.focus(school_table(spark, sf), RunConfig.from_dict(_FOCUS))
    return found.select("school_id", "COUNTY", "DISTRICT", "SCHOOLTYPE")


@query(
    "walk_boundary",
    with_schools("SELECT school_id, walk_boundary_mi, round(walk_boundary_m, 6) AS walk_boundary_m FROM named"),
)
def walk_boundary(spark, sf):
    found = schools.walk_boundary(filters.valid_schools(school_table(spark, sf)))
    return rounded(found.select("school_id", "walk_boundary_mi", "walk_boundary_m"), "walk_boundary_m")


@query(
    "school_run",
    with_schools(
        "SELECT school_id, FULLNAME AS SCHOOL, path, round(\"left\", 6) AS \"left\", "
        "round(bottom, 6) AS bottom, round(\"right\", 6) AS \"right\", round(top, 6) AS top "
        "FROM boxed"
    ),
)
def school_run(spark, sf):
    found = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    return rounded(
        found.select("school_id", "SCHOOL", "path", "left", "bottom", "right", "top"),
        "left", "bottom", "right", "top",
    )


_NEAR = (
    "near AS (SELECT b.NCES_CODE, b.COUNTY, c.row_order, c.row_line, c.row_part, c.ped_inj_name "
    "FROM boxed b JOIN crashes c ON longitude BETWEEN \"left\" AND \"right\" "
    "AND latitude BETWEEN bottom AND top "
    "WHERE (coalesce(ROLE1 IN ('BIKE', 'PED'), FALSE) AND age1 < 18) "
    "OR (coalesce(ROLE2 IN ('BIKE', 'PED'), FALSE) AND age2 < 18))"
)


@query(
    "points_in_boxes",
    on_crashes(
        f"SELECT NCES_CODE, {ROW} FROM boxed b JOIN crashes c "
        "ON longitude BETWEEN \"left\" AND \"right\" AND latitude BETWEEN bottom AND top",
        SCHOOLS,
    ),
)
def points_in_boxes(spark, sf):
    boxes = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    found = spatial.points_in_boxes(
        boxes.select("NCES_CODE", "left", "bottom", "right", "top"),
        crashes(spark, sf).select(*ROW_COLS, "longitude", "latitude"),
    )
    return found.select("NCES_CODE", *ROW_COLS)


@query("school_crashes", on_crashes(f"SELECT NCES_CODE, COUNTY, {ROW}, ped_inj_name FROM near", SCHOOLS, _NEAR))
def school_crashes(spark, sf):
    boxes = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    near = schools.school_crashes(boxes, crashes(spark, sf))
    return near.select("NCES_CODE", "COUNTY", *ROW_COLS, "ped_inj_name")


@query(
    "school_crash_counts",
    on_crashes(
        "SELECT NCES_CODE, ped_inj_name, count(*) AS count FROM near GROUP BY ALL",
        SCHOOLS, _NEAR,
    ),
)
def school_crash_counts(spark, sf):
    boxes = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    return schools.school_crash_counts(boxes, crashes(spark, sf))


@query("school_count", with_schools("SELECT count(DISTINCT NCES_CODE) AS n FROM valid"))
def school_count(spark, sf):
    return lookups.distinct_count(filters.valid_schools(school_table(spark, sf)), "NCES_CODE")


_LISTED = "listed AS (SELECT path FROM boxed WHERE school_id % 3 <> 0)"


def _outputs(spark, sf) -> DataFrame:
    """A listing of files: an output is written for two of three schools, at its path, and then looked for."""
    made = schools_of_run(school_table(spark, sf).where("school_id % 3 <> 0"), ALL_SCHOOLS)
    out = shared_path(spark, "school-maps")
    sinks.write_files(made, out, "path", "NCES_CODE")
    return exports.file_listing(spark, out, "*.pdf").select("path")


@query(
    "manifest",
    with_schools(
        "SELECT NCES_CODE, path, path IN (SELECT path FROM listed) AS \"exists\" FROM boxed", _LISTED
    ),
)
def manifest(spark, sf):
    expected = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    return schools.manifest(expected, _outputs(spark, sf)).select("NCES_CODE", "path", "exists")


@query(
    "districts_not_done",
    with_schools(
        "SELECT DISTINCT DISTRICT AS districts FROM boxed WHERE path NOT IN (SELECT path FROM listed)",
        _LISTED,
    ),
)
def districts_not_done(spark, sf):
    expected = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    return schools.districts_not_done(schools.manifest(expected, _outputs(spark, sf)))


def enrollment_table(spark, sf) -> DataFrame:
    """Share of return flags and line states per supplier and line number."""
    line = table(spark, sf, "lineitem").join(
        table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    groups = F.array(
        F.struct(F.lit("Return Flag").alias("g"), F.col("l_returnflag").alias("v")),
        F.struct(F.lit("Line Status").alias("g"), F.col("l_linestatus").alias("v")),
    )
    counts = (
        line.select("s_nationkey", "s_suppkey", "s_name", "l_linenumber", F.explode(groups).alias("e"))
        .groupBy("s_nationkey", "s_suppkey", "s_name", "l_linenumber", "e.g", "e.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        F.col("s_nationkey").cast("string").alias("DISTRICT_CODE"),
        F.col("s_suppkey").cast("string").alias("SCHOOL_CODE"),
        F.col("l_linenumber").cast("string").alias("GRADE_LEVEL"),
        F.col("s_name").alias("SCHOOL_NAME"),
        F.lit("District").alias("DISTRICT_NAME"),
        F.when(F.col("l_linenumber") <= 3, "Elementary School").otherwise("High School")
        .alias("GRADE_GROUP"),
        F.lit("No").alias("CHARTER_IND"),
        F.col("g").alias("GROUP_BY"),
        F.col("v").alias("GROUP_BY_VALUE"),
        (F.col("n").cast("double") / 100).alias("PERCENT_OF_GROUP"),
    )


_VARIABLES = ["Line_Status__F", "Line_Status__O", "Return_Flag__A", "Return_Flag__N", "Return_Flag__R"]
_ENROLLMENT = (
    "wide AS (SELECT s_nationkey::VARCHAR || s_suppkey::VARCHAR AS district_school, "
    "l_linenumber::VARCHAR AS GRADE_LEVEL, s_name AS SCHOOL_NAME, CASE WHEN l_linenumber <= 3 "
    "THEN 'Elementary School' ELSE 'High School' END AS GRADE_GROUP, "
    + ", ".join(
        f"nullif(count(*) FILTER (WHERE {c} = '{v}'), 0) / 100e0 AS {n}"
        for n, c, v in (
            ("Line_Status__F", "l_linestatus", "F"), ("Line_Status__O", "l_linestatus", "O"),
            ("Return_Flag__A", "l_returnflag", "A"), ("Return_Flag__N", "l_returnflag", "N"),
            ("Return_Flag__R", "l_returnflag", "R"),
        )
    )
    + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), "
    "profile AS (SELECT district_school, SCHOOL_NAME, GRADE_GROUP, "
    + ", ".join(f"avg({v}) AS {v}" for v in _VARIABLES)
    + " FROM wide GROUP BY ALL)"
)
_ROUNDED_VARIABLES = ", ".join(f"round({v}, 6) AS {v}" for v in _VARIABLES)


@query(
    "enrollment_wide",
    f"WITH {_ENROLLMENT} SELECT district_school, GRADE_LEVEL, GRADE_GROUP, {_ROUNDED_VARIABLES} FROM wide",
)
def enrollment_wide(spark, sf):
    wide = schools.enrollment_wide(enrollment_table(spark, sf), _VARIABLES)
    return rounded(
        wide.select("district_school", "GRADE_LEVEL", "GRADE_GROUP", *_VARIABLES), *_VARIABLES
    )


@query(
    "with_enrollment",
    with_schools(
        f"SELECT school_id, GRADE_GROUP, {_ROUNDED_VARIABLES} FROM valid "
        "LEFT JOIN profile ON SDID || SCH_CODE = district_school",
        _ENROLLMENT,
    ),
)
def with_enrollment(spark, sf):
    wide = schools.enrollment_wide(enrollment_table(spark, sf), _VARIABLES)
    profile = schools.enrollment_profile(wide, _VARIABLES)
    out = schools.with_enrollment(filters.valid_schools(school_table(spark, sf)), profile)
    return rounded(out.select("school_id", "GRADE_GROUP", *_VARIABLES), *_VARIABLES)


# ---- layers -----------------------------------------------------------------------------------


def _age_text(age: str) -> str:
    return f"{age}::BIGINT::VARCHAR"


_SEVERITY_ES = (
    "CASE ped_inj_name " + " ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in dims.SEVERITY) + " END"
)
_COLOUR = (
    "CASE ped_inj_name " + " ".join(f"WHEN '{r[0]}' THEN '{r[3]}'" for r in dims.SEVERITY) + " END"
)


@query(
    "point_labels_en",
    on_crashes(
        "SELECT CNTYNAME AS County, ONSTR AS Street, ATSTR AS CrossStreet, "
        f"{_COLOUR} AS color, "
        "'<b>' || coalesce(vulnerable_role, '') || ' </b><br>' || CRSHDATE || '</br>' || "
        "coalesce(ped_inj_name, 'NA') || '</br>' || coalesce(vulnerable_role, '') || ' age: ' || "
        f"coalesce({_age_text('ped_age')}, 'unknown age') AS label FROM crashes"
    ),
)
def point_labels_en(spark, sf):
    points = layers.point_labels(layers.map_columns(crashes(spark, sf)))
    return points.select("County", "Street", "CrossStreet", "color", "label")


@query(
    "point_labels_es",
    on_crashes(
        "SELECT CNTYNAME AS County, CRSHTIME AS CrashTime, "
        "'<b>' || coalesce(vulnerable_role_es, '') || ' </b><br>' || CRSHDATE || '</br>' || "
        f"coalesce({_SEVERITY_ES}, 'NA') || '</br>edad de ' || "
        "coalesce(vulnerable_role_es, '') || ': ' || "
        f"coalesce({_age_text('ped_age')}, 'edad desconocida') AS label FROM crashes"
    ),
)
def point_labels_es(spark, sf):
    points = layers.point_labels(layers.map_columns(crashes(spark, sf)), "es")
    return points.select("County", "CrashTime", "label")


def _county_label_sql(start: str, end: str, pop: str, mean: str, per: str) -> str:
    thousands = "regexp_replace(value::VARCHAR, '(\\d)(\\d{3})$', '\\1,\\2')"
    thousands = f"CASE WHEN value >= 1000000 THEN NULL ELSE {thousands} END"
    return on_crashes(
        f"SELECT County, '{start}' || upper(County[1]) || lower(County[2:]) || '{end}{pop}' || "
        f"{thousands} || '<br>{mean}' || coalesce(round_even(MeanCrashes, 0)::BIGINT::VARCHAR, "
        f"'NA') || '</br>{per}' || round_even(CrashesPerPopulation, 0)::BIGINT::VARCHAR AS label "
        "FROM rate",
        _POP, _MEAN, _RATES,
    )


def _labelled_counties(spark, sf, lang: str) -> DataFrame:
    out = rates.county_rates(rates.county_mean(crashes(spark, sf)), population(spark, sf))
    return layers.county_labels(out, lang).select("County", "label")


@query(
    "county_labels_en",
    _county_label_sql(
        "<b>", " County</b></br>", "population: ", "average crashes per year: ",
        "average crashes/year per 100k residents: ",
    ),
)
def county_labels_en(spark, sf):
    return _labelled_counties(spark, sf, "en")


@query(
    "county_labels_es",
    _county_label_sql(
        "<b>Condado de ", "</b></br>", "población: ", "choques promedio por año: ",
        "choques promedio/año por cada 100.000 habitantes: ",
    ),
)
def county_labels_es(spark, sf):
    return _labelled_counties(spark, sf, "es")


_TYPE_ES = "CASE SCHOOLTYPE " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.SCHOOL_TYPE) + " END"


@query(
    "school_labels",
    with_schools(
        f"SELECT school_id, {_TYPE_ES} AS SCHOOLTYPE_es, '<b>Escuela ' || SCHOOL || "
        "'</b></br>Distrito Escolar ' || DISTRICT || '</br>' || "
        f"coalesce({_TYPE_ES}, 'NA') AS label FROM schools"
    ),
)
def school_labels(spark, sf):
    return layers.school_labels(school_table(spark, sf), "es").select(
        "school_id", "SCHOOLTYPE_es", "label"
    )


@query(
    "translate_school_type",
    with_schools(f"SELECT school_id, SCHOOLTYPE, {_TYPE_ES} AS SCHOOLTYPE_es FROM schools"),
)
def translate_school_type(spark, sf):
    dim = dims.school_type_dim(spark)
    out = lookups.translate(school_table(spark, sf), dim, "SCHOOLTYPE", "SCHOOLTYPE_es")
    return out.select("school_id", "SCHOOLTYPE", "SCHOOLTYPE_es")


@query(
    "lts_colors",
    f"WITH {LINES} SELECT line_id, CASE lts WHEN 1 THEN '#1a9641' WHEN 2 THEN '#a6d96a' "
    "WHEN 3 THEN '#fdae61' ELSE '#d7191c' END AS color FROM line",
)
def lts_colors(spark, sf):
    lines = line_table(spark, sf).withColumn("lts", F.col("lts").cast("int"))
    out = lookups.translate(lines, dims.lts_dim(spark), "lts", "color", key="code", value="color")
    return out.select("line_id", "color")


@query(
    "geojson_points",
    on_crashes(
        "SELECT '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || "
        "longitude::VARCHAR || ',' || latitude::VARCHAR || ']},\"properties\":{\"DOCTNMBR\":\"' || "
        "DOCTNMBR || '\",\"age2\":' || age2::VARCHAR || '}}' AS value FROM crashes WHERE latitude IS NOT NULL"
    ),
)
def geojson_points(spark, sf):
    points = filters.with_coordinates(crashes(spark, sf))
    return sinks.geojson_points(points.select("DOCTNMBR", "age2", "longitude", "latitude"))


# ---- polygons, lines, boxes -------------------------------------------------------------------------


@query("points_in_polygons", on_crashes(f"SELECT GEOID, {ROW} FROM inside", TRACTS))
def points_in_polygons(spark, sf):
    points = crashes(spark, sf).select(*ROW_COLS, "longitude", "latitude")
    found = spatial.points_in_polygons(tract_table(spark, sf), points, "GEOID")
    return found.select("GEOID", *ROW_COLS)


@query(
    "points_in_polygons_left",
    on_crashes(
        "SELECT t.GEOID, i.row_order, i.row_line, i.row_part FROM (SELECT GEOID FROM tract UNION ALL "
        "SELECT 'empty ' || GEOID FROM tract WHERE value = 0) t LEFT JOIN inside i ON t.GEOID = i.GEOID",
        TRACTS,
    ),
)
def points_in_polygons_left(spark, sf):
    tracts = tract_table(spark, sf)
    away = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 40).alias("x"), p["y"].alias("y"))))
    empty = tracts.where("value = 0").withColumns({"GEOID": F.concat(F.lit("empty "), "GEOID"), "rings": away})
    found = spatial.points_in_polygons(
        tracts.union(empty), crashes(spark, sf).select(*ROW_COLS, "longitude", "latitude"), "GEOID", how="left"
    )
    return found.select("GEOID", *ROW_COLS)


@query(
    "tract_rates",
    on_crashes(
        "SELECT GEOID, value, n AS crash_count, round(n / (value / 100000e0), 6) "
        "AS CrashesPerPopulation FROM (SELECT t.GEOID, t.value, count(i.id) AS n FROM tract t "
        "LEFT JOIN (SELECT * FROM inside WHERE ped_inj_name IN ('Suspected Minor Injury', "
        "'Suspected Serious Injury', 'Fatality')) i ON t.GEOID = i.GEOID GROUP BY ALL) "
        "WHERE value > 0",
        TRACTS,
    ),
)
def tract_rates(spark, sf):
    out = rates.area_rates(tract_table(spark, sf), crashes(spark, sf))
    return rounded(out.select("GEOID", "value", "crash_count", "CrashesPerPopulation"), "CrashesPerPopulation")


@query("place_rates", ORACLES["tract_rates"].replace("WHERE value > 0", "WHERE value > 500"))
def place_rates(spark, sf):
    out = rates.area_rates(tract_table(spark, sf), crashes(spark, sf), min_population=500)
    return rounded(out.select("GEOID", "value", "crash_count", "CrashesPerPopulation"), "CrashesPerPopulation")


@query(
    "polygon_box",
    f"WITH {TRACTS.split('sides AS (')[0].rstrip().rstrip(',')} SELECT GEOID, "
    "round(cx - s - 1000 / 111320e0 / cos(radians(cy + s)), 6) AS \"left\", "
    "round(cy - s - 1000 / 111320e0, 6) AS bottom, "
    "round(cx + s + 1000 / 111320e0 / cos(radians(cy + s)), 6) AS \"right\", "
    "round(cy + s + 1000 / 111320e0, 6) AS top FROM tract",
)
def polygon_box(spark, sf):
    out = spatial.polygon_box(tract_table(spark, sf), 1000)
    return rounded(out.select("GEOID", *spatial.BOX), *spatial.BOX)


@query(
    "extent_by_city",
    on_crashes(
        "SELECT MUNINAME, round(min(longitude), 6) AS \"left\", round(min(latitude), 6) AS bottom, "
        "round(max(longitude), 6) AS \"right\", round(max(latitude), 6) AS top "
        "FROM crashes GROUP BY MUNINAME"
    ),
)
def extent_by_city(spark, sf):
    return rounded(spatial.extent(crashes(spark, sf), ("MUNINAME",)), *spatial.BOX)


_CITY = (
    "city AS (SELECT MUNINAME AS city, min(longitude) AS l, min(latitude) AS b, "
    "max(longitude) AS r, max(latitude) AS t FROM crashes GROUP BY MUNINAME)"
)


@query(
    "city_maps",
    on_crashes(
        f"SELECT city, {ROW}, ped_inj_name FROM city JOIN crashes ON longitude BETWEEN l AND r "
        "AND latitude BETWEEN b AND t WHERE year = 1999 "
        "AND ((ROLE1 IN ('BIKE', 'PED') AND INJSVR1 IN ('A', 'K')) "
        "OR (ROLE2 IN ('BIKE', 'PED') AND INJSVR2 IN ('A', 'K')))",
        _CITY,
    ),
)
def city_maps(spark, sf):
    out = maps.city_maps(crashes(spark, sf), year=1999)
    return out.select("city", *ROW_COLS, "ped_inj_name")


@query(
    "municipality_maps",
    on_crashes(
        f"SELECT GEOID, {ROW}, ped_inj_name FROM tract JOIN crashes "
        "ON longitude BETWEEN cx - s - 1000 / 111320e0 / cos(radians(cy + s)) "
        "AND cx + s + 1000 / 111320e0 / cos(radians(cy + s)) "
        "AND latitude BETWEEN cy - s - 1000 / 111320e0 AND cy + s + 1000 / 111320e0 "
        "WHERE ROLE1 IN ('BIKE', 'PED') OR ROLE2 IN ('BIKE', 'PED')",
        TRACTS.split("sides AS (")[0].rstrip().rstrip(","),
    ),
)
def municipality_maps(spark, sf):
    out = maps.municipality_maps(tract_table(spark, sf), crashes(spark, sf))
    return out.select("GEOID", *ROW_COLS, "ped_inj_name")


_CLIP = (
    "d AS (SELECT line_id, county_file, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, NCES_CODE, COUNTY, "
    "\"left\" AS l, bottom AS b, \"right\" AS r, top AS t FROM seg, boxed), "
    "t AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((l - x1) / dx, (r - x1) / dx) "
    "END, CASE WHEN dy = 0 THEN 0 ELSE least((b - y1) / dy, (t - y1) / dy) END) AS t0, "
    "least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((l - x1) / dx, (r - x1) / dx) END, "
    "CASE WHEN dy = 0 THEN 1 ELSE greatest((b - y1) / dy, (t - y1) / dy) END) AS t1 FROM d "
    "WHERE NOT (dx = 0 AND (x1 < l OR x1 > r)) AND NOT (dy = 0 AND (y1 < b OR y1 > t)))"
)
_CLIPPED = (
    "line_id, NCES_CODE, round(x1 + t0 * dx, 6) AS cx1, round(y1 + t0 * dy, 6) AS cy1, "
    "round(x1 + t1 * dx, 6) AS cx2, round(y1 + t1 * dy, 6) AS cy2"
)
_CLIP_COLS = ["cx1", "cy1", "cx2", "cy2"]


@query("clip_lines", with_schools(f"SELECT {_CLIPPED} FROM t WHERE t0 <= t1", LINES, _CLIP))
def clip_lines(spark, sf):
    boxes = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    segs = spatial.segments_of(line_table(spark, sf))
    out = spatial.clip_lines(segs, boxes.select("NCES_CODE", *spatial.BOX))
    return rounded(out.select("line_id", "NCES_CODE", *_CLIP_COLS), *_CLIP_COLS)


@query(
    "school_lines",
    with_schools(
        f"SELECT {_CLIPPED} FROM t WHERE t0 <= t1 AND lower(COUNTY) = county_file", LINES, _CLIP
    ),
)
def school_lines(spark, sf):
    boxes = schools_of_run(school_table(spark, sf), ALL_SCHOOLS)
    segs = spatial.segments_of(line_table(spark, sf))
    out = schools.school_lines(boxes.select("NCES_CODE", "COUNTY", *spatial.BOX), segs)
    return rounded(out.select("line_id", "NCES_CODE", *_CLIP_COLS), *_CLIP_COLS)


@query(
    "fill_holes",
    f"WITH {TRACTS.split('sides AS (')[0].rstrip().rstrip(',')} SELECT GEOID, CASE WHEN "
    "(s / 2 * 111320) * (s / 2 * 111320 * cos(radians(cy))) > 1e6 THEN 2 ELSE 1 END AS n_rings "
    "FROM tract",
)
def fill_holes(spark, sf):
    out = spatial.fill_holes(tract_table(spark, sf), 1.0)
    return spatial.non_empty(out).select("GEOID", F.size("rings").alias("n_rings"))


# ---- projection and hexes ------------------------------------------------------------------------------


def _series(coefs, outer: str, inner: str, sign: str = "+") -> str:
    return "".join(
        f" {sign} ({c!r}) * {outer}({2 * j} * xi) * {inner}({2 * j} * eta)"
        for j, c in enumerate(coefs, start=1)
    )


def utm_ctes(source: str, lon: str, lat: str, out: str) -> str:
    """``out``: the rows of ``source`` with ``x`` and ``y`` in metres."""
    e, k = projection._E, projection.SCALE * projection._A
    s = f"sin(radians({lat}))"
    return (
        f"{out}_1 AS (SELECT *, sinh(atanh({s}) - {e!r} * atanh({e!r} * {s})) AS t_, "
        f"radians({lon} + 87) AS dl_ FROM {source}), "
        f"{out}_2 AS (SELECT *, atan2(t_, cos(dl_)) AS xi, "
        f"atanh(sin(dl_) / sqrt(1 + t_ * t_)) AS eta FROM {out}_1), "
        f"{out} AS (SELECT *, 500000e0 + {k!r} * (eta{_series(projection._ALPHA, 'cos', 'sinh')}) "
        f"AS x, {k!r} * (xi{_series(projection._ALPHA, 'sin', 'cosh')}) AS y FROM {out}_2)"
    )


def hex_ctes(source: str, cell_m: float, out: str) -> str:
    """``out``: the rows of ``source`` (with ``x, y``) with ``q`` and ``r``."""
    radius = cell_m / math.sqrt(3)
    return (
        f"{out}_1 AS (SELECT *, (x * {math.sqrt(3) / 3!r} - y / 3) / {radius!r} AS qf, "
        f"y * 2 / 3 / {radius!r} AS rf FROM {source}), "
        f"{out}_2 AS (SELECT *, floor(qf + 0.5) AS rq, floor(rf + 0.5) AS rr, "
        f"floor(-qf - rf + 0.5) AS rs FROM {out}_1), "
        f"{out}_3 AS (SELECT *, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs + qf + rf) AS ds "
        f"FROM {out}_2), "
        f"{out} AS (SELECT *, (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT "
        f"AS q, (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END)"
        f"::BIGINT AS r FROM {out}_3)"
    )


_LOCATED = "located AS (SELECT * FROM crashes WHERE latitude IS NOT NULL)"


@query(
    "to_utm",
    on_crashes(
        f"SELECT {ROW}, round(x, 2) AS x, round(y, 2) AS y FROM utm",
        _LOCATED, utm_ctes("located", "longitude", "latitude", "utm"),
    ),
)
def to_utm(spark, sf):
    located = filters.with_coordinates(crashes(spark, sf)).select(*ROW_COLS, "longitude", "latitude")
    return rounded(projection.with_utm(located).select(*ROW_COLS, "x", "y"), "x", "y", digits=2)


@query(
    "utm_round_trip",
    on_crashes(
        f"SELECT {ROW}, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM located",
        _LOCATED,
    ),
)
def utm_round_trip(spark, sf):
    located = filters.with_coordinates(crashes(spark, sf)).select(*ROW_COLS, "longitude", "latitude")
    back = projection.with_lonlat(projection.with_utm(located), out=("longitude", "latitude"))
    return rounded(back.select(*ROW_COLS, "longitude", "latitude"), "longitude", "latitude")


_HEX_500 = (
    utm_ctes("located", "longitude", "latitude", "utm") + ", " + hex_ctes("utm", 500, "hexed")
)
_HEX_3000 = (
    utm_ctes("located", "longitude", "latitude", "utm") + ", " + hex_ctes("utm", 3000, "hexed")
)


@query("hex_cell", on_crashes(f"SELECT {ROW}, q, r FROM hexed", _LOCATED, _HEX_500))
def hex_cell(spark, sf):
    located = filters.with_coordinates(crashes(spark, sf)).select(*ROW_COLS, "longitude", "latitude")
    return hexes.with_hex(located, 500).select(*ROW_COLS, "q", "r")


_CENTRE = (
    "round((q + r / 2e0) * {w!r}, 2) AS x, round(r * {h!r}::DOUBLE, 2) AS y"
).format(w=500 / math.sqrt(3) * math.sqrt(3), h=1.5 * 500 / math.sqrt(3))


@query(
    "hex_center",
    on_crashes(f"SELECT DISTINCT q, r, {_CENTRE} FROM hexed", _LOCATED, _HEX_500),
)
def hex_center(spark, sf):
    located = filters.with_coordinates(crashes(spark, sf)).select("longitude", "latitude")
    cells = hexes.with_hex(located, 500).select("q", "r").distinct()
    return rounded(hexes.hex_center(cells, 500), "x", "y", digits=2)


_METRES = "(q + r / 2e0) * {w!r} AS x, r * {h!r}::DOUBLE AS y".format(
    w=500 / math.sqrt(3) * math.sqrt(3), h=1.5 * 500 / math.sqrt(3)
)


_CHANGE = (
    "counted AS (SELECT q, r, count(*) FILTER (WHERE date <= date_max - 365) AS prior, "
    "count(*) FILTER (WHERE date > date_max - 365) AS lastyear, max(win.prior) AS n "
    "FROM hexed, win WHERE vulnerable_role = 'Pedestrian' "
    "AND date > date_max - (365 * (win.prior + 1))::INTEGER GROUP BY q, r), "
    "changed AS (SELECT q, r, prior, lastyear, prior + lastyear AS total, "
    "prior / n::DOUBLE AS prioryearlyaverage, CASE WHEN prior = 0 THEN 'Infinity'::DOUBLE "
    "ELSE (lastyear - prior / n::DOUBLE) / nullif(prior / n::DOUBLE, 0) END AS lastyearchangepercent, "
    "lastyear - prior / n::DOUBLE AS lastyearchangecrashes FROM counted)"
)
_CHANGE_COLS = (
    "q, r, prior, lastyear, total, round(prioryearlyaverage, 6) AS prioryearlyaverage, "
    "CASE WHEN isinf(lastyearchangepercent) THEN lastyearchangepercent "
    "ELSE round(lastyearchangepercent, 6) END AS lastyearchangepercent, "
    "round(lastyearchangecrashes, 6) AS lastyearchangecrashes"
)
_CHANGE_DOUBLES = ["prioryearlyaverage", "lastyearchangepercent", "lastyearchangecrashes"]


@query(
    "hex_change_3000",
    on_crashes(f"SELECT {_CHANGE_COLS} FROM changed", _LOCATED, _HEX_3000, _SPAN, _WINDOW, _CHANGE),
)
def hex_change_3000(spark, sf):
    return rounded(hexes.hex_change(crashes(spark, sf), 3000), *_CHANGE_DOUBLES)


@query(
    "hex_change_500",
    on_crashes(f"SELECT {_CHANGE_COLS} FROM changed", _LOCATED, _HEX_500, _SPAN, _WINDOW, _CHANGE),
)
def hex_change_500(spark, sf):
    return rounded(hexes.hex_change(crashes(spark, sf), 500), *_CHANGE_DOUBLES)


@query(
    "hex_highlight",
    on_crashes(
        "SELECT q, r, prior, CASE WHEN lastyearchangepercent > 0 THEN '+' ELSE '' END || "
        "round_even(lastyearchangepercent * 100, 0)::BIGINT::VARCHAR || '%' AS label FROM changed "
        "WHERE prior > 20 AND (lastyearchangecrashes > 5 OR lastyearchangecrashes < -2)",
        _LOCATED, _HEX_3000, _SPAN, _WINDOW, _CHANGE,
    ),
)
def hex_highlight(spark, sf):
    busy = hexes.hex_highlight(hexes.hex_change(crashes(spark, sf), 3000), min_prior=20)
    return busy.select("q", "r", "prior", text.pct_label("lastyearchangepercent").alias("label"))


@query(
    "hex_event",
    on_crashes(
        "SELECT q, r, count(*) FILTER (WHERE d <= DATE '2025-10-07') AS during, "
        "count(*) FILTER (WHERE d > DATE '2025-10-07') AS after, count(*) AS total, "
        "count(*) FILTER (WHERE d <= DATE '2025-10-07') - "
        "count(*) FILTER (WHERE d > DATE '2025-10-07') AS change FROM (SELECT *, "
        "try_cast('2025-' || strftime(date, '%m-%d') AS DATE) AS d FROM hexed) "
        "WHERE d BETWEEN DATE '2025-10-01' AND DATE '2025-10-14' AND ped_age >= 18 "
        "AND vulnerable_role = 'Pedestrian' GROUP BY q, r",
        _LOCATED, _HEX_500,
    ),
)
def hex_event(spark, sf):
    return hexes.hex_event(crashes(spark, sf), 500)


def _flat_sides(cell_m: float) -> str:
    """Tract sides in metres, boxes of cells around them and the touched cells."""
    radius = cell_m / math.sqrt(3)
    width = radius * math.sqrt(3)
    a = utm_ctes("sides", "x1", "y1", "pa").replace(" AS x,", " AS ax,").replace(" AS y FROM", " AS ay FROM")
    b = utm_ctes("pa_r", "x2", "y2", "pb").replace(" AS x,", " AS bx,").replace(" AS y FROM", " AS by_ FROM")
    strips = []
    for t in (0.0, math.pi / 3, 2 * math.pi / 3):
        strips.append((f"{math.cos(t)!r}", f"{math.sin(t)!r}"))
    half = repr(cell_m / 2)
    lows, highs, apart = ["0"], ["1"], []
    for i, _ in enumerate(strips):
        lows.append(f"CASE WHEN d{i} = 0 THEN 0 ELSE least((-{half} - s{i}) / d{i}, ({half} - s{i}) / d{i}) END")
        highs.append(f"CASE WHEN d{i} = 0 THEN 1 ELSE greatest((-{half} - s{i}) / d{i}, ({half} - s{i}) / d{i}) END")
        apart.append(f"(d{i} = 0 AND abs(s{i}) > {half})")
    projected = ", ".join(
        f"(ax - cx) * {c} + (ay - cy) * {s} AS s{i}, (bx - ax) * {c} + (by_ - ay) * {s} AS d{i}"
        for i, (c, s) in enumerate(strips)
    )
    return (
        f"{a}, pa_r AS (SELECT GEOID, x1, y1, x2, y2, ax, ay FROM pa), {b}, "
        "flat AS (SELECT GEOID, ax, ay, bx, by_ FROM pb), "
        "ext AS (SELECT GEOID, min(ax) AS x0, max(ax) AS xm, min(ay) AS y0, max(ay) AS ym "
        "FROM flat GROUP BY GEOID), "
        "rws AS (SELECT *, unnest(generate_series("
        f"floor((y0 - {radius!r}) / {1.5 * radius!r})::BIGINT, "
        f"ceil((ym + {radius!r}) / {1.5 * radius!r})::BIGINT)) AS r FROM ext), "
        "cls AS (SELECT *, unnest(generate_series("
        f"floor((x0 - {width / 2!r}) / {width!r} - r / 2e0)::BIGINT, "
        f"ceil((xm + {width / 2!r}) / {width!r} - r / 2e0)::BIGINT)) AS q FROM rws), "
        f"cen AS (SELECT GEOID, q, r, (q + r / 2e0) * {width!r} AS cx, r * {1.5 * radius!r} AS cy FROM cls), "
        f"cut AS (SELECT c.GEOID, q, r, cx, cy, ax, ay, bx, by_, {projected} "
        "FROM cen c JOIN flat f ON c.GEOID = f.GEOID), "
        "touched AS (SELECT GEOID, q, r FROM cut GROUP BY GEOID, q, r HAVING "
        f"bool_or(NOT ({' OR '.join(apart)}) AND greatest({', '.join(lows)}) <= least({', '.join(highs)})) "
        "OR count(*) FILTER (WHERE (ay > cy) <> (by_ > cy) AND "
        "cx < ax + (bx - ax) * (cy - ay) / nullif(by_ - ay, 0)) % 2 = 1)"
    )


_TRACT_SIDES = TRACTS.split("numbered AS (")[0].rstrip().rstrip(",")


@query("hex_grid", f"WITH {_TRACT_SIDES}, {_flat_sides(3000)} SELECT GEOID, q, r FROM touched")
def hex_grid(spark, sf):
    return hexes.hex_grid(tract_table(spark, sf), 3000).select("GEOID", "q", "r")


@query("hex_grid_500", f"WITH {_TRACT_SIDES}, {_flat_sides(500)} SELECT GEOID, q, r FROM touched")
def hex_grid_500(spark, sf):
    return hexes.hex_grid(tract_table(spark, sf), 500).select("GEOID", "q", "r")


@query(
    "complete_grid",
    on_crashes(
        "SELECT g.q, g.r, c.prior, c.lastyear, c.total FROM (SELECT DISTINCT q, r FROM touched) g "
        "LEFT JOIN changed c ON g.q = c.q AND g.r = c.r",
        _LOCATED, _HEX_3000, _SPAN, _WINDOW, _CHANGE, _TRACT_SIDES, _flat_sides(3000),
    ),
)
def complete_grid(spark, sf):
    cells = hexes.hex_grid(tract_table(spark, sf), 3000).select("q", "r").distinct()
    out = hexes.complete_grid(cells, hexes.hex_change(crashes(spark, sf), 3000))
    return out.select("q", "r", "prior", "lastyear", "total")


def _lonlat_sql(source: str, out: str) -> str:
    """``out``: the rows of ``source`` (with ``x, y`` in metres) with ``lon`` and ``lat``."""
    k = projection.SCALE * projection._A
    phi = "chi" + "".join(
        f" + ({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(projection._DELTA, start=1)
    )
    return (
        f"{out}_1 AS (SELECT *, y / {k!r} AS xi, (x - 500000) / {k!r} AS eta FROM {source}), "
        f"{out}_2 AS (SELECT *, xi{_series(projection._BETA, 'sin', 'cosh', '-')} AS xj, "
        f"eta{_series(projection._BETA, 'cos', 'sinh', '-')} AS ej FROM {out}_1), "
        f"{out}_3 AS (SELECT *, asin(sin(xj) / cosh(ej)) AS chi, atan2(sinh(ej), cos(xj)) AS dl "
        f"FROM {out}_2), "
        f"{out} AS (SELECT *, degrees(dl) - 87 AS lon, degrees({phi}) AS lat FROM {out}_3)"
    )


@query(
    "hex_centroid",
    on_crashes(
        "SELECT q, r, round(lon, 6) AS longitude, round(lat, 6) AS latitude FROM ll",
        _LOCATED, _HEX_500, f"cell AS (SELECT DISTINCT q, r, {_METRES} FROM hexed)",
        _lonlat_sql("cell", "ll"),
    ),
)
def hex_centroid(spark, sf):
    located = filters.with_coordinates(crashes(spark, sf)).select("longitude", "latitude")
    cells = hexes.with_hex(located, 500).select("q", "r").distinct()
    return rounded(hexes.hex_centroid(cells, 500), "longitude", "latitude")


_R3000 = 3000 / math.sqrt(3)
_CORNERS = (
    f"corner AS (SELECT (q + r / 2e0) * {_R3000 * math.sqrt(3)!r} + {_R3000!r} * cos(t) AS x, "
    f"r * {1.5 * _R3000!r}::DOUBLE + {_R3000!r} * sin(t) AS y FROM changed, "
    "(SELECT pi() / 6 + unnest(generate_series(0, 5)) * pi() / 3 AS t))"
)


@query(
    "cells_box",
    on_crashes(
        'SELECT round(min(lon), 6) AS "left", round(min(lat), 6) AS bottom, '
        'round(max(lon), 6) AS "right", round(max(lat), 6) AS top FROM ll',
        _LOCATED, _HEX_3000, _SPAN, _WINDOW, _CHANGE, _CORNERS, _lonlat_sql("corner", "ll"),
    ),
)
def cells_box(spark, sf):
    cells = hexes.hex_change(crashes(spark, sf), 3000)
    return rounded(hexes.cells_box(cells, 3000), *spatial.BOX)


# ---- density -------------------------------------------------------------------------------------------

_KDE = (
    "located AS (SELECT longitude AS px, latitude AS py FROM crashes WHERE latitude IS NOT NULL), "
    "st AS (SELECT count(*)::DOUBLE AS n, min(px) AS x0, max(px) AS x1, min(py) AS y0, "
    "max(py) AS y1, "
    "1.06e0 * least(stddev_samp(px), (quantile_cont(px, 0.75) - quantile_cont(px, 0.25)) / 1.34e0) "
    "* pow(count(*), -0.2e0) AS hx, "
    "1.06e0 * least(stddev_samp(py), (quantile_cont(py, 0.75) - quantile_cont(py, 0.25)) / 1.34e0) "
    "* pow(count(*), -0.2e0) AS hy FROM located), "
    "axis AS (SELECT unnest(generate_series(1, 200))::INTEGER AS i), "
    "gx AS (SELECT i AS ix, x0 + (i - 1) * (x1 - x0) / 199e0 AS g FROM axis, st), "
    "gy AS (SELECT i AS iy, y0 + (i - 1) * (y1 - y0) / 199e0 AS g FROM axis, st), "
    "px AS (SELECT px, py, count(*) AS w FROM located GROUP BY ALL), "
    "kx AS (SELECT py, ix, sum(w * exp(-0.5e0 * pow((g - px) / hx, 2))) AS a "
    "FROM px, gx, st GROUP BY py, ix), "
    "lat AS (SELECT DISTINCT py FROM px), "
    "ky AS (SELECT py, iy, exp(-0.5e0 * pow((g - py) / hy, 2)) AS b FROM lat, gy, st), "
    "grid AS (SELECT ix, iy, sum(a * b) / max(2 * pi() * n * hx * hy) AS z "
    "FROM kx JOIN ky USING (py), st GROUP BY ix, iy), "
    "span_z AS (SELECT min(z) AS lo, max(z) AS hi FROM grid), "
    "classed AS (SELECT ix, iy, z, greatest(1, least(10, ceil((z - lo) / ((hi - lo) / 10))))"
    "::INTEGER AS class FROM grid, span_z)"
)


@query("kde_classes", on_crashes("SELECT ix, iy, round(z, 6) AS z, class FROM classed", _KDE))
def kde_classes(spark, sf):
    grid = density.kde_grid(crashes(spark, sf).select("longitude", "latitude"))
    return rounded(density.classify(grid).select("ix", "iy", "z", "class"), "z")


@query(
    "kde_outlines",
    on_crashes(
        "SELECT class, ax, ay, way FROM (SELECT class, ix AS ax, iy AS ay, 'h' AS way FROM classed "
        "UNION ALL SELECT class, ix, iy + 1, 'h' FROM classed UNION ALL "
        "SELECT class, ix, iy, 'v' FROM classed UNION ALL SELECT class, ix + 1, iy, 'v' "
        "FROM classed) GROUP BY ALL HAVING count(*) = 1",
        _KDE,
    ),
)
def kde_outlines(spark, sf):
    grid = density.kde_grid(crashes(spark, sf).select("longitude", "latitude"))
    return density.dissolve_cells(density.classify(grid))


# ---- network ---------------------------------------------------------------------------------------------


@query(
    "network_reach",
    "WITH RECURSIVE e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, "
    "min(l_quantity) AS w FROM lineitem GROUP BY ALL HAVING min(l_quantity) <= 4), "
    "step AS (SELECT a AS src, b AS dst, w FROM e UNION ALL SELECT b, a, w FROM e), "
    "walk AS (SELECT s_suppkey AS source, 's' || s_suppkey AS node, 0e0 AS distance FROM supplier "
    "UNION SELECT source, dst, distance + w FROM walk JOIN step ON node = src "
    "WHERE distance + w <= 4) "
    "SELECT source, node, min(distance) AS distance FROM walk GROUP BY source, node",
)
def network_reach(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"),
        F.col("l_quantity").alias("length"),
    )
    sources = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("source"),
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"),
    )
    return network.network_reach(edges, sources, 4)


# ---- reshape -----------------------------------------------------------------------------------------------


@query(
    "widen",
    on_crashes(
        "SELECT CNTYNAME, nullif(count(*) FILTER (WHERE vulnerable_role = 'Bicyclist'), 0) AS Bicyclist, "
        "nullif(count(*) FILTER (WHERE vulnerable_role = 'Pedestrian'), 0) AS Pedestrian, "
        "NULL::BIGINT AS Skater FROM crashes GROUP BY CNTYNAME"
    ),
)
def widen(spark, sf):
    counts = summaries.count_by(crashes(spark, sf), ["CNTYNAME", "vulnerable_role"])
    return reshape.widen(
        counts, ["CNTYNAME"], "vulnerable_role", "count", ["Bicyclist", "Pedestrian", "Skater"]
    )


@query(
    "lengthen",
    on_crashes(
        "SELECT CNTYNAME, 'Bicyclist' AS name, count(*) FILTER (WHERE vulnerable_role = 'Bicyclist') "
        "AS value FROM crashes GROUP BY CNTYNAME UNION ALL SELECT CNTYNAME, 'Pedestrian', "
        "count(*) FILTER (WHERE vulnerable_role = 'Pedestrian') FROM crashes GROUP BY CNTYNAME "
        "UNION ALL SELECT CNTYNAME, 'total', count(*) FILTER (WHERE vulnerable_role IS NOT NULL) "
        "FROM crashes GROUP BY CNTYNAME"
    ),
)
def lengthen(spark, sf):
    counts = summaries.count_by(crashes(spark, sf), ["CNTYNAME", "vulnerable_role"])
    roles = ["Bicyclist", "Pedestrian"]
    wide = reshape.widen(counts, ["CNTYNAME"], "vulnerable_role", "count", roles)
    filled = reshape.row_total(reshape.zero_fill(wide, ["CNTYNAME"]), roles)
    return reshape.lengthen(filled, ["CNTYNAME"], [*roles, "total"])


# ---- whole reports ---------------------------------------------------------------------------------------------


@query(
    "county_comparison",
    on_crashes(
        "SELECT s.County, s.year_x, s.TotalCrashes, "
        "round(s.TotalCrashes / (p.value / 100000e0), 6) AS CrashesPerPopulation "
        "FROM sev s LEFT JOIN pop p ON s.County = p.County WHERE EXISTS "
        "(SELECT 1 FROM top WHERE top.CNTYNAME IS NOT DISTINCT FROM s.County)",
        _POP, _SEVERE_YEAR, _TOP,
    ),
)
def county_comparison(spark, sf):
    out = county.county_comparison(crashes(spark, sf), population(spark, sf))
    return rounded(
        out.select("County", "year_x", "TotalCrashes", "CrashesPerPopulation"), "CrashesPerPopulation"
    )


@query(
    "county_report_years",
    on_crashes(
        "SELECT year, CASE WHEN MUNINAME = 'MACHINERY' THEN 'City of Machinery' "
        "ELSE 'Other municipalities' END AS city, CASE WHEN MUNINAME = 'MACHINERY' THEN 2 ELSE 1 "
        "END::INTEGER AS city_rank, count(*) AS total FROM crashes WHERE CNTYNAME = 'NATION_3' "
        "AND month <= 9 AND ped_inj IN ('K', 'A') GROUP BY ALL"
    ),
)
def county_report_years(spark, sf):
    return county.county_report(crashes(spark, sf), "NATION_3", "MACHINERY")["years_city"]


# ---- files ------------------------------------------------------------------------------------------


@query(
    "read_exports",
    on_crashes(
        "SELECT year, CNTYNAME, count(*) AS n, count(DISTINCT DOCTNMBR) AS documents, sum(age1) AS age1, "
        "sum(age2) AS age2, count(longitude) AS placed, min(latitude) AS south, max(longitude) AS east, "
        "count(*) FILTER (row_order % 2 = 1) AS extra, count(ped_inj_name) AS injured FROM crashes GROUP BY ALL"
    ),
)
def read_exports(spark, sf):
    """Two layouts of text files, with other column orders and one column more, written and read."""
    raw = raw_crashes(spark, sf)
    names = [c for c, kind in raw.dtypes if c not in ("retreive_date", *ROW_COLS)]
    texts = raw.select("row_order", *[F.col(c).cast("string").alias(c) for c in names])
    out = shared_path(spark, "exports")
    options = {"header": True, "nullValue": "NA"}
    texts.where("row_order % 2 = 0").select(names).write.options(**options).csv(f"{out}/crash data 1")
    more = texts.where("row_order % 2 = 1").withColumn("EXTRA", F.lit("x")).select("EXTRA", *names[::-1])
    more.write.options(**options).csv(f"{out}/crash data 2")
    read = exports.read_exports(spark, f"{out}/crash data *", "*.csv")
    return curate(read).groupBy("year", "CNTYNAME").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("DOCTNMBR").alias("documents"),
        F.sum("age1").alias("age1"), F.sum("age2").alias("age2"), F.count("longitude").alias("placed"),
        F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.count("EXTRA").alias("extra"),
        F.count("ped_inj_name").alias("injured"),
    )


@query(
    "read_geojson",
    f"WITH {TRACTS.split('sides AS (')[0].rstrip().rstrip(',')} SELECT GEOID, value::VARCHAR AS value, "
    "2 AS n_rings, 11 AS n_corners, cx - s AS \"left\", cy + s AS top FROM tract",
)
def read_geojson(spark, sf):
    """A layer of polygons, written and read."""
    out = shared_path(spark, "layer")
    sinks.export_layer(tract_table(spark, sf), out)
    read = vector.read_geojson(spark, out, lines=True)
    corners = F.flatten("rings")
    return read.select(
        F.col("properties")["GEOID"].alias("GEOID"), F.col("properties")["value"].alias("value"),
        F.size("rings").alias("n_rings"), F.size(corners).alias("n_corners"),
        F.array_min(F.transform(corners, lambda p: p["x"])).alias("left"),
        F.array_max(F.transform(corners, lambda p: p["y"])).alias("top"),
    )


@query(
    "read_kml",
    f"SELECT s_name AS name, {LON.format(k='s_suppkey')} AS lon, {LAT.format(k='s_suppkey')} AS lat, "
    "s_suppkey::DOUBLE AS x, 1 AS n_rings FROM supplier",
)
def read_kml(spark, sf):
    """A placemark with nested geometries for every supplier, written and read."""
    out, k = shared_path(spark, "marks"), F.col("s_suppkey")

    def place(*text: Column) -> Column:
        return F.struct(F.concat(*text).alias("coordinates"))

    point = place(lon_of(k).cast("string"), F.lit(","), lat_of(k).cast("string")).alias("Point")
    line = place(F.lit("1,2 "), k.cast("string"), F.lit(",4")).alias("LineString")
    ring = place(F.lit("0,0 1,0 1,1 0,0")).alias("LinearRing")
    many = F.struct(point, F.struct(line).alias("MultiGeometry"), ring).alias("MultiGeometry")
    marks = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), many)
    marks.write.format("xml").options(rootTag="Document", rowTag="Placemark").save(out)
    read = vector.read_kml(spark, out)
    return read.select(
        "name", F.col("points")[0]["x"].alias("lon"), F.col("points")[0]["y"].alias("lat"),
        F.col("paths")[0][1]["x"].alias("x"), F.size("rings").alias("n_rings"),
    )


# ---- the tables of a county's report, on that county's crashes alone --------------------------------

_OWN = "crashes AS (SELECT * FROM everyone WHERE CNTYNAME = 'NATION_3')"


def _own_sql(sql: str) -> str:
    """A query's SQL on the crashes of one county."""
    renamed = sql.replace("crashes AS (\n", "everyone AS (\n", 1)
    return renamed.replace("  FROM typed\n),", f"  FROM typed\n),\n{_OWN},", 1)


def _report_table(name: str, key: str, same: str, *doubles: str) -> None:
    """Register a table of the report; its SQL is that of the query ``same``."""

    def run(spark, sf):
        out = county.county_report(crashes(spark, sf), "NATION_3", "MACHINERY")[key]
        dates = [c for c, kind in out.dtypes if kind == "date"]  # compared as text there too
        return rounded(out, *doubles).withColumns({c: F.col(c).cast("string") for c in dates})

    query(name, _own_sql((_ALL_TABLES | ORACLES)[same]))(run)


for _name, _key, _same, *_doubles in (
    ("county_report_window", "window", "report_window"),
    ("county_report_months", "month_role", "monthly_profile_role", "average"),
    ("county_report_ages", "month_age", "monthly_profile_age", "average"),
    ("county_report_totals", "years", "ytd_total"),
    ("county_report_severity", "years_severe", "ytd_severity"),
    ("county_report_cumulative", "cumulative", "cumulative_by_year"),
    ("county_report_days", "halloween", "daily_profile"),
    ("county_report_weekends", "halloween_weekend", "weekend_average", "average"),
    ("county_report_vehicles", "vehicles", "severity_share", "percent", "cumpercent"),
    ("county_report_hexes_3000", "hex_3000", "hex_change_3000", *_CHANGE_DOUBLES),
    ("county_report_hexes_500", "hex_500", "hex_change_500", *_CHANGE_DOUBLES),
):
    _report_table(_name, _key, _same, *_doubles)
