"""The same derivations and queries in SQL, for DuckDB."""

from __future__ import annotations

ROLES_VULN = "('BIKE', 'O BIKE', 'PED', 'O PED', 'PED NO')"

LAT = "(42.8e0 + ({k} * 7919 % 10007)::DOUBLE / 20014e0)"
LON = "(-88.1e0 + ({k} * 104729 % 10007)::DOUBLE / 20014e0)"

RAW = f"""
raw AS (
  SELECT
    l_orderkey::VARCHAR AS DOCTNMBR,
    CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN 'not recorded'
         ELSE strftime(l_shipdate, '%Y-%m-%d') END AS CRSHDATE,
    strftime(o_orderdate, '%H:%M') AS CRSHTIME,
    CASE WHEN n_nationkey <> 24 THEN n_name END AS CNTYNAME,
    c_mktsegment AS MUNINAME,
    p_name AS ONSTR,
    p_type AS ATSTR,
    CASE l_returnflag WHEN 'A' THEN 'BIKE' WHEN 'R' THEN 'PED' WHEN 'N' THEN 'DR' END AS ROLE1,
    CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 'PED NO'
         WHEN l_linestatus = 'F' THEN 'O PED'
         WHEN l_linenumber = 3 THEN 'O BIKE'
         WHEN l_linenumber <> 6 THEN 'DR' END AS ROLE2,
    CASE substr(o_orderpriority, 1, 1)
         WHEN '1' THEN 'K' WHEN '2' THEN 'A' WHEN '3' THEN 'B' WHEN '5' THEN 'O' END AS INJSVR1,
    CASE l_linenumber WHEN 1 THEN 'K' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN 'C'
         WHEN 5 THEN 'Z' END AS INJSVR2,
    CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size::DOUBLE END AS age1,
    l_quantity::INTEGER::DOUBLE AS age2,
    CASE WHEN l_partkey % 2 = 0 THEN 'F' ELSE 'M' END AS SEX1,
    CASE WHEN l_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS SEX2,
    CASE l_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'I' WHEN 3 THEN 'H'
         WHEN 4 THEN 'W' END AS RACE1,
    CASE l_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'I' WHEN 3 THEN 'H'
         WHEN 4 THEN 'W' END AS RACE2,
    CASE l_partkey % 4 WHEN 0 THEN 'CAR' WHEN 1 THEN 'SUV' WHEN 2 THEN 'UT TRK' END AS VEHTYPE1,
    CASE l_orderkey % 4 WHEN 0 THEN 'CAR' WHEN 1 THEN 'SUV' WHEN 2 THEN 'UT TRK' END AS VEHTYPE2,
    CASE WHEN l_partkey % 50 <> 0 THEN {LAT.format(k='l_partkey')} END AS latitude,
    CASE WHEN l_partkey % 50 <> 0 THEN {LON.format(k='l_orderkey')} END AS longitude,
    CASE WHEN l_returnflag = 'A' OR (l_linestatus <> 'F' AND l_linenumber = 3)
         THEN 'Y' END AS BIKEFLAG,
    CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN 'Y' END AS PEDFLAG,
    o_orderdate AS retreive_date,
    l_orderkey AS row_order, l_linenumber AS row_line, l_partkey AS row_part
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""


def severity_name(code: str) -> str:
    return (
        f"CASE WHEN {code} IS NULL THEN 'Injury Severity Unknown' "
        f"WHEN {code} = 'O' THEN 'No apparent injury' WHEN {code} = 'C' THEN 'Possible Injury' "
        f"WHEN {code} = 'B' THEN 'Suspected Minor Injury' "
        f"WHEN {code} = 'A' THEN 'Suspected Serious Injury' WHEN {code} = 'K' THEN 'Fatality' END"
    )


def severity_rank(code: str) -> str:
    return (
        f"CASE WHEN {code} IS NULL THEN 1 WHEN {code} = 'O' THEN 2 WHEN {code} = 'C' THEN 3 "
        f"WHEN {code} = 'B' THEN 4 WHEN {code} = 'A' THEN 5 WHEN {code} = 'K' THEN 6 END"
    )


def race_name(code: str) -> str:
    return (
        f"CASE {code} WHEN 'A' THEN 'Asian' WHEN 'B' THEN 'Black' WHEN 'I' THEN 'Indian' "
        f"WHEN 'H' THEN 'Hispanic' WHEN 'W' THEN 'White' END"
    )


V1 = f"coalesce(ROLE1 IN {ROLES_VULN}, FALSE)"
V2 = f"coalesce(ROLE2 IN {ROLES_VULN}, FALSE)"
D1 = "coalesce(ROLE1 = 'DR', FALSE)"
D2 = "coalesce(ROLE2 = 'DR', FALSE)"
BIKE = "coalesce(ROLE1 IN ('BIKE', 'O BIKE'), FALSE) OR coalesce(ROLE2 IN ('BIKE', 'O BIKE'), FALSE)"
PED = (
    "coalesce(ROLE1 IN ('PED', 'O PED', 'PED NO'), FALSE) "
    "OR coalesce(ROLE2 IN ('PED', 'O PED', 'PED NO'), FALSE)"
)


def pick(a1: str, a2: str) -> str:
    return f"CASE WHEN {V1} THEN {a1} WHEN {V2} THEN {a2} END"


def pick_driver(a1: str, a2: str) -> str:
    return f"CASE WHEN {D1} THEN {a1} WHEN {D2} THEN {a2} END"


CRASHES = f"""{RAW},
typed AS (
  SELECT *, try_cast(CRSHDATE AS DATE) AS date, {pick('INJSVR1', 'INJSVR2')} AS ped_inj
  FROM raw
),
crashes AS (
  SELECT *,
    month(date)::INTEGER AS month, strftime(date, '%b') AS month_label,
    year(date)::INTEGER AS year,
    {severity_name('INJSVR1')} AS InjSevName1,
    {severity_name('INJSVR2')} AS InjSevName2,
    {severity_name('ped_inj')} AS ped_inj_name,
    {severity_rank('ped_inj')} AS severity_rank,
    CASE WHEN {V1} THEN age1 ELSE age2 END AS ped_age,
    CASE WHEN {BIKE} THEN 'Bicyclist' WHEN {PED} THEN 'Pedestrian' END AS vulnerable_role,
    CASE WHEN {BIKE} THEN 'Ciclista' WHEN {PED} THEN 'Peatón' END AS vulnerable_role_es,
    {race_name('RACE1')} AS race_name1,
    {race_name('RACE2')} AS race_name2,
    {pick(race_name('RACE1'), race_name('RACE2'))} AS vulnerable_race,
    CASE WHEN coalesce(CASE WHEN {V1} THEN VEHTYPE2 ELSE VEHTYPE1 END IN ('SUV', 'UT TRK'), FALSE)
         THEN 'Truck/SUV'
         WHEN coalesce(CASE WHEN {V1} THEN VEHTYPE2 ELSE VEHTYPE1 END = 'CAR', FALSE)
         THEN 'Car' ELSE 'Other' END AS nonvuln_vehicletype
  FROM typed
),
people AS (
  SELECT *,
    {pick('age1', 'age2')} AS vulnerable_age, {pick('SEX1', 'SEX2')} AS vulnerable_sex,
    {pick_driver('race_name1', 'race_name2')} AS driver_race,
    {pick_driver('age1', 'age2')} AS driver_age,
    {pick_driver('SEX1', 'SEX2')} AS driver_sex,
    {pick_driver('VEHTYPE1', 'VEHTYPE2')} AS driver_vehtype
  FROM crashes
)"""


def on_crashes(sql: str, *ctes: str) -> str:
    """A query over ``crashes`` / ``people`` with further common tables before it."""
    return "WITH " + ",\n".join([CRASHES, *ctes]) + "\n" + sql
