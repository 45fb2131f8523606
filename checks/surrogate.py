"""A crash-shaped view of the given tables, as Spark DataFrames.

The tables hold no crashes, so every query starts from these derived ones. The same
derivation is written in SQL in ``checks/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.curate import curate
from kerbside.sources.tables import read_curated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(c: Column, values: list[str | None]) -> Column:
    """values[c] counted from 1, null beyond the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), c - 1)


def lat_of(key: Column) -> Column:
    return F.lit(42.8) + (key * 7919 % 10007).cast("double") / F.lit(20014.0)


def lon_of(key: Column) -> Column:
    return F.lit(-88.1) + (key * 104729 % 10007).cast("double") / F.lit(20014.0)


def raw_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash export layout: text columns plus the retrieval time of the file."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part")
    df = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    number, partkey, orderkey, suppkey = (
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"),
    )
    role1 = F.col("l_returnflag")
    even = number % 2 == 0
    return df.select(
        orderkey.cast("string").alias("DOCTNMBR"),
        F.when((number == 7) & (partkey % 10 == 0), "not recorded")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("CRSHDATE"),
        F.date_format("o_orderdate", "HH:mm").alias("CRSHTIME"),
        F.when(F.col("n_nationkey") != 24, F.col("n_name")).alias("CNTYNAME"),
        F.col("c_mktsegment").alias("MUNINAME"),
        F.col("p_name").alias("ONSTR"),
        F.col("p_type").alias("ATSTR"),
        F.try_element_at(
            F.create_map(*[F.lit(v) for v in ("A", "BIKE", "R", "PED", "N", "DR")]), role1
        ).alias("ROLE1"),
        F.when((F.col("l_linestatus") == "F") & even, "PED NO")
        .when(F.col("l_linestatus") == "F", "O PED")
        .when(number == 3, "O BIKE")
        .when(number != 6, "DR").alias("ROLE2"),
        _pick(F.substring("o_orderpriority", 1, 1).cast("int"), ["K", "A", "B", None, "O"])
        .alias("INJSVR1"),
        _pick(number, ["K", "A", "B", "C", "Z"]).alias("INJSVR2"),
        F.when(F.col("p_size") % 10 == 0, "UNK").otherwise(F.col("p_size").cast("string"))
        .alias("AGE1"),
        F.col("l_quantity").cast("int").cast("string").alias("AGE2"),
        F.when(partkey % 2 == 0, "F").otherwise("M").alias("SEX1"),
        F.when(suppkey % 2 == 0, "F").otherwise("M").alias("SEX2"),
        _pick((partkey % 6).cast("int") + 1, ["A", "B", "I", "H", "W"]).alias("RACE1"),
        _pick((suppkey % 6).cast("int") + 1, ["A", "B", "I", "H", "W"]).alias("RACE2"),
        _pick((partkey % 4).cast("int") + 1, ["CAR", "SUV", "UT TRK"]).alias("VEHTYPE1"),
        _pick((orderkey % 4).cast("int") + 1, ["CAR", "SUV", "UT TRK"]).alias("VEHTYPE2"),
        F.when(partkey % 50 != 0, lat_of(partkey)).alias("LATDECDG"),
        F.when(partkey % 50 != 0, lon_of(orderkey)).alias("LONDECDG"),
        F.when((role1 == "A") | ((F.col("l_linestatus") != "F") & (number == 3)), "Y")
        .alias("BIKEFLAG"),
        F.when((role1 == "R") | (F.col("l_linestatus") == "F"), "Y").alias("PEDFLAG"),
        F.col("o_orderdate").alias("retreive_date"),
        orderkey.alias("row_order"),
        number.alias("row_line"),
        partkey.alias("row_part"),
    )


_WRITTEN: dict[str, str] = {}


def use_curated(sf_dir: str, path: str) -> None:
    """Let the queries on ``sf_dir`` start from a curated table written to ``path``."""
    _WRITTEN[sf_dir] = path


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated crash table."""
    if sf_dir in _WRITTEN:
        return read_curated(spark, _WRITTEN[sf_dir])
    return curate(raw_crashes(spark, sf_dir))
