"""Curated table, typed and inferred CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_curated(df: DataFrame, path: str) -> None:
    """Parquet by year. The rebalance lets AQE size the files: a large year is split into
    several, small ones are not scattered over many."""
    df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_TYPES = {
    "c": T.StringType(),
    "i": T.IntegerType(),
    "d": T.DoubleType(),
    "l": T.BooleanType(),
    "D": T.DateType(),
    "T": T.TimestampType(),
}


def typed_schema(names: list[str], types: str) -> T.StructType:
    """Schema from one letter per column: c text, i integer, d number, l logical, D date,
    T time."""
    if len(names) != len(types):
        raise ValueError(f"{len(names)} names for {len(types)} types")
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in zip(names, types)])


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with given types; a value that does not fit is null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose types are read from the data: for small published tables."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", True)
        .option("nullValue", "NA")
        .csv(path)
    )
