"""Population estimates as a county dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def population_dim(
    df: DataFrame, measure: str = "POPESTIMATE", suffix: str = " County,.*$"
) -> DataFrame:
    """Rows of one measure with the upper-case county name as ``County``."""
    return df.where(F.col("variable") == measure).withColumn(
        "County", F.upper(F.regexp_replace("NAME", suffix, ""))
    )
