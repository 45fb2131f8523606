"""Names of the files that rows come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(name: Column) -> Column:
    """A path or name as it is on disk; Spark's metadata columns have it percent-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def file_name() -> Column:
    """The name of a row's file as it is on disk."""
    return decoded(F.col("_metadata.file_name"))
