import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RAW = (
    "DOCTNMBR", "CRSHDATE", "CRSHTIME", "CNTYNAME", "MUNINAME", "ONSTR", "ATSTR", "ROLE1", "ROLE2",
    "INJSVR1", "INJSVR2", "AGE1", "AGE2", "SEX1", "SEX2", "RACE1", "RACE2", "VEHTYPE1",
    "VEHTYPE2", "LATDECDG", "LONDECDG", "BIKEFLAG", "PEDFLAG",
)


@pytest.fixture(scope="session")
def raw(spark):
    """Raw crashes from dictionaries; columns left out are null."""

    def make(*rows):
        schema = ", ".join(f"{c} string" for c in RAW) + ", retreive_date timestamp"
        names = (*RAW, "retreive_date")
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def curated(raw):
    from kerbside.operators.curate import curate

    return lambda *rows: curate(raw(*rows))
