"""Registered queries against their SQL. All of them with ``ALL_QUERIES=1``."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import compare, registry

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "curated_crashes", "all_summaries_county", "youth_county", "county_rates", "keep_in_top_places",
    "monthly_profile_age", "hex_change_500", "school_crashes", "tract_rates", "enrollment_wide",
]
NAMES = list(registry.queries()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in compare.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    same, note = compare.compare(spark, SF, name, con)
    assert same, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["CNTYNAME", "year", "vulnerable_role", "ped_inj_name", "count"]
    assert df.count() > 0


def test_every_query_has_sql():
    # the training-data queries, where present, have SQL only where SQL can express them
    assert set(registry.oracles()) == set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
