"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_key(row[i]) for i in order) for row in rows)


def _kinds(rows) -> list[set]:
    out = None
    for row in rows:
        if out is None:
            out = [set() for _ in row]
        for kinds, v in zip(out, row):
            if v is not None:
                kinds.add(type(v).__name__)
    return out or []


def compare(spark: SparkSession, sf_dir: str, name: str, con) -> tuple[bool, str]:
    start = time.time()
    df = registry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = registry.oracles().get(name)
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    got_rows, want_rows = _rows(df.columns, rows), _rows(names, want)
    got_kinds = dict(zip(df.columns, _kinds(rows)))
    want_kinds = dict(zip(names, _kinds(want)))
    note = f"{len(rows)} rows, {took:.1f}s, sql {sql_took:.1f}s"
    if got_rows != want_rows:
        missing, extra = want_rows - got_rows, got_rows - want_rows
        return False, (
            f"{note}; {sum(missing.values())} missing e.g. {list(missing)[:2]}, "
            f"{sum(extra.values())} extra e.g. {list(extra)[:2]}"
        )
    if rows and got_kinds != want_kinds:
        return False, f"{note}; types {got_kinds} vs {want_kinds}"
    return True, note


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, sf_dir, name, con)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
