"""Time the headline queries; prints one JSON line.

The tables are first put into the layout of crash exports (not timed). Then the curated
table is written from them (``write_curated``), as a user does, and the other queries start
from that table.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from checks import registry
from checks.compare import session
from checks.surrogate import raw_crashes, use_curated
from kerbside.operators.curate import curate
from kerbside.sources.tables import write_curated

HEADLINE = [
    "all_summaries_county",
    "all_summaries_city",
    "county_crash_by_year",
    "youth_county",
    "vehicle_share_by_severity",
    "county_rates",
    "county_year_rate",
    "top_places",
    "monthly_profile_role",
    "cumulative_by_year",
    "daily_profile",
    "weekend_average",
    "weekly_profile",
    "severity_share",
    "hex_change_3000",
    "hex_change_500",
    "hex_event",
    "box_compare",
    "school_crash_counts",
    "points_in_polygons",
    "tract_rates",
    "school_lines",
    "kde_classes",
    "kde_outlines",
    "network_reach",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    seconds = {}

    raw_crashes(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).write.parquet(
        f"{work}/exports"
    )
    start = time.time()
    write_curated(curate(spark.read.parquet(f"{work}/exports")), f"{work}/crashes")
    seconds["write_curated"] = round(time.time() - start, 3)
    use_curated(sf_dir, f"{work}/crashes")

    for name in HEADLINE:
        start = time.time()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
