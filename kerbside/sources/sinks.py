"""Writers for summaries and map layers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.summaries import split_summaries


#: Most rows in one file of a summary; a place with more has several, in order of their names.
ROWS_PER_FILE = 1_000_000


def write_summaries(summaries: dict[str, DataFrame], out: str, place: str) -> None:
    """One folder per summary, in it one per place (``place=...``) with its rows ordered by their keys.

    The files have all columns of the summary, the place first. Rows are dealt out by ranges of place
    and keys, so a place of any size is written by as many tasks as it has ranges, and the files of
    a place follow each other in order of their names. Each summary is committed as a whole: an older
    one is replaced only when all files are there.
    """
    for name, table in summaries.items():
        keys = [F.col(c).asc_nulls_last() for c in table.columns if c not in ("count", place)]
        order = [F.col("place").asc(), *keys]  # begins as the writer wants it, so it sorts nothing anew
        rows = table.select(place, *[c for c in table.columns if c != place]).withColumn("place", F.col(place))
        (
            rows.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .partitionBy("place")
            .option("header", True)
            .option("nullValue", "NA")
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .csv(f"{out}/{name}")
        )


def write_all_summaries(summaries: DataFrame, out: str, place: str) -> None:
    """The combined table of ``all_summaries``: as one CSV tree per summary."""
    kept = summaries.persist()
    try:
        write_summaries(split_summaries(kept, place), out, place)
    finally:
        kept.unpersist()


def geojson_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One GeoJSON feature per row, as text; all other columns are properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(*rest).alias("properties"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def geojson_polygons(df: DataFrame, rings: str = "rings") -> DataFrame:
    rest = [c for c in df.columns if c != rings]
    coordinates = F.transform(
        F.col(rings), lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(*rest).alias("properties"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def export_layer(df: DataFrame, path: str) -> None:
    """A map layer as GeoJSON lines: points or, if there are rings, polygons."""
    features = geojson_polygons(df) if "rings" in df.columns else geojson_points(df)
    features.write.mode("overwrite").text(path)


def write_files(df: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """One file per ``path`` below ``folder``, with ``content`` as its text (of rows with one path, the smallest).

    All tasks write, each file once and in place, so a file costs no folder of its own and no step of the
    driver. A task that is run again writes the same files. Rows without a path have none."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("string").alias("text"))
    rows = rows.groupBy("path").agg(F.min("text").alias("text")).repartition(tasks, "path")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made, n = set(), 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{root.rstrip('/')}/{name}"
                parent = place.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(place) as out:
                    out.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
