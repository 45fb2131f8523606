"""Pointy-top hexagonal cells by arithmetic: a point's cell is an axial key ``(q, r)``.

``cell_m`` is the distance between opposite sides in metres. Cells are counted from the
origin of the projection, so a key means the same place in every run, and no grid polygons
or point-in-cell join are needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.nulls import safe_div
from kerbside.functions.projection import project_rings, with_lonlat, with_utm
from kerbside.functions.rings import edges, span_between
from kerbside.operators.filters import with_coordinates
from kerbside.operators.lineage import checkpointed
from kerbside.operators.trends import event_window, tag_periods, window_of


def _radius(cell_m: float) -> float:
    return cell_m / math.sqrt(3)


def _nearest(c: Column) -> Column:
    return F.floor(c + 0.5)


def hex_cell(df: DataFrame, cell_m: float, x: str = "x", y: str = "y") -> DataFrame:
    """Add the key of the cell that holds the point (metres)."""
    radius = _radius(cell_m)
    df = df.withColumns(
        {
            "_q": (F.col(x) * (math.sqrt(3) / 3) - F.col(y) / 3) / radius,
            "_r": F.col(y) * 2 / 3 / radius,
        }
    )
    df = df.withColumns(
        {
            "_rq": _nearest(F.col("_q")),
            "_rr": _nearest(F.col("_r")),
            "_rs": _nearest(-F.col("_q") - F.col("_r")),
        }
    )
    df = df.withColumns(
        {
            "_dq": F.abs(F.col("_rq") - F.col("_q")),
            "_dr": F.abs(F.col("_rr") - F.col("_r")),
            "_ds": F.abs(F.col("_rs") + F.col("_q") + F.col("_r")),
        }
    )
    # the three rounded coordinates must add up to zero: redo the one that moved most
    q_moved = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    r_moved = ~q_moved & (F.col("_dr") > F.col("_ds"))
    return df.withColumns(
        {
            "q": F.when(q_moved, -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq")),
            "r": F.when(r_moved, -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr")),
        }
    ).drop("_q", "_r", "_rq", "_rr", "_rs", "_dq", "_dr", "_ds")


def with_hex(
    df: DataFrame,
    cell_m: float,
    lon: str = "longitude",
    lat: str = "latitude",
    zone: int = 16,
) -> DataFrame:
    """Add the cell key of a longitude/latitude."""
    return hex_cell(with_utm(df, lon, lat, ("_x", "_y"), zone), cell_m, "_x", "_y").drop("_x", "_y")


def hex_center(df: DataFrame, cell_m: float, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Add the cell's centre in metres."""
    radius = _radius(cell_m)
    return df.withColumns(
        {
            out[0]: (F.col("q") + F.col("r") / 2) * (radius * math.sqrt(3)),
            out[1]: F.col("r") * (1.5 * radius),
        }
    )


def hex_centroid(df: DataFrame, cell_m: float, zone: int = 16) -> DataFrame:
    """Add the cell's centre in degrees."""
    centred = hex_center(df, cell_m, ("_x", "_y"))
    return with_lonlat(centred, "_x", "_y", zone=zone).drop("_x", "_y")


def _meets_cell(e: Column, x: Column, y: Column, cell_m: float) -> Column:
    """Whether a side enters the cell around (x, y): the cell is the overlap of three
    strips of width ``cell_m``, so the side is cut by the strips one after the other."""
    half = cell_m / 2
    lows, highs, apart = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for t in (0.0, math.pi / 3, 2 * math.pi / 3):
        ax, ay = math.cos(t), math.sin(t)
        start = (e["x1"] - x) * ax + (e["y1"] - y) * ay
        step = (e["x2"] - e["x1"]) * ax + (e["y2"] - e["y1"]) * ay
        a, b = F.try_divide(-half - start, step), F.try_divide(half - start, step)
        lows.append(F.least(a, b))
        highs.append(F.greatest(a, b))
        apart = apart | ((step == 0) & (F.abs(start) > half))
    return ~apart & (F.greatest(*lows) <= F.least(*highs))


def _cells_between(low: Column, high: Column, cell_m: float) -> Column:
    """Keys ``q`` in row ``r`` of all cells that reach between two places on it."""
    width = _radius(cell_m) * math.sqrt(3)
    return F.sequence(
        F.floor((low - width / 2) / width - F.col("r") / 2),
        F.ceil((high + width / 2) / width - F.col("r") / 2),
    )


def hex_grid(
    areas: DataFrame, cell_m: float, rings: str = "rings", zone: int = 16
) -> DataFrame:
    """Every cell that an area touches, with or without crashes, and the area's columns.

    Sides are rows. A side meets, in each grid row it reaches, the few cells around its part of that
    row. The line through the centres of a grid row crosses the outline at places that, in order,
    begin and end runs of cells inside. So no row carries an outline, and the work follows the sides
    and the cells that are found.
    """
    radius = _radius(cell_m)
    kept = checkpointed(areas.withColumn("_id", F.monotonically_increasing_id()))
    sides = kept.select("_id", F.explode(edges(project_rings(F.col(rings), zone))).alias("_side"))
    sides = sides.repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    e, step = F.col("_side"), 1.5 * radius
    south, north = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])

    met = sides.withColumn(
        "r", F.explode(F.sequence(F.floor((south - radius) / step), F.ceil((north + radius) / step)))
    )
    west, east = span_between(e, F.col("r") * step - radius, F.col("r") * step + radius)
    met = met.withColumn("q", F.explode(_cells_between(west, east, cell_m)))
    met = hex_center(met, cell_m, ("_cx", "_cy"))
    met = met.where(_meets_cell(e, F.col("_cx"), F.col("_cy"), cell_m)).select("_id", "q", "r")

    y = F.col("r") * step
    crossed = sides.withColumn("r", F.explode(F.sequence(F.floor(south / step), F.ceil(north / step))))
    crossed = crossed.where((e["y1"] > y) != (e["y2"] > y)).select(
        "_id", "r", (e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])).alias("_from")
    )
    along = Window.partitionBy("_id", "r").orderBy("_from")
    runs = crossed.withColumns({"_to": F.lead("_from").over(along), "_nth": F.row_number().over(along)})
    runs = runs.where((F.col("_nth") % 2 == 1) & (F.col("_from") < F.col("_to")))
    inside = runs.withColumn("q", F.explode(_cells_between(F.col("_from"), F.col("_to"), cell_m)))
    inside = hex_center(inside, cell_m, ("_cx", "_cy"))
    inside = inside.where((F.col("_cx") >= F.col("_from")) & (F.col("_cx") < F.col("_to")))
    cells = met.union(inside.select("_id", "q", "r")).distinct()
    columns = [c for c in areas.columns if c != rings]
    return kept.drop(rings).join(cells, "_id").select(*columns, "r", "q")


def complete_grid(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Every cell of the grid; a cell without a row in ``counts`` has nulls."""
    found = counts.withColumnsRenamed({"q": "_q", "r": "_r"})
    same = cells["q"].eqNullSafe(found["_q"]) & cells["r"].eqNullSafe(found["_r"])
    return cells.join(found, same, "left").drop("_q", "_r")


def hex_change(
    df: DataFrame,
    cell_m: float,
    month_end: int = 9,
    by: Iterable[str] = (),
    zone: int = 16,
) -> DataFrame:
    """Pedestrian crashes per cell in the last twelve months against the yearly average of
    the years before.

    Both periods are counted in one grouping, so a period without crashes is zero.
    """
    window = window_of(df, month_end)
    pedestrians = with_coordinates(df.where(F.col("vulnerable_role") == "Pedestrian"))
    tagged = with_hex(tag_periods(pedestrians, window), cell_m, zone=zone)
    counts = tagged.groupBy(*by, "q", "r").agg(
        F.count_if(F.col("period") == "prior").alias("prior"),
        F.count_if(F.col("period") == "lastyear").alias("lastyear"),
    )
    average = safe_div("prior", window["prior_years"])
    counts = counts.withColumns(
        {"total": F.col("prior") + F.col("lastyear"), "prioryearlyaverage": average}
    )
    change = F.col("lastyear") - F.col("prioryearlyaverage")
    return counts.withColumns(
        {
            "lastyearchangepercent": safe_div(change, "prioryearlyaverage"),
            "lastyearchangecrashes": change,
        }
    )


def hex_highlight(
    df: DataFrame, min_prior: int = 100, more: float = 5, fewer: float = -2
) -> DataFrame:
    """Busy cells whose last year differs clearly from the average."""
    change = F.col("lastyearchangecrashes")
    return df.where((F.col("prior") > min_prior) & ((change > more) | (change < fewer)))


def hex_event(
    df: DataFrame,
    cell_m: float,
    start: str = "10-01",
    split: str = "10-07",
    end: str = "10-14",
    city: str | None = None,
    min_age: float = 18,
    zone: int = 16,
) -> DataFrame:
    """Adult pedestrian crashes per cell in the first part of an event window against the
    second."""
    df = df.where((F.col("vulnerable_role") == "Pedestrian") & (F.col("ped_age") >= min_age))
    if city is not None:
        df = df.where(F.col("MUNINAME") == city)
    kept = event_window(with_coordinates(df), start, split, end)
    counts = (
        with_hex(kept, cell_m, zone=zone)
        .groupBy("q", "r")
        .agg(
            F.count_if(F.col("in_event")).alias("during"),
            F.count_if(~F.col("in_event")).alias("after"),
        )
    )
    return counts.withColumns(
        {
            "total": F.col("during") + F.col("after"),
            "change": F.col("during") - F.col("after"),
        }
    )


def cells_box(cells: DataFrame, cell_m: float, zone: int = 16) -> DataFrame:
    """One row: box around the corners of all cells, in degrees."""
    radius = _radius(cell_m)
    turns = [math.pi / 6 + k * math.pi / 3 for k in range(6)]
    corners = F.array(
        *[
            F.struct(
                F.lit(radius * math.cos(t)).alias("dx"), F.lit(radius * math.sin(t)).alias("dy")
            )
            for t in turns
        ]
    )
    points = hex_center(cells.select("q", "r"), cell_m, ("_x", "_y")).withColumn(
        "_c", F.explode(corners)
    )
    points = points.select(
        (F.col("_x") + F.col("_c")["dx"]).alias("x"), (F.col("_y") + F.col("_c")["dy"]).alias("y")
    )
    return with_lonlat(points, zone=zone).agg(
        F.min("longitude").alias("left"), F.min("latitude").alias("bottom"),
        F.max("longitude").alias("right"), F.max("latitude").alias("top"),
    )


def box_compare(df: DataFrame, box_condition: Column, codes: Iterable[str], month_end: int = 9):
    """One row: severe pedestrian crashes of a box in the last twelve months, and the
    yearly mean over the whole report window."""
    window = window_of(df, month_end)
    end, years = window["date_max"], window["prior_years"] + 1
    recent = F.col("date") > F.date_sub(end, 365)
    whole = F.col("date") > F.date_sub(end, years * 365)
    kept = df.where(
        box_condition
        & F.col("ped_inj").isin(list(codes))
        & (F.col("vulnerable_role") == "Pedestrian")
    )
    counts = kept.agg(F.count_if(recent).alias("lastyear"), F.count_if(whole).alias("_whole"))
    return counts.select("lastyear", safe_div("_whole", years).alias("yearly_mean"))
