"""Spatial joins as equi-joins on grid cells.

An area is listed under every grid cell its box touches; a point has exactly one cell per
level, so each pair meets once. The cell size doubles with the level, and an area takes the
lowest level at which its box spans at most ``SPAN`` cells per side. So an area of any size
has at most ``(SPAN + 1) ** 2`` rows, without a cap on size or partners, and points are
listed once per level that some area uses (usually one).

The areas are used several times (levels, extent, cells), so they are checkpointed: boxes computed
from a large table cost one pass over it. What the listed cells take is measured before the join.
Up to ``BROADCAST_BYTES`` the list is broadcast and the points are not shuffled. Above that the join
is a sort-merge join, in which cells with much work (points times areas) are cut on both sides: into
parts of their points and parts of their areas, and every part of the one meets every part of the
other once. Rows of such cells get their part from a stored number, so a task that is run again
deals them out alike, and equal rows are spread too.

A polygon's cell holds only the sides that enter it, and the parity of its south-east corner. From
there a path along the cell's border and then west leads to any point in the cell, and only sides
that enter the cell can cross it. A cell with more than ``MAX_SIDES`` is cut into four, and these
again; where a side ends up, and the parity of a new corner, follows from each side alone, so an
outline of any length is spread over all tasks as rows.

Counts need no pairs. Only the border of an area meets single places; cells inside it add the total of
all their places. A cell on the border is cut into four as often as its places ask for, in one pass and
without storing anything. So an area's work grows with the root of the number of places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.config import METRES_PER_DEGREE
from kerbside.functions.projection import project_rings
from kerbside.functions.rings import (
    crossings_odd,
    edges,
    envelope,
    is_non_empty,
    on_side,
    ring_area,
    span_between,
    touches,
)
from kerbside.operators.lineage import checkpointed

SPAN = 16
BROADCAST_BYTES = 64 * 1024 * 1024
#: All work is this many shares; a cell with more than one is cut into parts of about one share.
SHARES = 200
#: Sides of a polygon that a cell holds at most, if ``MAX_SPLITS`` halvings get there (many sides
#: can meet in one corner).
MAX_SIDES = 32
MAX_SPLITS = 12
#: Counts go into finer cells until a cell has about this many places or was halved ``MAX_HALVINGS`` times.
#: A place is tested against a box much faster than against sides.
MAX_PLACES = 16
MAX_BOX_PLACES = 256
MAX_HALVINGS = 12
#: A side counts as entering a cell if it comes this near (part of the cell's size), so that
#: rounding leaves out none.
SLACK = 1e-6
BOX = ("left", "bottom", "right", "top")
_CELL = ["_level", "_cx", "_cy"]
_SIDE = "struct<x1:double,y1:double,x2:double,y2:double>"
_ENDS = ("_sx1", "_sy1", "_sx2", "_sy2")


def _level(size: Column, cell: float) -> Column:
    return F.when(size > cell * SPAN, F.ceil(F.log2(size / (cell * SPAN)))).otherwise(0).cast("int")


def _size_of(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level)


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size)


def _with_level(df: DataFrame, box: tuple[str, str, str, str], cell: float) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return df.withColumn("_level", _level(F.greatest(x1 - x0, y1 - y0), cell)).where(
        x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    )


def _spread(df: DataFrame, *key: str) -> DataFrame:
    """A short table over all tasks (by ``key``), before each of its rows becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _cover(df: DataFrame, box: tuple[str, str, str, str], cell: float) -> DataFrame:
    """One row per cell of the row's own ``_level`` that its box touches."""
    df = _spread(df)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    size = _size_of(F.col("_level"), cell)
    across = F.sequence(_cell(x0, size), _cell(x1, size))
    up = F.sequence(_cell(y0, size), _cell(y1, size))
    return df.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(up))


def _levels_of(df: DataFrame) -> Column:
    return df.agg(F.collect_set("_level")).scalar()


def _n_cells(box: tuple[str, str, str, str], size: Column) -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in box)
    return (_cell(x1, size) - _cell(x0, size) + 1) * (_cell(y1, size) - _cell(y0, size) + 1)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, generously: 64 for each, and the length of its texts. Arrays, maps
    and structs count eight bytes for each character of their text form, more than an
    element takes."""
    sizes = []
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"))
        elif "<" in kind:
            sizes.append(8 * F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long"))
    return reduce(lambda a, b: a + b, sizes, F.lit(64 * (len(df.columns) + len(_CELL))).cast("long"))


def _hot_cells(left: DataFrame, listed: DataFrame, key: list[str], salt: int) -> DataFrame:
    """Cells with more than one ``salt``-th of all pairs, so fewer than that many, and into how
    many parts their points (``_across``) and their areas (``_down``) are cut. The parts have about
    the same work, and as few copies of rows as that allows."""
    points = left.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("_points"))
    areas = listed.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("_areas"))
    work = points.join(areas, key).withColumn("_work", F.col("_points") * F.col("_areas"))
    work = checkpointed(work)
    total = work.agg(F.sum("_work")).scalar()
    parts = F.ceil(F.col("_work") * salt / total)
    across = F.greatest(F.lit(1.0), F.round(F.sqrt(parts * F.col("_points") / F.col("_areas"))))
    across = F.least(across, F.col("_points"), parts)
    down = F.least(F.ceil(parts / F.col("_across")), F.col("_areas"))
    hot = work.where(F.col("_work") * salt > total).withColumn("_across", across.cast("int"))
    return hot.withColumn("_down", down.cast("int")).select(*key, "_across", "_down")


def _numbered(df: DataFrame, hot: DataFrame, key: list[str]) -> DataFrame:
    """The rows in hot cells with a number, stored: reading them again gives the same numbers."""
    return checkpointed(
        df.join(F.broadcast(hot), key).withColumn("_nth", F.monotonically_increasing_id())
    )


def _join_cells(
    left: DataFrame, listed: DataFrame, size: int, salt: int = SHARES, more: tuple[str, ...] = ()
) -> DataFrame:
    """Join on the cell (and ``more``) with a list of at most ``size`` bytes.

    Few bytes make many pairs, so shuffled partitions are not put together by their bytes."""
    key = [*_CELL, *more]
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(listed), key)
    hot = checkpointed(_hot_cells(left, listed, key, salt))
    if hot.isEmpty():
        return left.join(_spread(listed, *key).hint("merge"), key)
    places = {"_i": "_across", "_j": "_down"}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own part, once for every part of the other side."""
        all_parts = F.sequence(F.lit(0), F.col(places[other]) - 1)
        rows = _numbered(df, hot, key).withColumn(own, F.pmod("_nth", places[own]).cast("int"))
        return rows.withColumn(other, F.explode(all_parts)).drop("_nth", *places.values())

    cells = F.broadcast(hot.select(*key))
    cold = left.join(cells, key, "left_anti").join(
        _spread(listed.join(cells, key, "left_anti"), *key).hint("merge"), key
    )
    split = dealt(left, "_i", "_j").join(
        _spread(dealt(listed, "_j", "_i"), *key, *places).hint("merge"), [*key, *places]
    )
    return cold.unionByName(split.drop(*places))


class _Listing(NamedTuple):
    """Areas, and the grid cells each is listed under."""

    areas: DataFrame  # one row per area, with its _level and box
    cells: DataFrame  # one row per area and cell
    size: int  # bytes of ``cells`` at most
    box: tuple[str, str, str, str]
    cell: float


def _apart(areas: DataFrame, points: DataFrame) -> dict[str, str]:
    """New names for columns of the areas that the points have too."""
    return {c: f"area_{c}" for c in areas.columns if c in points.columns}


def _near(points: DataFrame, listing: _Listing, lon: str, lat: str) -> DataFrame:
    """Points in the box around all areas, each under its cell at every level in use."""
    box, size = listing.box, _size_of(F.col("_level"), listing.cell)
    around = listing.areas.agg(
        F.struct(
            F.min(box[0]).alias("x0"), F.min(box[1]).alias("y0"),
            F.max(box[2]).alias("x1"), F.max(box[3]).alias("y1"),
        )
    ).scalar()
    near = points.where(
        F.col(lon).between(around["x0"], around["x1"])
        & F.col(lat).between(around["y0"], around["y1"])
    )
    return near.withColumn("_level", F.explode(_levels_of(listing.cells))).withColumns(
        {"_cx": _cell(F.col(lon), size), "_cy": _cell(F.col(lat), size)}
    )


def _meet(
    points: DataFrame, listing: _Listing, lon: str, lat: str, salt: int
) -> DataFrame:
    """Pairs of an area's cell row and a point in that cell."""
    return _join_cells(_near(points, listing, lon, lat), listing.cells, listing.size, salt)


def points_in_boxes(
    boxes: DataFrame,
    points: DataFrame,
    box: tuple[str, str, str, str] = BOX,
    lon: str = "longitude",
    lat: str = "latitude",
    cell: float = 0.01,
    salt: int = SHARES,
) -> DataFrame:
    """Every (box, point) pair with the point in the box, all sides included.

    ``cell`` (in the units of the coordinates) is best near the usual box size / 4. Columns of the
    boxes that the points have too are renamed (``area_`` in front).
    """
    names = _apart(boxes, points)
    boxes, box = boxes.withColumnsRenamed(names), tuple(names.get(c, c) for c in box)
    areas = checkpointed(_with_level(boxes, box, cell))
    cells = _cover(areas, box, cell)
    n_cells = _n_cells(box, _size_of(F.col("_level"), cell))
    size = areas.agg(F.sum(n_cells * _row_bytes(areas))).first()[0] or 0
    pairs = _meet(points, _Listing(areas, cells, size, box, cell), lon, lat, salt)
    return pairs.where(
        F.col(lon).between(F.col(box[0]), F.col(box[2]))
        & F.col(lat).between(F.col(box[1]), F.col(box[3]))
    ).drop(*_CELL)


def _rows_of(low: Column, high: Column, size: Column) -> Column:
    """Grid rows (or columns) from ``low`` to ``high``."""
    return F.sequence(_cell(low - size * SLACK, size), _cell(high + size * SLACK, size))


def _east_of(e: Column, x: Column, y: Column, border: Column) -> Column:
    """Whether a side passes east of ``x`` at height ``y``; a side that is not at that height counts
    by its nearest corner, whether that is east of ``border``.

    With the corner instead, two neighbouring sides count alike wherever their corner lies. So from
    one height to another the parity changes by what the sides give at both, and only sides that
    cross the border in between give anything."""
    at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"])
    spans = (e["y1"] > y) != (e["y2"] > y)
    upward = e["y1"] <= e["y2"]
    nearest = F.when((e["y1"] > y) == upward, e["x1"]).otherwise(e["x2"])
    return F.when(spans, x < at).otherwise(nearest > border)


def _lone() -> dict[str, Column]:
    """The lone side of a cell, null if it has none or several."""
    return {c[2:]: F.col(c) for c in _ENDS}


def _lone_or(of_lone: Column, of_all: Column) -> Column:
    """``of_lone`` where a cell has a lone side, else ``of_all``. Most cut cells hold one side, and an expression on
    plain columns takes a tenth of the time of a lambda over an array."""
    return F.when(F.col("_sx1").isNotNull(), of_lone).otherwise(of_all)


def _parity(base: Column, passes: Callable) -> Column:
    """``base`` turned over by every side of the cell that ``passes``."""
    return _lone_or(base != passes(_lone()), F.aggregate("_sides", base, lambda odd, e: odd != passes(e)))


def _touched(x: Column, y: Column) -> Column:
    """Whether the point lies on a side of the cell."""
    return _lone_or(touches(_lone(), x, y), on_side(F.col("_sides"), x, y))


def _apart_if_lone(cells: DataFrame) -> DataFrame:
    """Cells whose array of ``_sides`` has one keep it as plain columns instead."""
    one = F.size("_sides") == 1
    flat = {f"_s{k}": F.when(one, F.get("_sides", F.lit(0))[k]).otherwise(c) for k, c in _lone().items()}
    return cells.withColumns(flat | {"_sides": F.when(one, _no_sides()).otherwise(F.col("_sides"))})


def _no_sides() -> Column:
    return F.array().cast(f"array<{_SIDE}>")


def _borders(cell: float) -> dict[str, Column]:
    size = _size_of(F.col("_level"), cell)
    return {
        "_west": F.col("_cx") * size, "_east": (F.col("_cx") + 1) * size,
        "_south": F.col("_cy") * size, "_north": (F.col("_cy") + 1) * size,
    }


def _cell_sides(areas: DataFrame, box, rings: str, cell: float) -> DataFrame:
    """Rows ``_id, _level, _cx, _cy, _odd, _side`` for the cells of all polygons: the sides that enter
    a cell, and rows without a side. The parity of the cell's south-east corner, the number of
    sides east of it at its height, is that of its rows that are ``_odd``."""
    size = _size_of(F.col("_level"), cell)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    first, last = _cell(x0, size), _cell(x1, size)
    shape = {"_first": first, "_last": last, "_size": size}
    e, s = F.col("_side"), F.col("_size")
    south, north = F.col("_cy") * s, (F.col("_cy") + 1) * s
    sides = (
        _spread(areas.select("_id", "_level", *box, rings).withColumns(shape))
        .withColumn("_side", F.explode(edges(F.col(rings))))
        .drop(rings)
        .withColumn("_cy", F.explode(_rows_of(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]), s)))
    )
    # one bit for each of the few columns of a polygon: whether the side is east of the corner
    at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (south - e["y1"]), e["y2"] - e["y1"])
    bits = F.aggregate(
        F.sequence(F.col("_first"), F.col("_last")),
        F.lit(0).cast("long"),
        lambda acc, c: acc * 2 + F.when((c + 1) * s < at, 1).otherwise(0),
    )
    crossing = sides.where((e["y1"] > south) != (e["y2"] > south))
    keys = ["_id", "_level", "_first", "_last", "_cy"]
    lines = areas.select("_id", "_level", *box).withColumns(shape)
    lines = lines.withColumn("_cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))
    lines = lines.select(*keys, F.lit(0).cast("long").alias("_bits"))
    lines = lines.union(crossing.select(*keys, bits.alias("_bits")))
    lines = lines.groupBy(*keys).agg(F.bit_xor("_bits").alias("_bits"))
    each = lines.withColumn("_cx", F.explode(F.sequence("_first", "_last")))
    odd = F.expr("shiftright(_bits, cast(_last - _cx as int)) & 1") == 1
    none = F.lit(None).cast(_SIDE).alias("_side")
    corners = each.select("_id", *_CELL, odd.alias("_odd"), none)

    west, east = span_between(e, south, north)
    entered = sides.withColumn("_cx", F.explode(_rows_of(west, east, s)))
    entered = entered.where(F.col("_cx").between(F.col("_first"), F.col("_last")))
    entered = entered.where(F.col("_cy").between(_cell(y0, s), _cell(y1, s)))
    return corners.union(entered.select("_id", *_CELL, F.lit(False), "_side"))


def _quarters(rows: DataFrame, cell: float) -> DataFrame:
    """The same rows for the four quarters of their cells."""
    e = F.col("_side")
    old = rows.withColumns({"_border": _borders(cell)["_east"], "_height": _borders(cell)["_south"]})
    quarters = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    new = old.withColumn("_q", F.explode(quarters)).withColumns(
        {
            "_level": F.col("_level") - 1,
            "_cx": F.col("_cx") * 2 + F.col("_q.i"),
            "_cy": F.col("_cy") * 2 + F.col("_q.j"),
        }
    )
    to = new.withColumns(_borders(cell))
    # from the old corner to the new one
    there = _east_of(e, F.col("_east"), F.col("_south"), F.col("_border"))
    here = _east_of(e, F.col("_border"), F.col("_height"), F.col("_border"))
    odd = F.when(e.isNull(), F.col("_odd")).otherwise(F.col("_odd") != (there != here))
    slack = (F.col("_east") - F.col("_west")) * SLACK
    south, north = F.col("_south") - slack, F.col("_north") + slack
    west, east = span_between(e, south, north)
    enters = (
        (F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= north)
        & (east >= F.col("_west") - slack) & (west <= F.col("_east") + slack)
    )
    to = to.withColumns({"_odd": odd, "_side": F.when(enters, e)})
    return to.where(F.col("_odd") | F.col("_side").isNotNull()).select("_id", *_CELL, "_odd", "_side")


def _polygon_cells(polygons: DataFrame, rings: str, cell: float) -> _Listing:
    """Cells of each polygon. A cell that no side enters (not ``_cut``) is wholly inside, or
    is left out. A cut cell carries the sides that enter it (``_sides``), and the parity from
    which these lead to a point (``_base``)."""
    shapes = polygons.where(is_non_empty(F.col(rings)))
    boxed = shapes.withColumns({f"_{k}": c for k, c in envelope(F.col(rings)).items()})
    box = ("_x0", "_y0", "_x1", "_y1")
    levelled = _with_level(boxed, box, cell).withColumn("_id", F.monotonically_increasing_id())
    areas = checkpointed(levelled)
    most = areas.agg(F.max(F.size(F.flatten(rings)))).first()[0] or 0
    rows, key = _cell_sides(areas, box, rings, cell), ["_id", *_CELL]
    done = []
    for _ in range(MAX_SPLITS if most > MAX_SIDES else 0):
        rows = checkpointed(rows)
        full = rows.groupBy(*key).agg(F.count("_side").alias("_n")).where(F.col("_n") > MAX_SIDES)
        full = checkpointed(full.select(*key))
        if full.isEmpty():
            break
        done.append(rows.join(full, key, "left_anti"))
        rows = _quarters(rows.join(full, key, "left_semi"), cell)
    rows = reduce(lambda a, b: a.union(b), done, rows)

    cells = rows.groupBy(*key).agg(
        F.bit_xor(F.col("_odd").cast("int")).alias("_base"), F.collect_list("_side").alias("_sides")
    )
    cells = cells.withColumn("_cut", F.size("_sides") > 0).where("_cut or _base = 1")
    borders = _borders(cell)
    cells = cells.withColumns({"_east": borders["_east"], "_south": borders["_south"]})
    corner = F.aggregate(
        F.col("_sides"),
        F.col("_base") == 1,
        lambda odd, e: odd != _east_of(e, F.col("_east"), F.col("_south"), F.col("_east")),
    )
    cells = cells.withColumn("_base", corner).drop("_south")
    cells = _apart_if_lone(cells.withColumns({c: F.lit(None).cast("double") for c in _ENDS}))
    cells = cells.join(areas.drop(rings, "_level", *box), "_id")
    cells = checkpointed(cells.drop("_id"))
    plain = cells.drop("_sides")
    row_bytes = _row_bytes(plain) + 64 * F.size("_sides")
    size = cells.agg(F.sum(row_bytes)).first()[0] or 0
    return _Listing(areas, cells, size, box, cell)


def _is_odd(lon: str, lat: str) -> Column:
    """Parity of the sides east of a point, by the sides of its cell alone."""
    x, y, border = F.col(lon), F.col(lat), F.col("_east")
    odd = _parity(F.col("_base"), lambda e: _east_of(e, x, y, border))
    return F.when(F.col("_cut"), odd).otherwise(True)


def _is_inside(lon: str, lat: str) -> Column:
    """Strictly inside, by the sides of the cell alone."""
    there = _touched(F.col(lon), F.col(lat))
    return _is_odd(lon, lat) & ~(F.col("_cut") & there)


def points_in_polygons(
    polygons: DataFrame,
    points: DataFrame,
    key: str,
    how: str = "inner",
    rings: str = "rings",
    lon: str = "longitude",
    lat: str = "latitude",
    cell: float = 0.01,
    salt: int = SHARES,
) -> DataFrame:
    """Every (polygon, point) pair with the point strictly inside.

    Points in a cell wholly inside need no test; the others are tested against the few sides
    in their cell, not the whole outline. ``how="left"`` also keeps polygons without a
    point (``key`` identifies a polygon); which these are comes from counts, so no pairs are stored.
    Columns of the polygons that the points have too are renamed (``area_`` in front).
    """
    names = _apart(polygons, points)
    polygons = polygons.withColumnsRenamed(names)
    key, rings = names.get(key, key), names.get(rings, rings)
    listing = _polygon_cells(polygons, rings, cell)
    pairs = _meet(points, listing, lon, lat, salt)
    found = pairs.where(_is_inside(lon, lat)).drop(
        "_sides", *_ENDS, "_cut", "_base", "_east", *_CELL
    )
    if how == "inner":
        return found
    counted = area_counts(polygons, points, key, rings, lon, lat, "_n_points", cell)
    empty = counted.where("_n_points = 0").drop("_n_points")
    return found.unionByName(empty, allowMissingColumns=True)


def area_counts(
    polygons: DataFrame,
    points: DataFrame,
    key: str,
    rings: str = "rings",
    lon: str = "longitude",
    lat: str = "latitude",
    out: str = "crash_count",
    cell: float = 0.01,
) -> DataFrame:
    """Number of points inside each polygon, zero for a polygon without one.

    Points at one place are counted together first. A cell wholly inside a polygon adds the
    cell's total, and cut cells are cut on until they hold few places (see ``_totals``).
    """
    own = polygons.select(F.col(key).alias("_key"), F.col(rings).alias("_rings"))
    listing = _polygon_cells(own, "_rings", cell)
    cells = listing.cells.select("_key", *_CELL, "_cut", "_base", "_sides", *_ENDS)
    places = points.groupBy(lon, lat).agg(F.count(F.lit(1)).alias("_n"))
    inside = _is_odd(lon, lat) & ~_touched(F.col(lon), F.col(lat))
    sums = _totals(cells, listing, places, lon, lat, _polygon_quarter, inside, MAX_PLACES)
    totals = sums.withColumnRenamed("_n", "_total")
    counted = polygons.drop(rings).join(totals, polygons[key].eqNullSafe(totals["_key"]), "left")
    return counted.withColumn(out, F.coalesce("_total", F.lit(0))).drop("_key", "_total")


def box_counts(
    boxes: DataFrame,
    points: DataFrame,
    key: str,
    by: tuple[str, ...] = (),
    box: tuple[str, str, str, str] = BOX,
    lon: str = "longitude",
    lat: str = "latitude",
    out: str = "count",
    cell: float = 0.01,
) -> DataFrame:
    """Number of points in the boxes of each ``key`` and per ``by`` (columns of the points), all sides
    included; combinations without a point have no row."""
    sides = ("_x0", "_y0", "_x1", "_y1")
    own = boxes.select(F.col(key).alias("_key"), *[F.col(c).alias(s) for c, s in zip(box, sides)])
    areas = checkpointed(_with_level(own, sides, cell))
    listed = _cover(areas, sides, cell)
    # every cell starts as cut: one that is inside the box is found so at its first quarters
    cells = listed.select("_key", *_CELL, F.lit(True).alias("_cut"), *sides)
    # its size is not used: counting broadcasts nothing
    listing = _Listing(areas, cells, 0, sides, cell)
    groups = {f"_by{i}": c for i, c in enumerate(by)}
    named = points.select(lon, lat, *[F.col(c).alias(name) for name, c in groups.items()])
    places = named.groupBy(lon, lat, *groups).agg(F.count(F.lit(1)).alias("_n"))
    inside = F.col(lon).between(F.col(sides[0]), F.col(sides[2]))
    inside &= F.col(lat).between(F.col(sides[1]), F.col(sides[3]))
    sums = _totals(cells, listing, places, lon, lat, _box_quarter(sides), inside, MAX_BOX_PLACES, tuple(groups))
    return sums.withColumnsRenamed({"_key": key, **groups, "_n": out}).select(key, *by, out)


def _totals(cells, listing: _Listing, places, lon: str, lat: str, quarter, inside: Column, most: int, by=()) -> DataFrame:
    """Sum of ``_n`` of the places in each area, per ``_key`` and ``by``.

    ``cells`` are the cells of the areas; those that are ``_cut`` have places in and outside. ``quarter``
    makes the columns of quarters (see ``_halved``), with ``_met``: whether the area is there at all.
    """
    cell, top = listing.cell, ["_top", "_tx", "_ty"]
    own = dict(zip(_CELL, top))
    near = _near(places, listing, lon, lat).withColumnsRenamed(own)
    halvings = F.ceil(F.log(4.0, F.count(F.lit(1)) / most))
    halvings = F.least(F.greatest(halvings, F.lit(0)), F.lit(MAX_HALVINGS)).cast("int")
    depths = checkpointed(near.groupBy(*top).agg(halvings.alias("_depth")))
    deepest = depths.agg(F.max("_depth")).first()[0] or 0

    pieces = cells.withColumns({new: F.col(old) for old, new in own.items()}).join(depths, top).drop("_tx", "_ty")
    pieces = _spread(pieces) if deepest else pieces
    kept = pieces.columns
    pieces = pieces.withColumn("_met", F.lit(True))
    for _ in range(deepest):
        pieces = quarter(_halved(pieces, cell)).select(*kept, "_met")
    # an explode, as a filter would have the last step's columns made twice
    pieces = pieces.withColumn("_q", F.explode(F.array_repeat(F.lit(0), F.col("_met").cast("int")))).select(*kept)

    size = _size_of(F.col("_level"), cell)
    leaves = near.join(depths, top).withColumn("_level", F.col("_top") - F.col("_depth")).withColumns(
        {"_cx": _cell(F.col(lon), size), "_cy": _cell(F.col(lat), size)}
    )
    single = leaves.select("_top", *_CELL, F.lit(True).alias("_cut"), lon, lat, *by, "_n")
    sums = leaves.groupBy("_top", "_depth", *_CELL, *by).agg(F.sum("_n").alias("_n"))
    up = sums.withColumn("_up", F.explode(F.sequence(F.lit(0), "_depth")))
    wider = F.pow(F.lit(2.0), F.col("_up"))
    up = up.withColumns(
        {
            "_level": (F.col("_level") + F.col("_up")).cast("int"),
            "_cx": F.floor(F.col("_cx") / wider), "_cy": F.floor(F.col("_cy") / wider),
        }
    )
    sums = up.groupBy("_top", *_CELL, *by).agg(F.sum("_n").alias("_n"))
    none = [F.lit(None).cast("double").alias(c) for c in (lon, lat)]
    sums = sums.select("_top", *_CELL, F.lit(False).alias("_cut"), *none, *by, "_n")
    # few bytes make many pairs here, so partitions are not put together by their bytes
    key = ["_top", *_CELL, "_cut"]
    east = _borders(cell)["_east"]  # once a cell, not once a place
    pieces = _spread(pieces.withColumn("_east", east).drop("_depth"), *key)
    met = pieces.join(single.union(sums), key)
    return met.where(~F.col("_cut") | inside).groupBy("_key", *by).agg(F.sum("_n").alias("_n"))


def _halved(pieces: DataFrame, cell: float) -> DataFrame:
    """The quarters (``_q`` from 0) of cells to be cut, other cells as they are (``_q`` -1); without cells
    the area does not meet. Borders and the old east border are columns, so each is computed once."""
    more = F.when(F.col("_cut") & (F.col("_depth") > 0), F.array(*[F.lit(q) for q in range(4)]))
    parts = F.when(F.col("_met"), more.otherwise(F.array(F.lit(-1)))).otherwise(F.array().cast("array<int>"))
    rows = pieces.withColumn("_border", _borders(cell)["_east"]).withColumn("_q", F.explode(parts))
    split, q = F.col("_q") >= 0, F.col("_q")
    rows = rows.withColumns(
        {
            "_level": F.when(split, F.col("_level") - 1).otherwise(F.col("_level")).cast("int"),
            "_cx": F.when(split, F.col("_cx") * 2 + q % 2).otherwise(F.col("_cx")),
            "_cy": F.when(split, F.col("_cy") * 2 + F.floor(q / 2)).otherwise(F.col("_cy")),
            "_depth": F.when(split, F.col("_depth") - 1).otherwise(F.col("_depth")),
        }
    )
    rows = rows.withColumn("_size", _size_of(F.col("_level"), cell))
    size, x, y = F.col("_size"), F.col("_cx"), F.col("_cy")
    rows = rows.withColumns(
        {"_west": x * size, "_east": (x + 1) * size, "_south": y * size, "_north": (y + 1) * size}
    )
    slack = size * SLACK
    return rows.withColumns(
        {
            "_from_x": F.col("_west") - slack, "_to_x": F.col("_east") + slack,
            "_from_y": F.col("_south") - slack, "_to_y": F.col("_north") + slack,
        }
    )


def _polygon_quarter(rows: DataFrame) -> DataFrame:
    """As in ``_quarters``, for a cell that holds its sides as an array, or a lone one as columns."""
    split, old, sides = F.col("_q") >= 0, F.col("_base"), F.col("_sides")
    east, south, border = F.col("_east"), F.col("_south"), F.col("_border")
    low, high = F.col("_from_y"), F.col("_to_y")

    def enters(e) -> Column:
        first, last = span_between(e, low, high)
        return (
            (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high)
            & (last >= F.col("_from_x")) & (first <= F.col("_to_x"))
        )

    corner = _parity(old, lambda e: _east_of(e, east, south, border))
    rows = rows.withColumns(
        {
            "_base": F.when(split, corner).otherwise(old),
            "_sides": F.when(split & (F.size(sides) > 0), F.filter(sides, enters)).otherwise(sides),
            "_stays": ~split | enters(_lone()),
        }
    )
    rows = _apart_if_lone(rows.withColumns({c: F.when(F.col("_stays"), F.col(c)) for c in _ENDS}))
    base = _parity(old, lambda e: _east_of(e, east, south, east))
    cut = F.when(split, (F.size(sides) > 0) | F.col("_sx1").isNotNull()).otherwise(F.col("_cut"))
    rows = rows.withColumns({"_base": F.when(split, base).otherwise(old), "_cut": cut})
    return rows.withColumn("_met", F.col("_cut") | F.col("_base"))


def _is_within(box: tuple[str, str, str, str]) -> Column:
    """Whether a cell, a little larger on all sides, is inside a box."""
    left, bottom, right, top = (F.col(c) for c in box)
    return (
        (F.col("_from_x") >= left) & (F.col("_to_x") <= right)
        & (F.col("_from_y") >= bottom) & (F.col("_to_y") <= top)
    )


def _box_quarter(box: tuple[str, str, str, str]):
    left, bottom, right, top = (F.col(c) for c in box)
    apart = (F.col("_from_x") > right) | (F.col("_to_x") < left)
    apart |= (F.col("_from_y") > top) | (F.col("_to_y") < bottom)
    return lambda rows: rows.withColumns({"_cut": F.col("_cut") & ~_is_within(box), "_met": ~apart})


def segments_of(lines: DataFrame, path: str = "path") -> DataFrame:
    """One row per straight piece ``(x1, y1, x2, y2)`` of a line given as an array of
    points."""
    p = F.col(path)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    pieces = F.zip_with(
        F.slice(p, 1, n),
        F.slice(p, 2, n),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )
    return lines.withColumn("_s", F.explode(pieces)).select("*", "_s.*").drop("_s", path)


def _clip_range(df: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
    """Part ``_t0`` to ``_t1`` of the segment inside the box (Liang-Barsky); rows without
    such a part are dropped."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    left, bottom, right, top = (F.col(c) for c in box)
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for delta, start, low, high in (
        (dx, F.col("x1"), left, right),
        (dy, F.col("y1"), bottom, top),
    ):
        a, b = F.try_divide(low - start, delta), F.try_divide(high - start, delta)
        # a segment parallel to this axis has no limits from it, or lies outside
        enter.append(F.least(a, b))
        leave.append(F.greatest(a, b))
        outside = outside | ((delta == 0) & ((start < low) | (start > high)))
    return (
        df.where(~outside)
        .withColumns({"_t0": F.greatest(*enter), "_t1": F.least(*leave)})
        .where(F.col("_t0") <= F.col("_t1"))
    )


def _pieces(size: Column) -> Column:
    """The cells a segment passes, in order, as ``_cx, _cy`` and the part ``from`` to ``to`` of the
    segment in each. Together the parts are 0 to 1."""

    def crossings(a: Column, b: Column) -> Column:
        lines = F.sequence(_cell(F.least(a, b), size) + 1, _cell(F.greatest(a, b), size))
        lines = F.when(_cell(F.least(a, b), size) < _cell(F.greatest(a, b), size), lines)
        at = F.transform(lines, lambda k: F.try_divide(k * size - a, b - a))
        return F.coalesce(at, F.array().cast("array<double>"))

    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cuts = F.concat(crossings(x1, x2), crossings(y1, y2))
    cuts = F.filter(cuts, lambda t: (t > 0) & (t < 1))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
    n = F.size(cuts) - 1
    return F.zip_with(
        F.slice(cuts, 1, n),
        F.slice(cuts, 2, n),
        lambda a, b: F.struct(
            _cell(x1 + (x2 - x1) * (a + b) / 2, size).alias("_cx"),
            _cell(y1 + (y2 - y1) * (a + b) / 2, size).alias("_cy"),
            a.alias("_from"),
            b.alias("_to"),
        ),
    )


def clip_lines(
    segments: DataFrame,
    boxes: DataFrame,
    box: tuple[str, str, str, str] = BOX,
    cell: float = 0.01,
    salt: int = SHARES,
    by: tuple[Column, Column] | None = None,
) -> DataFrame:
    """The part of every segment inside every box it meets, as ``cx1, cy1, cx2, cy2``.

    A box is listed at its own level, under the few cells it touches. A segment is cut at the grid
    lines of each level that some box has, so it is listed only under cells it passes, however long
    it is: a highway meets the boxes along it and lifts nothing else to its own size. A pair counts
    in the one cell in which the segment's part inside the box begins. ``by`` are a column of the
    segments and one of the boxes that must be equal; they are part of the join key. Columns of the
    boxes that the segments have too are renamed (``area_`` in front).
    """
    names = _apart(boxes, segments)
    if by is not None:
        segments, boxes = segments.withColumn("_by", by[0]), boxes.withColumn("_by", by[1])
    else:
        segments, boxes = segments.withColumn("_by", F.lit(0)), boxes.withColumn("_by", F.lit(0))
    boxes, box = boxes.withColumnsRenamed(names), tuple(names.get(c, c) for c in box)
    areas = checkpointed(_with_level(boxes, box, cell))
    size = _size_of(F.col("_level"), cell)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    listed = _spread(areas).withColumns(
        {"_cx": F.explode(_rows_of(x0, x1, size))}
    ).withColumn("_cy", F.explode(_rows_of(y0, y1, size)))
    most = (SPAN + 2) ** 2
    bound = areas.agg(F.sum(F.least(_n_cells(box, size) * 2 + 4, F.lit(most)) * _row_bytes(areas)))
    whole = segments.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    along = whole.withColumn("_level", F.explode(_levels_of(areas)))
    along = along.withColumn("_piece", F.explode(_pieces(size))).select("*", "_piece.*").drop("_piece")
    pairs = _join_cells(along, listed, bound.first()[0] or 0, salt, ("_by",))
    begins = F.col("_t0") == F.col("_from")
    begins |= (F.col("_t0") > F.col("_from")) & (F.col("_t0") < F.col("_to"))
    begins |= (F.col("_to") == 1) & (F.col("_t0") == 1)
    clipped = _clip_range(pairs, box).where(begins)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return clipped.withColumns(
        {
            "cx1": F.col("x1") + F.col("_t0") * dx, "cy1": F.col("y1") + F.col("_t0") * dy,
            "cx2": F.col("x1") + F.col("_t1") * dx, "cy2": F.col("y1") + F.col("_t1") * dy,
        }
    ).drop("_t0", "_t1", "_from", "_to", "_by", *_CELL)


def point_box(
    df: DataFrame, metres: Column, lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """Box of all places within ``metres`` of a point."""
    up = metres / METRES_PER_DEGREE
    across = up / F.cos(F.radians(F.col(lat)))
    return df.withColumns(
        {
            "left": F.col(lon) - across,
            "bottom": F.col(lat) - up,
            "right": F.col(lon) + across,
            "top": F.col(lat) + up,
        }
    )


def _grow(df: DataFrame, metres: float) -> DataFrame:
    up = metres / METRES_PER_DEGREE
    edge = F.greatest(F.abs("bottom"), F.abs("top"))
    across = up / F.cos(F.radians(edge))
    return df.withColumns(
        {
            "left": F.col("left") - across,
            "bottom": F.col("bottom") - up,
            "right": F.col("right") + across,
            "top": F.col("top") + up,
        }
    )


def polygon_box(polygons: DataFrame, metres: float, rings: str = "rings") -> DataFrame:
    """Box of each polygon, grown by ``metres`` on every side."""
    found = envelope(F.col(rings))
    return _grow(
        polygons.withColumns(dict(zip(BOX, (found["x0"], found["y0"], found["x1"], found["y1"])))),
        metres,
    )


def points_box(
    points: DataFrame, metres: float = 0, lon: str = "longitude", lat: str = "latitude",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Box around all points (per ``by``), grown by ``metres``."""
    return _grow(extent(points, by, lon, lat), metres)


def extent(
    df: DataFrame, by: tuple[str, ...] = (), lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """Smallest box around the points of each group."""
    return df.groupBy(*by).agg(
        F.min(lon).alias("left"), F.min(lat).alias("bottom"),
        F.max(lon).alias("right"), F.max(lat).alias("top"),
    )


def fill_holes(
    polygons: DataFrame, km2: float = 1.0, rings: str = "rings", zone: int = 16, cell: float = 0.01
) -> DataFrame:
    """Remove inner rings smaller than ``km2``. A ring is an inner one if its first corner
    lies inside an odd number of the polygon's other rings; so an island in a hole is none, and a
    hole in that island is one.

    Rings are rows: the first corners of the small ones meet the grid cells of the rings of their own
    polygon, so the work follows the sides, not rings times sides. Polygons of one ring, and those without
    a small one, lose none and are not looked at."""
    shapes = checkpointed(_spread(polygons).withColumn("_owner", F.monotonically_increasing_id()))
    parts = shapes.where(F.size(rings) > 1).select("_owner", F.posexplode(rings).alias("_nth", "_ring"))
    size = ring_area(project_rings(F.array("_ring"), zone)[0])
    small = parts.where(size < km2 * 1e6).select(
        "_owner", F.col("_nth").alias("_small"),
        F.col("_ring")[0]["x"].alias("_px"), F.col("_ring")[0]["y"].alias("_py"),
    )
    small = checkpointed(small)
    asked = parts.join(small.select("_owner").distinct(), "_owner", "left_semi")
    listing = _polygon_cells(asked.select("_owner", "_nth", F.array("_ring").alias("_rings")), "_rings", cell)
    near = _near(small, listing, "_px", "_py")
    pairs = _join_cells(near, listing.cells, listing.size, SHARES, ("_owner",))
    around = pairs.where((F.col("_nth") != F.col("_small")) & _is_odd("_px", "_py"))
    inner = around.groupBy("_owner", "_small").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    gone = inner.groupBy("_owner").agg(F.collect_set("_small").alias("_gone"))
    kept = F.filter(F.col(rings), lambda r, i: ~F.array_contains("_gone", i))
    out = shapes.join(gone, "_owner", "left")
    filled = F.when(F.col("_gone").isNull(), F.col(rings)).otherwise(kept)
    return out.withColumn(rings, filled).select(*polygons.columns)


def non_empty(df: DataFrame, rings: str = "rings") -> DataFrame:
    return df.where(is_non_empty(F.col(rings)))
