"""Lattice cells as polygons: closed rings with holes, in the coordinates of the nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.lineage import checkpointed, shared_path

#: Directions of a side, counter-clockwise.
EAST, NORTH, WEST, SOUTH = range(4)


def cell_polygons(df: DataFrame, by: str = "class") -> DataFrame:
    """The cells of each class joined up to polygons: ``by``, ``rings`` (outline, then holes).

    ``df`` has ``ix, iy`` (whole numbers from 0 to 2**29), their coordinates ``x, y`` on an even
    lattice, and the class. A cell reaches half a step around its node. Cells that touch in a side are one
    polygon, cells that only touch in a corner are two. Rings are arrays of ``x, y``, closed, with a
    vertex only where they turn: outlines counter-clockwise, holes clockwise. Cells without a
    class, and those that repeat, make no difference. An empty table has no polygons.

    Sides are rows that know the side that follows them. The ring of each, and its place there, come from
    pointer doubling, so the rounds grow with the logarithm of the longest ring. A hole belongs to
    the ring that opens the run of cells left of its leftmost side, or to the one which that belongs to.
    """
    cells = df.where(F.col(by).isNotNull() & F.col("ix").isNotNull() & F.col("iy").isNotNull())
    span = cells.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("ix", "iy", "x", "y") for f in (F.min, F.max)]).first()
    sides = _followed(_sides(cells.select(by, "ix", "iy").distinct(), by), by)
    ringed = _ranked(_ringed(sides, by), by)
    home = _homes(ringed, by)

    def at(axis: str, corner: Column) -> Column:
        first, last = span[f"min_i{axis}"], span[f"max_i{axis}"]
        if first is None:
            return corner.cast("double")
        if first == last:
            raise ValueError(f"one node along {axis}: the size of a cell is not known")
        low = span[f"min_{axis}"]
        return F.lit(low) + (corner - first - 0.5) * ((span[f"max_{axis}"] - low) / (last - first))

    point = F.struct(at("x", F.col("ex")).alias("x"), at("y", F.col("ey")).alias("y"))
    corners = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), point.alias("p"))))
    rings = ringed.where("turns").groupBy(by, "ring").agg(F.transform(corners, lambda c: c["p"]).alias("p"))
    rings = rings.join(home, [by, "ring"])
    closed = F.concat("p", F.slice("p", 1, 1)).alias("points")
    parts = F.array_sort(F.collect_list(F.struct("hole", "ring", closed)))
    return rings.groupBy(by, "home").agg(F.transform(parts, lambda r: r["points"]).alias("rings")).drop("home")


def _sides(cells: DataFrame, by: str) -> DataFrame:
    """Sides between a cell and one of another class, the cell on the left: lower corner ``x, y``, ``way``,
    start ``sx, sy``, end ``ex, ey`` and ``id``, which is unique in a class."""

    def side(dx: int, dy: int, way: int) -> Column:
        return F.struct(
            (F.col("ix") + dx).cast("long").alias("x"), (F.col("iy") + dy).cast("long").alias("y"),
            F.lit(way % 2).alias("upright"), F.lit(way).alias("way"),
        )

    four = F.array(side(0, 0, EAST), side(1, 0, NORTH), side(0, 1, WEST), side(0, 0, SOUTH))
    sides = cells.select(by, F.explode(four).alias("s")).select(by, "s.*")
    sides = sides.groupBy(by, "x", "y", "upright").agg(F.count(F.lit(1)).alias("n"), F.min("way").alias("way"))
    way = F.col("way")
    sides = sides.where("n = 1").select(
        by, "x", "y", "way",
        (F.col("x") + (way == WEST).cast("int")).alias("sx"), (F.col("y") + (way == SOUTH).cast("int")).alias("sy"),
        (F.col("x") + (way == EAST).cast("int")).alias("ex"), (F.col("y") + (way == NORTH).cast("int")).alias("ey"),
    )
    number = F.shiftleft("sx", 32).bitwiseOR(F.shiftleft("sy", 2)).bitwiseOR(F.col("way").cast("long"))
    return checkpointed(sides.withColumn("id", number))


def _followed(sides: DataFrame, by: str) -> DataFrame:
    """With ``next``, the side that follows, and ``turns``. Where two start, the one on the left follows: it
    is a side of the same cell."""
    onward = sides.select(by, F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.struct("id", "way").alias("to"))
    best = F.min_by("to", F.pmod(F.col("to.way") - F.col("way") - 1, F.lit(4))).alias("to")
    chosen = sides.join(onward, [by, "ex", "ey"]).groupBy(by, "id").agg(best)
    found = sides.join(chosen, [by, "id"]).withColumn("next", F.col("to.id"))
    return checkpointed(found.withColumn("turns", F.col("to.way") != F.col("way")).drop("to"))


def _ringed(sides: DataFrame, by: str) -> DataFrame:
    """With ``ring``, the smallest id of the side's ring."""
    state = sides.select(by, "id", "next", F.col("id").alias("low"), F.lit(True).alias("fell"))
    while True:
        ahead = state.select(by, F.col("id").alias("next"), F.col("next").alias("further"), F.col("low").alias("theirs"))
        state = checkpointed(
            state.join(ahead, [by, "next"]).select(
                by, "id", F.col("further").alias("next"), F.least("low", "theirs").alias("low"),
                (F.col("theirs") < F.col("low")).alias("fell"),
            )
        )
        # spans that double: if no side learned of a smaller one, all spans of a ring agree
        if state.where("fell").isEmpty():
            return sides.join(state.select(by, "id", F.col("low").alias("ring")), [by, "id"])


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. A checkpoint keeps what the plan knew of partitioning, and with two
    names for each key that doubles every round."""
    path = shared_path(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _ranked(sides: DataFrame, by: str) -> DataFrame:
    """With ``left``, how many sides there are from here to the end of the ring."""
    last = F.col("next") == F.col("ring")
    sides = checkpointed(sides)
    state = sides.select(by, "id", F.when(~last, F.col("next")).alias("to"), F.lit(1).cast("long").alias("left"))
    while not state.where("to is not null").isEmpty():
        ahead = state.select(by, F.col("id").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        state = _written(
            state.join(ahead, [by, "to"], "left").select(
                by, "id", F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")
            )
        )
    return checkpointed(sides.join(state.select(by, "id", "left"), [by, "id"]))


def _homes(sides: DataFrame, by: str) -> DataFrame:
    """``hole`` and ``home`` (the outline it belongs to) of each ring."""
    area = F.sum(F.when(F.col("way") == NORTH, F.col("x")).when(F.col("way") == SOUTH, -F.col("x")).otherwise(0))
    row = Window.partitionBy(by, "y").orderBy("x")
    upright = sides.where(F.col("way").isin(NORTH, SOUTH)).withColumn("opened", F.lag("ring").over(row))
    rings = upright.groupBy(by, "ring").agg(
        (area < 0).alias("hole"), F.min_by("opened", F.struct("x", "y")).alias("opened")
    )
    up = F.when(F.col("hole"), F.col("opened")).otherwise(F.col("ring"))
    state = checkpointed(rings.select(by, "ring", "hole", up.alias("home")))
    while True:
        above = state.select(by, F.col("ring").alias("home"), F.col("home").alias("higher"))
        after = checkpointed(
            state.join(above, [by, "home"]).select(
                by, "ring", "hole", F.col("higher").alias("home"), (F.col("home") != F.col("higher")).alias("rose")
            )
        )
        state = after.drop("rose")
        if after.where("rose").isEmpty():
            return state
