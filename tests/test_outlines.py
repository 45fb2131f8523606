import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators.outlines import cell_polygons
from kerbside.sources.sinks import geojson_polygons

SCHEMA = "ix int, iy int, x double, y double, class int"


def lattice(spark, rows):
    """Cells of a picture, the first row at the bottom; step 0.5 in x, 0.25 in y."""
    cells = [
        (i, j, -88 + 0.5 * i, 43 + 0.25 * j, None if c == "." else int(c))
        for j, row in enumerate(rows) for i, c in enumerate(row)
    ]
    return spark.createDataFrame(cells, SCHEMA)


def area(ring):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:])) / 2


def parts(rows, c):
    """Groups of cells that touch in a side, and how many cells and holes each has."""
    cells = {(i, j) for j, row in enumerate(rows) for i, x in enumerate(row) if x == c}

    def flood(left, start, steps):
        todo, seen = [start], {start}
        while todo:
            i, j = todo.pop()
            for di, dj in steps:
                if (i + di, j + dj) in left and (i + di, j + dj) not in seen:
                    seen.add((i + di, j + dj))
                    todo.append((i + di, j + dj))
        return seen

    four = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    out = []
    while cells:
        own = flood(cells, min(cells), four)
        cells -= own
        rest = {(i, j) for i in range(-1, len(rows[0]) + 1) for j in range(-1, len(rows) + 1)} - own
        rest -= flood(rest, (-1, -1), eight)
        holes = 0
        while rest:
            rest -= flood(rest, min(rest), eight)
            holes += 1
        out.append((len(own), holes))
    return sorted(out)


def check(spark, rows):
    got = cell_polygons(lattice(spark, rows)).collect()
    for c in {x for row in rows for x in row} - {"."}:
        own = [r.rings for r in got if r["class"] == int(c)]
        found = [(round(sum(area(ring) for ring in rings) / 0.125), len(rings) - 1) for rings in own]
        assert sorted(found) == parts(rows, c)
        for rings in own:
            assert area(rings[0]) > 0 and all(area(hole) < 0 for hole in rings[1:])
            for ring in rings:
                assert ring[0] == ring[-1] and len(ring) >= 5
                ways = [(b.x != a.x, b.y != a.y) for a, b in zip(ring, ring[1:])]
                assert all(a != b and sum(a) == 1 for a, b in zip(ways, ways[1:]))


def test_square_and_its_coordinates(spark):
    rows = cell_polygons(lattice(spark, ["11", "11"])).collect()
    assert [[(p.x, p.y) for p in ring] for ring in rows[0].rings] == [
        [(-87.25, 42.875), (-87.25, 43.375), (-88.25, 43.375), (-88.25, 42.875), (-87.25, 42.875)]
    ]


def test_hole_island_corners_and_open_lattice(spark):
    check(spark, ["1111111", "1222221", "1211121", "1212121", "1211121", "1222221", "1111111"])
    check(spark, ["1.1", ".1.", "1.1"])
    check(spark, ["11111", "1.1.1", "11.11", "1.1.1", "11111"])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pictures(spark, seed):
    rng = random.Random(seed)
    check(spark, ["".join(rng.choice("1112.") for _ in range(14)) for _ in range(11)])


def test_empty_repeated_and_single(spark):
    assert cell_polygons(lattice(spark, [".."])).collect() == []
    twice = lattice(spark, ["12", "11"])
    same = [cell_polygons(df).orderBy("class").collect() for df in (twice, twice.union(twice))]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        cell_polygons(lattice(spark, ["1"]))


def test_as_geojson(spark):
    out = geojson_polygons(cell_polygons(lattice(spark, ["11", "12"])))
    kind = F.get_json_object("value", "$.geometry.type")
    assert [r.k for r in out.select(kind.alias("k")).collect()] == ["Polygon", "Polygon"]
