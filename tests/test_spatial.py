"""Spatial joins against brute force, projections and hexes by their properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions import projection, rings
from kerbside.operators import filters, hexes, spatial

random.seed(7)
POINTS = [(i, random.uniform(-89, -87), random.uniform(42, 44)) for i in range(1500)]
# a third of all points at one place
POINTS += [(10_000 + i, -88.015, 43.015) for i in range(750)]
BOXES = [
    (i, x, y, x + w, y + h)
    for i, (x, y, w, h) in enumerate(
        (random.uniform(-89, -87.2), random.uniform(42, 43.8), random.choice([0.001, 0.02, 0.3, 1.7]),
         random.choice([0.002, 0.05, 0.4]))
        for _ in range(40)
    )
] + [(99, -88.015, 43.015, -88.0, 43.5)]  # the hot place is a corner


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, longitude double, latitude double").cache()


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame(BOXES, "box long, left double, bottom double, right double, top double").cache()


def brute_boxes():
    return sorted((b, i) for b, x0, y0, x1, y1 in BOXES for i, x, y in POINTS if x0 <= x <= x1 and y0 <= y <= y1)


@pytest.mark.parametrize("cell", [0.01, 0.5])
def test_points_in_boxes(points, boxes, cell):
    found = spatial.points_in_boxes(boxes, points, cell=cell)
    assert sorted((r["box"], r["id"]) for r in found.collect()) == brute_boxes()


@pytest.mark.parametrize("salt, least", [(1, 4), (200, 8)])
def test_shuffled_pairs_are_made_in_all_partitions(spark, points, boxes, monkeypatch, salt, least):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", 0)
    found = spatial.points_in_boxes(boxes, points, salt=salt)
    assert found.rdd.getNumPartitions() >= least


def test_points_in_boxes_by_shuffle(points, boxes, monkeypatch):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", -1)
    found = spatial.points_in_boxes(boxes, points, salt=5)
    assert "SortMergeJoin" in found._jdf.queryExecution().toString()
    assert sorted((r["box"], r["id"]) for r in found.collect()) == brute_boxes()


def parts_of(spark, n_points, n_areas):
    """Pairs per part of one cell, and all pairs, of a shuffled join beside 50 even cells."""
    cell = ["_level", "_cx", "_cy"]
    left = spark.range(n_points).selectExpr("'same' as what", "0 as _level", "0L as _cx", "0L as _cy")
    left = left.union(spark.range(50).selectExpr("'other'", "0", "id + 1", "0L"))
    areas = spark.range(n_areas).selectExpr("id as area", "0 as _level", "0L as _cx", "0L as _cy")
    areas = areas.union(spark.range(50).selectExpr("id", "0", "id + 1", "0L"))
    hot = spatial._hot_cells(left, areas, cell, spatial.SHARES).collect()
    joined = spatial._join_cells(left, areas, spatial.BROADCAST_BYTES + 1)
    return hot, joined


def test_hot_cells_are_cut_on_both_sides(spark):
    for n_points, n_areas in ((20_000, 5), (3, 30_000), (400, 300)):
        (cell,), joined = parts_of(spark, n_points, n_areas)
        assert 150 < cell["_across"] * cell["_down"] <= 260
        assert n_points * n_areas / cell["_across"] / cell["_down"] < n_points * n_areas / 100
        assert joined.count() == n_points * n_areas + 50
        assert joined.where("what = 'same'").select("area").distinct().count() == n_areas
        assert "_i" not in joined.columns and "_nth" not in joined.columns
    assert (cell["_across"], cell["_down"]) == (16, 13)  # as few copies as that many parts allow


def test_numbers_of_hot_rows_are_stored(spark):
    """Rows get their part from a checkpoint: nothing above it is computed again by a second run."""
    _, joined = parts_of(spark, 20_000, 5)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "LogicalRDD" in plan


def test_no_hot_cell(spark):
    left = spark.range(400).selectExpr("id", "0 as _level", "id as _cx", "0L as _cy")
    joined = spatial._join_cells(left, left.withColumnRenamed("id", "area"), spatial.BROADCAST_BYTES + 1)
    assert joined.count() == 400


def test_cells_of_an_area_are_bounded(boxes):
    levelled = spatial._with_level(boxes, spatial.BOX, 0.0001)
    most = spatial._cover(levelled, spatial.BOX, 0.0001).groupBy("box").count().agg(F.max("count")).first()[0]
    assert most <= (spatial.SPAN + 1) ** 2


def closed(*corners):
    return [{"x": x, "y": y} for x, y in (*corners, corners[0])]


POLYGONS = [
    ("triangle", [closed((-88.9, 42.1), (-87.1, 42.3), (-88.2, 43.9))]),
    ("ring", [closed((-88.5, 42.5), (-87.5, 42.5), (-87.5, 43.5), (-88.5, 43.5)),
              closed((-88.2, 42.8), (-87.8, 42.8), (-87.8, 43.2), (-88.2, 43.2))]),
    ("small", [closed((-88.016, 43.014), (-88.014, 43.014), (-88.014, 43.016), (-88.016, 43.016))]),
    ("corner", [closed((-88.015, 43.015), (-88.0, 43.015), (-88.0, 43.1))]),
    ("far", [closed((10.0, 10.0), (11.0, 10.0), (11.0, 11.0))]),
    ("star", [closed((-88.0, 43.9), (-88.3, 42.2), (-87.2, 43.2), (-88.8, 43.2), (-87.7, 42.2))]),
]


def inside(shape, x, y):
    odd = False
    for ring in shape:
        for a, b in zip(ring, ring[1:]):
            cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
            if cross == 0 and min(a["x"], b["x"]) <= x <= max(a["x"], b["x"]) and min(a["y"], b["y"]) <= y <= max(a["y"], b["y"]):
                return False
            if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]):
                odd = not odd
    return odd


def brute_polygons():
    return sorted((name, i) for name, shape in POLYGONS for i, x, y in POINTS if inside(shape, x, y))


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame(
        [(n, 1000 * (i + 1), s) for i, (n, s) in enumerate(POLYGONS)], f"name string, value int, rings {rings.RINGS_TYPE}"
    ).cache()


@pytest.mark.parametrize("cell,limit", [(0.01, 1 << 26), (0.3, 1 << 26), (0.05, -1)])
def test_points_in_polygons(points, polygons, cell, limit, monkeypatch):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", limit)
    found = spatial.points_in_polygons(polygons, points, "name", cell=cell)
    assert sorted((r["name"], r["id"]) for r in found.collect()) == brute_polygons()


def wavy(n, cx=-88.0, cy=43.0, spikes=0):
    """A closed outline of many corners, some of them spikes from the middle."""
    rng = random.Random(n)
    corners = []
    for i in range(n):
        a = 2 * math.pi * i / n
        r = 0.6 + 0.1 * math.sin(9 * a) + rng.uniform(-0.002, 0.002)
        corners.append((cx + r * math.cos(a), cy + r * math.sin(a)))
        if spikes and i % spikes == 0:
            corners += [(cx, cy), (cx + r * math.cos(a), cy + r * math.sin(a))]
    return closed(*corners)


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_cells_of_a_long_outline_hold_few_sides(spark, monkeypatch, limit):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", limit)
    shapes = [("wavy", [wavy(4000), wavy(300, -88.1, 43.1)[::-1]]), ("box", POLYGONS[1][1]),
              ("lattice", [closed((-88.0, 43.0), (-87.75, 43.0), (-87.75, 43.25), (-87.5, 43.25), (-87.5, 43.5), (-88.0, 43.5))])]
    shape_df = spark.createDataFrame(shapes, f"name string, rings {rings.RINGS_TYPE}")
    listing = spatial._polygon_cells(shape_df, "rings", 0.25)
    assert listing.cells.agg(F.max(F.size("_sides"))).first()[0] <= spatial.MAX_SIDES
    assert listing.cells.select("_level").distinct().count() > 2
    rng = random.Random(11)
    # corners of the outline and of the grid, and points on sides
    marks = [(p["x"], p["y"]) for p in shapes[0][1][0][::97]] + [(-88 + i / 8, 43 + j / 8) for i in range(5) for j in range(5)]
    marks += [(rng.uniform(-88.8, -87.2), rng.uniform(42.2, 43.8)) for _ in range(700)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "id long, longitude double, latitude double")
    found = spatial.points_in_polygons(shape_df, df, "name", cell=0.25)
    want = sorted((n, i) for n, shape in shapes for i, m in enumerate(marks) if inside(shape, *m))
    assert sorted((r["name"], r["id"]) for r in found.collect()) == want
    counts = {r["name"]: r["crash_count"] for r in spatial.area_counts(shape_df, df, "name", cell=0.25).collect()}
    assert counts == {n: sum(1 for m, _ in want if m == n) for n, _ in shapes}


def test_many_sides_in_one_corner(spark):
    """No halving separates them; the cell keeps them all and the answer stays right."""
    shape = [wavy(900, spikes=3)]
    shape_df = spark.createDataFrame([("spikes", shape)], f"name string, rings {rings.RINGS_TYPE}")
    rng = random.Random(12)
    marks = [(-88 + rng.gauss(0, 10.0 ** -rng.randint(1, 6)), 43 + rng.gauss(0, 10.0 ** -rng.randint(1, 6))) for _ in range(200)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "id long, longitude double, latitude double")
    found = spatial.points_in_polygons(shape_df, df, "name", cell=0.25)
    assert sorted(r["id"] for r in found.collect()) == [i for i, m in enumerate(marks) if inside(shape, *m)]


def test_columns_that_both_sides_have(points, polygons):
    named = points.withColumn("name", F.lit("point")).withColumn("value", F.lit("x"))
    found = spatial.points_in_polygons(polygons, named, "name")
    assert sorted((r["area_name"], r["id"]) for r in found.collect()) == brute_polygons()
    assert {r["name"] for r in found.select("name").distinct().collect()} == {"point"}
    left = spatial.points_in_polygons(polygons, named, "name", how="left")
    empty = {r["area_name"] for r in left.where("id is null and area_value is not null").collect()}
    assert empty == {n for n, _ in POLYGONS} - {n for n, _ in brute_polygons()}


def test_left_join_keeps_empty_polygons(points, polygons):
    found = spatial.points_in_polygons(polygons, points, "name", how="left")
    empty = {r["name"] for r in found.where("id is null").collect()}
    assert empty == {n for n, _ in POLYGONS} - {n for n, _ in brute_polygons()}
    assert found.where("id is not null").count() == len(brute_polygons())


@pytest.mark.parametrize("cell", [0.01, 0.07, 1.0])
def test_area_counts(points, polygons, cell):
    got = {r["name"]: r["crash_count"] for r in spatial.area_counts(polygons, points, "name", cell=cell).collect()}
    assert got == {n: sum(1 for m, _ in brute_polygons() if m == n) for n, _ in POLYGONS}


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_clip_lines_against_brute_force(spark, boxes, monkeypatch, limit):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", limit)
    boxes = boxes.withColumn("seg", F.lit("a name that the segments have too"))
    random.seed(3)
    segs = []
    for i in range(300):
        x, y = random.uniform(-89, -87), random.uniform(42, 44)
        length = random.choice([0.0, 0.003, 0.2, 3.0])
        segs.append((i, x, y, x + random.choice([0, 1, -1]) * length, y + random.choice([0, 0.5, -1]) * length))
    df = spark.createDataFrame(segs, "seg long, x1 double, y1 double, x2 double, y2 double")

    def clip(x1, y1, x2, y2, box):
        t0, t1 = 0.0, 1.0
        for start, delta, low, high in ((x1, x2 - x1, box[1], box[3]), (y1, y2 - y1, box[2], box[4])):
            if delta == 0:
                if start < low or start > high:
                    return None
                continue
            a, b = sorted(((low - start) / delta, (high - start) / delta))
            t0, t1 = max(t0, a), min(t1, b)
        return None if t0 > t1 else (x1 + t0 * (x2 - x1), y1 + t0 * (y2 - y1), x1 + t1 * (x2 - x1), y1 + t1 * (y2 - y1))

    want = {}
    for s, *line in segs:
        for box in BOXES:
            part = clip(*line, box)
            if part:
                want[(s, box[0])] = part
    rows = spatial.clip_lines(df, boxes, cell=0.01).collect()
    got = {(r["seg"], r["box"]): (r["cx1"], r["cy1"], r["cx2"], r["cy2"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_highway_does_not_pair_everything(spark, monkeypatch):
    """Short streets and small boxes beside one long segment: few candidates, one county each."""
    seen = []
    join = spatial._join_cells
    monkeypatch.setattr(spatial, "_join_cells", lambda *a: seen.append(join(*a)) or seen[-1])
    rng = random.Random(5)
    streets = []
    for i in range(4000):
        x, y = rng.uniform(-89, -87), rng.uniform(42, 44)
        streets.append((i, x, y, x + 0.002, y + 0.001, "Dane" if i % 2 else "Kent"))
    streets.append((9999, -89.0, 42.0, -87.0, 44.0, "Dane"))
    df = spark.createDataFrame(streets, "seg long, x1 double, y1 double, x2 double, y2 double, county_file string")
    boxes = spark.createDataFrame(
        [(b, x, y, x + 0.14, y + 0.14, "DANE") for b, (x, y) in
         enumerate((rng.uniform(-89, -87.2), rng.uniform(42, 43.8)) for _ in range(300))],
        "box long, left double, bottom double, right double, top double, COUNTY string",
    )
    by = (F.lower("county_file"), F.lower("COUNTY"))
    found = spatial.clip_lines(df, boxes, cell=0.01, by=by)
    n = found.count()
    held = boxes.collect()
    want = sum(
        1 for _, x1, y1, x2, y2, c in streets[:-1] if c == "Dane"
        for b in held if x1 <= b.right and x2 >= b.left and y1 <= b.top and y2 >= b.bottom
    )
    assert found.where("seg <> 9999").count() <= want and n > 2500
    assert seen[0].count() <= 2 * n


def test_segments(spark):
    path = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]
    df = spark.createDataFrame([(1, path), (2, path[:1])], "id int, path array<struct<x:double,y:double>>")
    got = sorted(tuple(r) for r in spatial.segments_of(df).collect())
    assert got == [(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 2.0)]


def test_box_sides_are_inside(spark):
    box = filters.Box(-88.0, 43.0, -87.0, 44.0)
    df = spark.createDataFrame([(-88.0, 43.5), (-87.0, 44.0), (-88.0001, 43.5), (None, 43.5)], "longitude double, latitude double")
    assert filters.in_box(df, box).count() == 2


def test_fill_holes(spark):
    def square(cx, cy, half_m):
        dy = half_m / 111320
        dx = dy / math.cos(math.radians(cy))
        return closed((cx - dx, cy - dy), (cx + dx, cy - dy), (cx + dx, cy + dy), (cx - dx, cy + dy))

    shape = [square(-88, 43, 5000), square(-88, 43, 400), square(-88.02, 43.02, 600), square(-87.5, 43.5, 100)]
    df = spark.createDataFrame([("a", shape)], f"name string, rings {rings.RINGS_TYPE}")
    kept = spatial.fill_holes(df).first()["rings"]
    # the 0.64 km2 hole goes, the 1.44 km2 hole and the small island stay
    assert [r[0]["x"] for r in kept] == [shape[i][0]["x"] for i in (0, 2, 3)]


def test_fill_holes_of_many_rings(spark):
    """Holes, islands in them and holes in those, beside a polygon that overlaps and one of one ring."""
    def square(cx, cy, half):
        return closed((cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half))

    many = [square(-88, 43, 0.5)]
    for i in range(12):
        for j in range(12):
            x, y = -88.44 + 0.08 * i, 42.56 + 0.08 * j
            many += [square(x, y, 0.004), square(x, y, 0.002), square(x, y, 0.001)]
    shapes = [("many", many), ("over", [square(-88, 43, 0.7), square(-88.04, 42.96, 0.003)]), ("one", [square(-88, 43, 0.001)]),
              ("none", []), ("null", None)]
    df = spark.createDataFrame(shapes, f"name string, rings {rings.RINGS_TYPE}")
    got = {r["name"]: r["rings"] for r in spatial.fill_holes(df).collect()}
    # rings 1 and 3 of each place lie in an odd number of others and are small; ring 2 is an island
    assert [r[0]["x"] for r in got["many"]] == [many[0][0]["x"], *(many[k][0]["x"] for k in range(2, len(many), 3))]
    assert len(got["over"]) == 1 and len(got["one"]) == 1 and got["none"] == [] and got["null"] is None


def test_only_polygons_with_a_small_ring_are_cut_into_cells(spark, monkeypatch):
    def square(cx, cy, half):
        return closed((cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half))

    shapes = [(f"large {i}", [square(-88, 43, 0.2), square(-88, 43, 0.1)]) for i in range(5)]
    shapes.append(("small", [square(-88, 43, 0.2), square(-88, 43, 0.001)]))
    asked, cells = [], spatial._polygon_cells
    monkeypatch.setattr(spatial, "_polygon_cells", lambda df, *more: asked.append(df.count()) or cells(df, *more))
    df = spark.createDataFrame(shapes, f"name string, rings {rings.RINGS_TYPE}")
    got = {r["name"]: len(r["rings"]) for r in spatial.fill_holes(df).collect()}
    assert got == {f"large {i}": 2 for i in range(5)} | {"small": 1}
    assert asked == [2]


def test_boxes_around_points_and_polygons(spark, polygons):
    df = spark.createDataFrame([(-88.0, 43.0)], "longitude double, latitude double")
    r = spatial.point_box(df, F.lit(1113.2)).first()
    assert r["top"] - 43.0 == pytest.approx(0.01) and -88.0 - r["left"] == pytest.approx(0.01 / math.cos(math.radians(43)))
    grown = {r["name"]: r for r in spatial.polygon_box(polygons, 1113.2).collect()}
    assert grown["ring"]["bottom"] == pytest.approx(42.49) and grown["ring"]["top"] == pytest.approx(43.51)
    sites = spatial.points_box(df, 500).first()
    assert sites["top"] - sites["bottom"] == pytest.approx(1000 / 111320)


def test_projection(spark, points):
    there = projection.with_utm(points)
    back = projection.with_lonlat(there, out=("lon2", "lat2"))
    worst = back.agg(F.max(F.abs(F.col("longitude") - F.col("lon2"))), F.max(F.abs(F.col("latitude") - F.col("lat2")))).first()
    assert max(worst) < 1e-9
    # on the central meridian: easting 500 km, northing = scale * meridian arc to 45 degrees
    df = spark.createDataFrame([(-87.0, 45.0)], "longitude double, latitude double")
    r = projection.with_utm(df).first()
    assert r["x"] == pytest.approx(500000) and r["y"] == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_every_point_is_in_its_hexagon(points):
    cell = 500
    placed = hexes.hex_center(hexes.hex_cell(projection.with_utm(points), cell), cell, ("cx", "cy"))
    for turn in range(3):
        c, s = math.cos(turn * math.pi / 3), math.sin(turn * math.pi / 3)
        off = F.abs((F.col("x") - F.col("cx")) * c + (F.col("y") - F.col("cy")) * s)
        assert placed.where(off > cell / 2 + 1e-6).count() == 0
    again = hexes.hex_cell(placed.select("q", "r", "cx", "cy").withColumnsRenamed({"q": "q0", "r": "r0"}), cell, "cx", "cy")
    assert again.where("q <> q0 or r <> r0").count() == 0


def test_hex_grid_covers_the_area(points, polygons):
    area = polygons.where("name = 'triangle'")
    cell = 8000
    grid = hexes.hex_grid(area, cell)
    assert grid.count() == grid.select("q", "r").distinct().count()
    within = spatial.points_in_polygons(area, points, "name")
    used = hexes.with_hex(within, cell).select("q", "r").distinct()
    assert used.join(grid, ["q", "r"], "left_anti").count() == 0
    # no cell is far outside: its centre is within one cell of the polygon's box
    box = hexes.cells_box(grid, cell).first()
    assert box["left"] > -88.9 - 0.25 and box["right"] < -87.1 + 0.25


def test_hex_grid_of_a_long_outline(spark):
    """Cells inside and on a wavy outline with a hole, against every cell around it."""
    hole = closed((-88.3, 42.9), (-87.9, 42.9), (-87.9, 43.2), (-88.3, 43.2))
    df = spark.createDataFrame([("a", [wavy(500), hole]), ("b", [hole])], f"name string, rings {rings.RINGS_TYPE}")
    cell = 4000
    grid = {(r["name"], r["q"], r["r"]) for r in hexes.hex_grid(df, cell).collect()}
    flat = df.select("name", projection.project_rings(F.col("rings")).alias("flat")).collect()
    plan = hexes.hex_grid(df, cell)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1
    want = set()
    for name, shape in flat:
        shape = [[{"x": p.x, "y": p.y} for p in ring] for ring in shape]
        xs, ys = zip(*((p["x"], p["y"]) for ring in shape for p in ring))
        radius = cell / math.sqrt(3)
        for r in range(int(min(ys) / radius / 1.5) - 2, int(max(ys) / radius / 1.5) + 3):
            for q in range(int(min(xs) / cell - r / 2) - 2, int(max(xs) / cell - r / 2) + 3):
                cx, cy = (q + r / 2) * cell, r * 1.5 * radius
                corner = [(cx + radius * math.sin(k * math.pi / 3), cy + radius * math.cos(k * math.pi / 3)) for k in range(6)]
                near = inside(shape, cx, cy) or any(
                    abs(p["x"] - cx) <= cell and abs(p["y"] - cy) <= cell
                    and all((p["x"] - cx) * math.cos(t) + (p["y"] - cy) * math.sin(t) <= cell / 2
                            and (p["x"] - cx) * math.cos(t) + (p["y"] - cy) * math.sin(t) >= -cell / 2
                            for t in (0, math.pi / 3, 2 * math.pi / 3))
                    for ring in shape for p in ring)
                if near or any(inside(shape, *c) for c in corner):
                    want.add((name, q, r))
    # cells that only the middle of a long side clips are in the grid alone
    assert want <= grid and len(grid - want) < 0.05 * len(grid)


def test_hex_change_totals(curated):
    rows = [{"ROLE1": "PED", "CRSHDATE": d, "LATDECDG": str(lat), "LONDECDG": "-88.0"}
            for d, lat in (("2020-05-01", 43.0), ("2021-05-01", 43.0), ("2022-11-01", 43.0), ("2023-05-01", 43.0),
                           ("2023-05-02", 43.9), ("2023-05-02", "bad"), ("2023-12-01", 43.0))]
    out = {r["prior"]: r for r in hexes.hex_change(curated(*rows), 3000).collect()}
    # window 2020-2023, two prior years; December 2023 is after the report month but still counts
    busy, new = out[1], out[0]
    assert (busy["lastyear"], busy["total"], busy["prioryearlyaverage"]) == (3, 4, 0.5)
    assert busy["lastyearchangepercent"] == 5.0 and busy["lastyearchangecrashes"] == 2.5
    assert new["lastyearchangepercent"] == math.inf
