"""Counts in areas go through finer cells and make no pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.functions.rings import RINGS_TYPE
from kerbside.operators import schools, spatial

rng = random.Random(11)
POINTS = [(i, round(rng.uniform(0, 1), 3), round(rng.uniform(0, 1), 3), rng.choice(["a", "b", None])) for i in range(3000)]
# a crowd in one spot, and one place many times
POINTS += [(10_000 + i, 0.5 + rng.random() / 500, 0.5 + rng.random() / 500, "a") for i in range(800)]
POINTS += [(20_000 + i, 0.25, 0.25, "b") for i in range(50)]


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


SHAPES = {
    "all": [square(-1, -1, 3)],
    "hole": [square(0.1, 0.1, 0.8), square(0.3, 0.3, 0.4)],
    "kite": [[(0.2, 0.5), (0.5, 0.1), (0.83, 0.47), (0.52, 0.91), (0.2, 0.5)]],
    "thin": [square(0.4, 0.501, 0.3, 0.0007)],
    "edge": [square(0.25, 0.25, 0.125)],
    "crossed": [[(0.1, 0.1), (0.9, 0.9), (0.9, 0.1), (0.1, 0.9), (0.1, 0.1)]],
    "away": [square(5, 5, 1)],
}


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, longitude double, latitude double, kind string").cache()


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in SHAPES.items()]
    return spark.createDataFrame(rows, "name string, rings array<array<struct<x:double,y:double>>>").cache()


def is_inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            across = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if across == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                odd = not odd
    return odd


@pytest.mark.parametrize("most", [1, 64])
def test_counts_in_polygons(spark, points, shapes, monkeypatch, most):
    monkeypatch.setattr(spatial, "MAX_PLACES", most)
    monkeypatch.setattr(spatial, "MAX_HALVINGS", 4)
    out = spatial.area_counts(shapes, points, "name", cell=0.05)
    got = {r["name"]: r["crash_count"] for r in out.collect()}
    assert got == {k: sum(is_inside(v, x, y) for _, x, y, _ in POINTS) for k, v in SHAPES.items()}


@pytest.mark.parametrize("most", [1, 64])
def test_counts_in_boxes(spark, points, monkeypatch, most):
    monkeypatch.setattr(spatial, "MAX_BOX_PLACES", most)
    monkeypatch.setattr(spatial, "MAX_HALVINGS", 4)
    boxes = [(f"s{i % 25}", x, y, x + w, y + w) for i, (x, y, w) in enumerate(
        (round(rng.uniform(0, 1), 3), round(rng.uniform(0, 1), 3), rng.choice([0.0, 0.01, 0.2])) for _ in range(30)
    )] + [("spot", 0.25, 0.25, 0.25, 0.25), (None, 0.0, 0.0, 1.0, 1.0), ("lost", None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "name string, left double, bottom double, right double, top double")
    out = spatial.box_counts(df, points, "name", ("kind",), cell=0.05)
    want = {}
    for name, x0, y0, x1, y1 in boxes:
        for _, x, y, kind in POINTS:
            if x0 is not None and x0 <= x <= x1 and y0 <= y <= y1:
                want[name, kind] = want.get((name, kind), 0) + 1
    assert {(r["name"], r["kind"]): r["count"] for r in out.collect()} == want


def pairs_tested(monkeypatch, kind, run):
    """Rows that reach the tests of single places."""
    seen = []
    real = kind.where
    monkeypatch.setattr(kind, "where", lambda df, c: (seen.append(df), real(df, c))[1])
    run()
    return [df for df in seen if "_cut" in df.columns and "_n" in df.columns][-1]


def test_crowded_borders_are_met_in_finer_cells(spark, monkeypatch):
    """Sixteen times the places make about four times the pairs on a border; in cells of the grid all
    57,600 places of its 36 border cells would be met."""
    one = [("q", [[{"x": float(x), "y": float(y)} for x, y in square(0.103, 0.107, 0.8)]])]
    shape = spark.createDataFrame(one, "name string, rings array<array<struct<x:double,y:double>>>")
    met = []
    for side in (100, 400):
        grid = spark.range(side * side).select(
            ((F.col("id") % side + 0.5) / side).alias("longitude"),
            ((F.floor(F.col("id") / side) + 0.5) / side).alias("latitude"),
        )
        df = pairs_tested(monkeypatch, type(grid), lambda: spatial.area_counts(shape, grid, "name", cell=0.1))
        met.append(df.where("_cut").count())
        monkeypatch.undo()
    assert met[1] < 8 * met[0] and met[1] < 10_000, met


def test_polygons_without_points_store_no_pairs(spark, points, shapes, monkeypatch):
    stored = []
    real = spatial.checkpointed
    monkeypatch.setattr(spatial, "checkpointed", lambda df: (stored.append(df.columns), real(df))[1])
    found = spatial.points_in_polygons(shapes, points, "name", how="left", cell=0.05)
    got = sorted((r["name"], r["id"] or -1) for r in found.select("name", "id").collect())
    want = sorted((k, i or -1) for k, v in SHAPES.items() for i, x, y, _ in POINTS if is_inside(v, x, y))
    assert got == sorted([*want, ("away", -1)])
    assert not any("id" in columns for columns in stored)


def test_school_crash_counts_equal_the_pairs(spark, curated):
    rows = [
        {"LATDECDG": str(43 + i / 1000), "LONDECDG": "-88.0", "ROLE1": "PED", "AGE1": "9", "INJSVR1": "KA"[i % 2]}
        for i in range(30)
    ]
    near = spark.createDataFrame([("1", -88.1, 42.9, -87.9, 43.01), ("2", -88.0, 43.01, -87.0, 44.0)],
                                 "NCES_CODE string, left double, bottom double, right double, top double")
    crashes = curated(*rows)
    want = schools.school_crashes(near, crashes).groupBy("NCES_CODE", "ped_inj_name").count()
    got = schools.school_crash_counts(near, crashes)
    assert got.columns == ["NCES_CODE", "ped_inj_name", "count"]
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_lone_sides_are_plain_columns(spark):
    ring = [(0.001, 0.002), (0.09, 0.013), (0.04, 0.08), (0.001, 0.002)]
    shape = spark.createDataFrame([("a", [ring])], f"name string, rings {RINGS_TYPE}")
    cells = spatial._polygon_cells(shape, "rings", 0.01).cells.collect()
    assert {len(c._sides) for c in cells if c._sx1 is None and c._cut} <= {2, 3}
    assert {len(c._sides) for c in cells if c._sx1 is not None} == {0}
    assert sum(c._sx1 is not None for c in cells) > sum(c._cut for c in cells) / 2
