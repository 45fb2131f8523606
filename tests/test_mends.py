"""Cases that the sources and operators once got wrong."""

import datetime as dt
import json

from pyspark.sql import functions as F

from kerbside.operators import filters, reshape, spatial, trends
from kerbside.sources import exports, vector


def test_county_of_a_file_with_a_blank(spark, tmp_path):
    line = {"type": "Feature", "properties": {"LTS_F": "1"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}
    for county in ("FOND DU LAC", "ST. CROIX", "ROCK"):
        (tmp_path / f"bike_lts_{county}.geojson").write_text(json.dumps({"features": [line]}))
    found = {r["county_file"] for r in vector.read_lts(spark, str(tmp_path)).collect()}
    assert found == {"fond du lac", "st. croix", "rock"}


def test_kml_holes_and_many_geometries(spark, tmp_path):
    ring = lambda k: f"<LinearRing><coordinates>0,0 {k},0 {k},{k} 0,0</coordinates></LinearRing>"
    area = f"<Polygon><outerBoundaryIs>{ring(9)}</outerBoundaryIs><innerBoundaryIs>{ring(1)}</innerBoundaryIs></Polygon>"
    many = f"<MultiGeometry>{area}{area}<Point><coordinates>5,6</coordinates></Point></MultiGeometry>"
    marks = f"<Placemark><name>a</name>{area}</Placemark><Placemark><name>b</name>{many}</Placemark>"
    (tmp_path / "x.kml").write_text(f"<kml><Document>{marks}</Document></kml>")
    found = {r["name"]: r for r in vector.read_kml(spark, str(tmp_path / "x.kml")).collect()}
    assert len(found["a"]["rings"]) == 2 and len(found["b"]["rings"]) == 4
    assert found["b"]["points"][0]["x"] == 5.0 and found["a"]["points"] is None


def test_geojson_collections_and_multi_points(spark, tmp_path):
    parts = [{"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "Point", "coordinates": [5, 6]}]
    feature = {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": parts}}
    (tmp_path / "x.geojson").write_text(json.dumps({"features": [feature]}))
    found = {r["type"]: r for r in vector.read_geojson(spark, str(tmp_path / "x.geojson")).collect()}
    assert len(found["MultiPoint"]["points"]) == 2 and found["Point"]["lon"] == 5.0


def test_empty_collections_keep_their_feature(spark, tmp_path):
    empty = {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "GeometryCollection", "geometries": []}}
    none = {"type": "Feature", "properties": {"n": 2}, "geometry": None}
    (tmp_path / "x.geojson").write_text(json.dumps({"features": [empty, none]}))
    rows = vector.read_geojson(spark, str(tmp_path / "x.geojson")).collect()
    assert [(r["properties"]["n"], r["type"], r["rings"], r["points"]) for r in rows] == [
        ("1", "GeometryCollection", None, None), ("2", None, None, None)]


def test_kml_nested_geometries_and_rings(spark, tmp_path):
    ring = lambda k: f"<LinearRing><coordinates>0,0 {k},0 {k},{k} 0,0</coordinates></LinearRing>"
    area = f"<Polygon><outerBoundaryIs>{ring(9)}</outerBoundaryIs></Polygon>"
    line = "<LineString><coordinates>1,2 3,4</coordinates></LineString>"
    inner = f"<MultiGeometry>{area}{line}{ring(3)}<MultiGeometry>{area}{line}</MultiGeometry></MultiGeometry>"
    marks = f"<Placemark><name>a</name><MultiGeometry>{inner}{inner}{line}</MultiGeometry></Placemark>"
    marks += f"<Placemark><name>b</name>{ring(5)}</Placemark><Placemark><name>c</name></Placemark>"
    (tmp_path / "x.kml").write_text(f"<kml><Document>{marks}</Document></kml>")
    found = {r["name"]: r for r in vector.read_kml(spark, str(tmp_path / "x.kml")).collect()}
    assert len(found["a"]["rings"]) == 6 and len(found["a"]["paths"]) == 5 and found["a"]["points"] is None
    assert found["b"]["rings"][0][1]["x"] == 5.0 and found["c"]["rings"] is None


def test_headers_are_read_in_one_job(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"crash-data-download_20{i:02}.csv").write_text(f"A,B{i % 2}\n{i},x\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    layouts = exports._layouts(spark, str(tmp_path), exports.EXPORT_PATTERN)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert sorted(map(len, layouts.values())) == [6, 6] and len(jobs) <= 4
    assert exports.read_exports(spark, str(tmp_path)).count() == 12


def test_shuffled_join_takes_any_columns(spark, monkeypatch):
    points = spark.createDataFrame([(1, {"a": "b"}, 1, 0, 0)] * 40, "id int, p map<string,string>, _level int, _cx int, _cy int")
    listed = spark.createDataFrame([(7, 1, 0, 0)], "area int, _level int, _cx int, _cy int")
    for limit in (0, 1 << 26):
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", limit)
        assert spatial._join_cells(points, listed, 1000, 4).count() == 40
    big = spark.range(1).select(F.map_from_arrays(F.array(F.lit("k")), F.array(F.repeat(F.lit("x"), 100_000))).alias("p"))
    assert big.select(spatial._row_bytes(big)).first()[0] > 100_000


def test_severity_order_with_a_map(spark):
    df = spark.createDataFrame([(2, {"a": 1}), (None, {}), (1, {})], "severity_rank int, p map<string,int>")
    assert [r["severity_rank"] for r in filters.by_severity(df).collect()] == [1, 2, None]


def test_widen_takes_the_largest(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 3)], "id string, k string, v int")
    assert reshape.widen(df, ["id"], "k", "v", ["x"]).first()["x"] == 3


def test_flagged_dates(spark):
    days = spark.createDataFrame([(dt.date(2020, 10, 31),)] * 2, "day date")
    df = spark.createDataFrame([(1, dt.date(2020, 10, 31)), (2, dt.date(2020, 11, 1)), (3, None)], "id int, date date")
    assert {r["id"]: r["trickortreat"] for r in trends.flag_dates(df, days).collect()} == {1: True, 2: False, 3: False}
