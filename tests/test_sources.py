"""Readers, writers, run configuration and whole runs on temporary files."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from kerbside.config import RunConfig
from kerbside.operators import schools
from kerbside.operators.curate import curate
from kerbside.operators.filters import (
    focus,
    in_counties,
    placed_schools,
    severity_in,
    valid_schools,
    youth,
)
from kerbside.operators.layers import map_columns, point_labels, school_labels
from kerbside.operators.summaries import all_summaries
from kerbside.plans import maps, runs
from kerbside.sources import exports, sinks, tables, vector


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "exports"
    d.mkdir()
    (d / "crash-data-download_2022.csv").write_text(
        "DOCTNMBR,CRSHDATE,CNTYNAME,ROLE1,INJSVR1,AGE1,LATDECDG,LONDECDG\n"
        '1,2022-01-02,DANE,PED,K,9,43.07,-89.4\n2,2022-02-03, ROCK ,NA,"",x,,\n'
    )
    (d / "crash-data-download_2023.csv").write_text(  # other order, one column more
        "CNTYNAME,DOCTNMBR,EXTRA,CRSHDATE,ROLE1,INJSVR1,AGE1,LATDECDG,LONDECDG\n"
        "DANE,3,e,2023-05-06,BIKE,A,40,43.08,-89.41\n"
    )
    (d / "crash-data-download_2024.csv").write_text(
        "DOCTNMBR,CRSHDATE,CNTYNAME,ROLE1,INJSVR1,AGE1,LATDECDG,LONDECDG\n4,2024-05-06,DANE,PED,B,12,43.0,-89.0\n"
    )
    (d / "other.csv").write_text("DOCTNMBR\n99\n")
    os.utime(d / "crash-data-download_2023.csv", (1_700_000_000, 1_700_000_000))
    return str(d)


def test_exports_are_matched_by_name(spark, folder):
    df = exports.read_exports(spark, folder)
    got = {r["DOCTNMBR"]: r for r in df.collect()}
    assert sorted(got) == ["1", "2", "3", "4"]
    assert got["3"]["CNTYNAME"] == "DANE" and got["3"]["EXTRA"] == "e" and got["1"]["EXTRA"] is None
    assert got["2"]["CNTYNAME"] == "ROCK" and got["2"]["ROLE1"] is None and got["2"]["INJSVR1"] is None
    assert got["3"]["retreive_date"].timestamp() == 1_700_000_000
    years = {r[0] for r in df.select(exports.file_year()).collect()}
    assert years == {"2022", "2023", "2024"}
    # two layouts, so two scans whatever the number of files
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


@pytest.mark.parametrize("name", ["with blank x", "a+b", "50% off", "[odd] {set}", "é ü"])
def test_odd_names(spark, tmp_path, name):
    d = tmp_path / name
    d.mkdir()
    (d / f"crash-data-download_2020 {name}.csv").write_text("A,B\n1,2\n")
    (d / f"crash-data-download_2021 {name}.csv").write_text("B,A\n4,3\n")
    (d / "crash-data-download_2022.csv").write_text("")
    rows = exports.read_exports(spark, exports._literal(str(d))).collect()
    assert sorted((r["A"], r["B"]) for r in rows) == [("1", "2"), ("3", "4")]
    assert {r["file_name"] for r in rows} == {f"crash-data-download_{y} {name}.csv" for y in (2020, 2021)}


def test_a_header_costs_the_head_of_its_file(spark, tmp_path):
    for k, n in enumerate((1, 400_000)):
        (tmp_path / f"crash-data-download_{k}.csv").write_text("DOCTNMBR,CNTYNAME\n" + "12345678,DANE\n" * n)
    found = exports.headers(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 2
    assert [r["header"] for r in found.collect()] == ["DOCTNMBR,CNTYNAME"] * 2
    assert exports.read_exports(spark, str(tmp_path)).count() == 400_001


def test_headers_of_large_files_take_no_longer(spark, tmp_path):
    line = ",".join(["0123456789"] * 12) + "\n"
    for name, n in (("small", 10), ("large", 1_000_000)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "crash-data-download_2020.csv").write_text("A,B\n" + line * n)
    seconds = {}
    for name in ("small", "small", "large"):
        began = time.monotonic()
        assert [r["header"] for r in exports.headers(spark, str(tmp_path / name)).collect()] == ["A,B"]
        seconds[name] = time.monotonic() - began
    assert seconds["large"] < seconds["small"] + 2.5, seconds


def test_no_exports(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        exports.read_exports(spark, str(tmp_path))


NEEDED = ["ROLE2", "INJSVR2", "AGE2", "SEX1", "SEX2", "RACE1", "RACE2", "VEHTYPE1", "VEHTYPE2", "MUNINAME",
          "CRSHTIME", "ONSTR", "ATSTR"]


def full(df):
    return df.withColumns({c: F.lit(None).cast("string") for c in NEEDED if c not in df.columns})


def test_curated_table_is_pruned_by_year(spark, folder, tmp_path):
    out = str(tmp_path / "curated")
    tables.write_curated(curate(full(exports.read_exports(spark, folder))), out)
    df = tables.read_curated(spark, out)
    assert df.count() == 4 and sorted(os.listdir(out))[-1] == "year=2024"
    one = df.where("year = 2023").select("DOCTNMBR")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<DOCTNMBR:string>" in plan
    assert one.first()[0] == "3"
    injured = youth(severity_in(df, ["K", "A"])).select("DOCTNMBR")
    plan = injured._jdf.queryExecution().executedPlan().toString()
    assert "In(ped_inj, [A,K])" in plan and [r[0] for r in injured.collect()] == ["1"]


def test_summaries_as_csv(spark, folder, tmp_path):
    df = curate(full(exports.read_exports(spark, folder)))
    out = str(tmp_path / "summaries")
    sinks.write_all_summaries(all_summaries(df, "CNTYNAME"), out, "CNTYNAME")
    assert len(os.listdir(out)) == 7
    # the place is in the path and in the file; files in order of their names hold the rows in order
    place = os.path.join(out, "crash_by_race", "place=DANE")
    lines = [open(os.path.join(place, f)).read().splitlines() for f in sorted(os.listdir(place)) if f.endswith(".csv")]
    assert {x[0] for x in lines} == {"CNTYNAME,vulnerable_role,ped_inj_name,vulnerable_race,count"}
    assert [x for file in lines for x in file[1:]] == [
        "DANE,Bicyclist,Suspected Serious Injury,NA,1", "DANE,Pedestrian,Fatality,NA,1",
        "DANE,Pedestrian,Suspected Minor Injury,NA,1"]


def test_a_large_place_is_several_files_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 40)
    table = spark.range(1000).selectExpr("'A=B %' as town", "id as year", "1L as count")
    table = table.union(spark.range(3).selectExpr("cast(null as string)", "id", "2L"))
    sinks.write_summaries({"t": table.repartition(7)}, str(tmp_path), "town")
    found = {}
    for folder in os.listdir(tmp_path / "t"):
        if folder.startswith("place="):
            files = sorted(f for f in os.listdir(tmp_path / "t" / folder) if f.endswith(".csv"))
            found[folder] = [x for f in files for x in open(tmp_path / "t" / folder / f).read().splitlines()[1:]], len(files)
    assert sorted(n for _, n in found.values())[-1] >= 25
    assert [f"A=B %,{i},1" for i in range(1000)] in [x for x, _ in found.values()]
    assert ["NA,0,2", "NA,1,2", "NA,2,2"] in [x for x, _ in found.values()]


def test_layer_export(spark, folder, tmp_path):
    df = curate(full(exports.read_exports(spark, folder)))
    out = str(tmp_path / "layer")
    sinks.export_layer(point_labels(map_columns(df.where("DOCTNMBR = '1'"))), out)
    feature = json.loads(spark.read.text(out).first()[0])
    assert feature["geometry"] == {"type": "Point", "coordinates": [-89.4, 43.07]}
    assert feature["properties"]["color"] == "#9b1c1c" and feature["properties"]["Street"] is None
    assert feature["properties"]["label"] == "<b>Pedestrian </b><br>2022-01-02</br>Fatality</br>Pedestrian age: 9"


SQUARE = [[[0, 0], [1, 0], [1, 1], [0, 0]]]


def geojson(*features):
    return json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c}} for t, c, p in features]})


def test_geojson(spark, tmp_path):
    path = tmp_path / "shapes.geojson"
    path.write_text(geojson(
        ("Polygon", SQUARE, {"CNTY_NAME": "Rock", "MCD_NAME": "A"}),
        ("MultiPolygon", [SQUARE, SQUARE], {"MCD_NAME": "B", "n": 3}),
        ("Point", [-88.0, 43.0], {}),
    ))
    rows = vector.read_geojson(spark, str(path)).collect()
    assert [len(r["rings"]) if r["rings"] else 0 for r in rows] == [1, 2, 0]
    assert rows[0]["rings"][0][1]["x"] == 1.0 and (rows[2]["lon"], rows[2]["lat"]) == (-88.0, 43.0)
    assert rows[1]["properties"]["n"] == "3"
    towns = vector.read_municipalities(spark, str(path)).collect()
    assert towns[0]["MCD_NAME"] == "A" and towns[0]["CNTY_NAME"] == "Rock"


def test_lts_lines_take_the_county_of_the_file(spark, tmp_path):
    (tmp_path / "bike_lts_DANE.geojson").write_text(geojson(
        ("LineString", [[0, 0], [1, 1]], {"LTS_F": "2"}), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]], {"LTS_F": 9})))
    rows = vector.read_lts(spark, str(tmp_path)).collect()
    assert [(r["county_file"], r["lts"]) for r in rows] == [("dane", "2"), ("dane", "9"), ("dane", "9")]
    assert rows[2]["path"][0]["x"] == 2.0


def test_geojson_lines(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"a": "b"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(feature) for _ in range(3)))
    assert vector.read_geojson(spark, str(tmp_path / "p.jsonl"), lines=True).where("lon = 1 and lat = 2").count() == 3


def test_kml(spark, tmp_path):
    (tmp_path / "sites.kml").write_text(
        '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
        "<Placemark><name>s</name><Point><coordinates>-87.9,43.05,0</coordinates></Point></Placemark>"
        "<Placemark><name>l</name><LineString><coordinates> -87.9,43.0 -87.8,43.1,5\n-87.7,43.2 </coordinates></LineString></Placemark>"
        "</Document></kml>")
    rows = {r["name"]: r for r in vector.read_kml(spark, str(tmp_path / "sites.kml")).collect()}
    assert (rows["s"]["lon"], rows["s"]["lat"]) == (-87.9, 43.05)
    assert [(p["x"], p["y"]) for p in rows["l"]["path"]] == [(-87.9, 43.0), (-87.8, 43.1), (-87.7, 43.2)]
    assert rows["s"]["path"] is None


def test_typed_and_inferred_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("code,n,share\n007,3,0.5\n008,x,NA\n")
    schema = tables.typed_schema(["code", "n", "share"], "cid")
    rows = tables.read_typed_csv(spark, str(path), schema).collect()
    assert tuple(rows[0]) == ("007", 3, 0.5) and tuple(rows[1]) == ("008", None, None)
    assert dict(tables.read_inferred_csv(spark, str(path)).dtypes)["share"] == "double"
    with pytest.raises(ValueError):
        tables.typed_schema(["a"], "cc")


def test_run_config(tmp_path):
    path = tmp_path / "run.yaml"
    path.write_text('# which\ncounty_focus: "ALL"\nschool_type_focus: High School # one\ndistrict_focus: "all"\n'
                    "parallel_workers: 6\nbike_lts: no\nrefresh_basemaps: yes\n")
    config = RunConfig.from_yaml(str(path))
    assert config.county_focus is None and config.district_focus is None
    assert config.school_type_focus == ("High School",) and config.parallel_workers == 6
    assert config.bike_lts is False and config.refresh_basemaps is True
    with pytest.raises(ValueError):
        RunConfig.from_dict({"county": "DANE"})


@pytest.fixture
def school_df(spark):
    cols = ("NCES_CODE string, SCHOOL string, DISTRICT string, SCHOOLTYPE string, COUNTY string, "
            "VIRTUAL string, LAT double, LON double")
    return spark.createDataFrame([
        ("1", "Lake School", "Milwaukee", "Elementary School", "Milwaukee", "No", 43.0, -88.0),
        ("2", "Hill", "Milwaukee", "High School", "Milwaukee", None, 43.1, -88.0),
        ("3", "Bay", "Madison Metropolitan", "Middle School", "Dane", "No", 43.07, -89.4),
        ("4", "Cloud", "Madison Metropolitan", "High School", "Dane", "Yes", 43.0, -89.0),
        ("5", "Nowhere", "Other", "High School", "Rock", "No", None, -89.0),
        ("6", "Far", "Other", "Alternative School", "Rock", "No", 42.5, -89.0),
        (None, "Nameless", "Other", "High School", "Rock", "No", 42.5, -89.0),
    ], cols)


def test_school_filters_and_policy(school_df):
    assert sorted(r[0] for r in valid_schools(school_df).select("NCES_CODE").collect()) == ["1", "2", "3", "6"]
    assert placed_schools(school_df).count() == 6
    assert in_counties(school_df, ["MILWAUKEE"]).count() == 2
    miles = {r["NCES_CODE"]: r["walk_boundary_mi"] for r in schools.walk_boundary(valid_schools(school_df)).collect()}
    assert miles == {"1": 1.0, "2": 2.0, "3": 1.5, "6": 2.0}
    assert schools.walk_boundary(school_df).where("NCES_CODE = '1'").first()["walk_boundary_m"] == 1609
    config = RunConfig.from_dict({"county_focus": "milwaukee", "district_focus": ["MILWAUKEE", "Other"]})
    assert sorted(r[0] for r in focus(school_df, config).select("NCES_CODE").collect()) == ["1", "2"]


def test_school_run(curated, school_df):
    near = {"ROLE1": "PED", "AGE1": "10", "INJSVR1": "K", "LATDECDG": "43.0", "LONDECDG": "-88.0"}
    crashes = curated(
        {**near, "DOCTNMBR": "1"}, {**near, "DOCTNMBR": "2", "AGE1": "18"},
        {**near, "DOCTNMBR": "3", "LATDECDG": "43.03"},  # beyond 1 mile + 500 m, also of school 2
        {**near, "DOCTNMBR": "4", "ROLE1": "O PED"}, {**near, "DOCTNMBR": "5", "LATDECDG": None},
        {**near, "DOCTNMBR": "6", "LATDECDG": "43.07", "LONDECDG": "-89.4"},
    )
    out = runs.school_maps(school_df, crashes, RunConfig())
    assert sorted((r["NCES_CODE"], r["DOCTNMBR"]) for r in out.collect()) == [("1", "1"), ("3", "6")]


def test_manifest(spark, school_df):
    expected = runs.schools_of_run(school_df, RunConfig())
    listing = spark.createDataFrame(
        [("school_maps/Milwaukee County/Milwaukee School District/Elementary Schools/Lake School.pdf",)], "path string")
    checked = schools.manifest(expected, listing)
    assert {r["NCES_CODE"]: r["exists"] for r in checked.collect()} == {"1": True, "2": False, "3": False, "6": False}
    left = sorted(r[0] for r in schools.districts_not_done(checked).collect())
    assert left == ["Madison Metropolitan", "Milwaukee", "Other"]


def test_manifest_from_a_folder(spark, school_df, tmp_path):
    place = tmp_path / "maps" / "Dane County" / "Madison Metropolitan School District" / "Middle Schools"
    place.mkdir(parents=True)
    (place / "Bay School.pdf").write_text("x")
    (place / "Bay School.txt").write_text("x")
    listing = exports.file_listing(spark, str(tmp_path / "maps"), "*.pdf", prefix="school_maps/")
    checked = schools.manifest(runs.schools_of_run(school_df, RunConfig()), listing)
    assert [r["NCES_CODE"] for r in checked.where("exists").collect()] == ["3"]


def test_files_are_written_at_their_paths(spark, tmp_path):
    rows = [("a b/c#1.pdf", "x"), ("a b/d%2F.pdf", "v"), ("empty.txt", None), ("e.pdf", "z"), ("e.pdf", "y"), (None, "w")]
    rows += [(f"many/{i}.pdf", str(i)) for i in range(50)]
    folder = f"file:{tmp_path}/out"
    sinks.write_files(spark.createDataFrame(rows, "path string, n string"), folder, content="n")
    listed = sorted(r["path"] for r in exports.file_listing(spark, folder, "*.pdf").collect())
    assert listed == sorted({r[0] for r in rows if r[0] and r[0] != "empty.txt"})
    assert (tmp_path / "out/e.pdf").read_text() == "y" and (tmp_path / "out/empty.txt").read_text() == ""
    # nothing beside them: no folder for each, no check sums, no marks
    assert len([f for _, _, names in os.walk(tmp_path / "out") for f in names]) == 54


def test_listing(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert [os.path.basename(p) for p in exports.list_files(spark, str(tmp_path), "*.pdf")] == ["a.pdf"]


def test_polygon_layer(spark, tmp_path):
    path = tmp_path / "shapes.geojson"
    path.write_text(geojson(("Polygon", SQUARE, {"CNTY_NAME": "Rock", "MCD_NAME": "A"})))
    towns = vector.read_municipalities(spark, str(path))
    sinks.export_layer(towns, str(tmp_path / "layer"))
    feature = json.loads(spark.read.text(str(tmp_path / "layer")).first()[0])
    assert feature["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    assert feature["properties"] == {"CNTY_NAME": "Rock", "MCD_NAME": "A"}


def test_municipality_extract(spark, curated, tmp_path):
    path = tmp_path / "towns.geojson"
    path.write_text(geojson(("Polygon", SQUARE, {"CNTY_NAME": "Rock", "MCD_NAME": "A"})))
    towns = vector.read_municipalities(spark, str(path))
    at = {"ROLE1": "BIKE", "LONDECDG": "0.5"}
    crashes = curated({**at, "DOCTNMBR": "1", "LATDECDG": "0.5"}, {**at, "DOCTNMBR": "2", "LATDECDG": "1.0089"},
                      {**at, "DOCTNMBR": "3", "LATDECDG": "1.0091"}, {"DOCTNMBR": "4", "LONDECDG": "0.5", "LATDECDG": "0.5"})
    found = maps.municipality_maps(towns, crashes)
    assert sorted((r["MCD_NAME"], r["DOCTNMBR"]) for r in found.collect()) == [("A", "1"), ("A", "2")]
    segments = spark.createDataFrame(
        [("rock", 0.5, 0.5, 0.5, 5.0), ("dane", 0.5, 0.5, 0.5, 5.0), ("rock", 4.0, 4.0, 5.0, 5.0)],
        "county_file string, x1 double, y1 double, x2 double, y2 double")
    (line,) = maps.municipality_lines(towns, segments).collect()
    assert (line["cx1"], line["cy1"], line["cx2"]) == (0.5, 0.5, 0.5) and line["cy2"] == pytest.approx(1 + 1000 / 111320)


def test_enrollment(spark):
    cols = ["DISTRICT_CODE", "SCHOOL_CODE", "GRADE_LEVEL", "SCHOOL_NAME", "DISTRICT_NAME", "GRADE_GROUP", "CHARTER_IND",
            "GROUP_BY", "GROUP_BY_VALUE", "PERCENT_OF_GROUP"]
    base = ("01", "02", "K", "S", "D", "Elementary School", "No")
    rows = [(*base, "Migrant Status", "Yes", 0.2), ("01", "02", "1", *base[3:], "Migrant Status", "Yes", 0.4),
            ("01", "02", "1", *base[3:], "Sex", "F", 0.5)]
    df = spark.createDataFrame(rows, cols)
    names = schools.enrollment_variables(df)
    assert names == ["Migrant_Status__Yes", "Sex__F"]
    profile = schools.enrollment_profile(schools.enrollment_wide(df, names), names)
    r = profile.first()
    assert r["district_school"] == "0102" and r["Migrant_Status__Yes"] == pytest.approx(0.3) and r["Sex__F"] == 0.5
    places = spark.createDataFrame([("01", "02"), ("01", "03")], "SDID string, SCH_CODE string")
    joined = {r["SCH_CODE"]: r["Sex__F"] for r in schools.with_enrollment(places, profile).collect()}
    assert joined == {"02": 0.5, "03": None}


def test_whole_runs(spark, folder, tmp_path, school_df):
    columns = ",".join(["DOCTNMBR", *NEEDED])
    (tmp_path / "exports" / "crash-data-download_2021.csv").write_text(columns + "\n5" + "," * len(NEEDED) + "\n")
    out = str(tmp_path / "out")
    crashes = runs.curate_exports(spark, folder, f"{out}/crashes")
    assert crashes.count() == 5
    runs.summarize_places(crashes, f"{out}/summaries", "CNTYNAME", ["DANE"])
    population = spark.createDataFrame([("DANE", 500000)], "County string, value int")
    runs.state_map(crashes, population, f"{out}/map")
    assert sorted(os.listdir(f"{out}/map")) == ["counties_en", "counties_es", "points_en", "points_es"]
    assert spark.read.text(f"{out}/map/points_es").count() == 3
    assert "SCHOOLTYPE_es" in school_labels(school_df, "es").columns


def test_a_second_run_of_school_maps_computes_none(spark, curated, tmp_path):
    rows = [(c, "A", "DANE", "D", "High School", "No", 43.0 + i, -89.0) for i, c in enumerate(("1", "2/b", "3 c"))]
    schema = "NCES_CODE string, SCHOOL string, COUNTY string, DISTRICT string, SCHOOLTYPE string, VIRTUAL string, LAT double, LON double"
    table = spark.createDataFrame(rows, schema)
    crashes = curated(*[{"DOCTNMBR": str(i), "ROLE1": "PED", "AGE1": "9", "LATDECDG": str(43.0 + i), "LONDECDG": "-89.0",
                         "CRSHDATE": "2023-05-06"} for i in range(2)])
    config, out = RunConfig.from_dict({"county_focus": "ALL"}), str(tmp_path / "maps of schools")
    wanted = {r["NCES_CODE"] for r in runs.schools_of_run(table, config).collect()}
    assert {r["NCES_CODE"] for r in runs.school_maps_to(table, crashes, config, out).collect()} == wanted
    first = sorted(os.path.join(d, f) for d, _, names in os.walk(out) for f in names)
    assert runs.school_maps_to(table, crashes, config, out).count() == 0
    assert sorted(os.path.join(d, f) for d, _, names in os.walk(out) for f in names) == first
    assert {r["NCES_CODE"] for r in runs.done_schools(spark, out).collect()} == wanted
    held = spark.read.parquet(out)
    assert held.where("DOCTNMBR is not null").count() == 2 and held.select("school_code").distinct().count() == 3
    # a further school, and only that one
    more = table.union(spark.createDataFrame([("9", "B", *rows[0][2:])], schema))
    assert [r["NCES_CODE"] for r in runs.school_maps_to(more, crashes, config, out).collect()] == ["9"]
