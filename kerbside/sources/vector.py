"""GeoJSON and KML as tables of rings, paths and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.sources.names import file_name

_FEATURE = {
    "properties": "map<string,string>",
    "geometry": "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>",
}
_PATH = "array<array<double>>"
_POLYGON = f"array<{_PATH}>"
_MULTI_POLYGON = f"array<{_POLYGON}>"


def _point(pair: Column) -> Column:
    return F.struct(pair[0].alias("x"), pair[1].alias("y"))


def _points(path: Column) -> Column:
    return F.transform(path, _point)


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature: ``file_name, properties, type, rings, paths, lon, lat, points``; a
    collection of geometries gives a row for each, an empty one a row without any.

    Polygons fill ``rings`` (all parts of a multi-polygon together), lines ``paths``, points
    ``lon`` and ``lat``, multi-points ``points``. Coordinates stay text until the geometry type is known, so files of
    mixed types need no schema inference. A collection is one JSON document and is read
    whole by one task; a file with one feature per line (``lines=True``) is split.
    """
    if lines:
        schema = ", ".join(f"{name} {kind}" for name, kind in _FEATURE.items())
        features = spark.read.schema(schema).json(path).select(
            "*", file_name().alias("file_name")
        )
    else:
        fields = ",".join(f"{name}:{kind}" for name, kind in _FEATURE.items())
        features = (
            spark.read.schema(f"features array<struct<{fields}>>")
            .option("multiLine", True)
            .json(path)
            .select(F.explode("features").alias("f"), file_name().alias("file_name"))
            .select("f.*", "file_name")
        )
    own = F.struct(F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates"))
    parts = F.col("geometry.geometries")
    features = features.withColumn(
        "geometry", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(own)))
    )
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    rings = (
        F.when(kind == "Polygon", F.transform(F.from_json(text, _POLYGON), _points))
        .when(
            kind == "MultiPolygon",
            F.transform(F.flatten(F.from_json(text, _MULTI_POLYGON)), _points),
        )
    )
    paths = (
        F.when(kind == "LineString", F.array(_points(F.from_json(text, _PATH))))
        .when(kind == "MultiLineString", F.transform(F.from_json(text, _POLYGON), _points))
    )
    point = F.when(kind == "Point", F.from_json(text, "array<double>"))
    return features.select(
        "file_name",
        "properties",
        kind.alias("type"),
        rings.alias("rings"),
        paths.alias("paths"),
        point[0].alias("lon"),
        point[1].alias("lat"),
        F.when(kind == "MultiPoint", _points(F.from_json(text, _PATH))).alias("points"),
    )


def county_of_file(name: Column | str = "file_name", start: int = 10, cut: int = 8) -> Column:
    """Lower-case county in a file name: from position ``start``, without the last ``cut``
    characters (the extension)."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.substring(name, F.lit(start), F.length(name) - (start - 1) - cut))


def read_lts(spark: SparkSession, path: str) -> DataFrame:
    """Street lines with their traffic stress level, one row per line and path."""
    lines = read_geojson(spark, path)
    return lines.select(
        county_of_file().alias("county_file"),
        F.col("properties")["LTS_F"].alias("lts"),
        F.explode("paths").alias("path"),
    )


def read_municipalities(spark: SparkSession, path: str) -> DataFrame:
    return read_geojson(spark, path).select(
        F.col("properties")["CNTY_NAME"].alias("CNTY_NAME"),
        F.col("properties")["MCD_NAME"].alias("MCD_NAME"),
        "rings",
    )


_PLACE = "struct<coordinates:string>"
_RING = f"struct<LinearRing:{_PLACE}>"
_AREA = f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>"
#: Levels of multi-geometries inside multi-geometries that are read.
NESTED = 4


def _many(levels: int) -> str:
    """The type of a multi-geometry with so many levels."""
    inner = f",MultiGeometry:array<{_many(levels - 1)}>" if levels > 1 else ""
    parts = f"Point:array<{_PLACE}>,LineString:array<{_PLACE}>,LinearRing:array<{_PLACE}>"
    return f"struct<{parts},Polygon:array<{_AREA}>{inner}>"


_PLACEMARK = (
    f"name string, Point {_PLACE}, LineString {_PLACE}, LinearRing {_PLACE}, Polygon {_AREA}, "
    f"MultiGeometry {_many(NESTED)}"
)


def _gathered(many: Column, kind: str, of: str, levels: int = NESTED) -> Column:
    """All parts of one kind in a multi-geometry and those inside it; null if it has none."""
    none = F.array().cast(f"array<{of}>")
    found = F.coalesce(many[kind], none)
    if levels > 1:
        nested = F.transform(many["MultiGeometry"], lambda m: _gathered(m, kind, of, levels - 1))
        found = F.concat(found, F.coalesce(F.flatten(F.filter(nested, lambda x: x.isNotNull())), none))
    return F.when(F.size(found) > 0, found)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """One row per placemark: ``name, lon, lat`` of a point, ``path`` of a line, ``rings`` of
    polygons (outlines and holes) or of a ring alone. The parts of a multi-geometry, and of those in
    it, are in ``points``, ``paths`` and ``rings``."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(_PLACEMARK).load(path)

    def pair(text: Column) -> Column:
        numbers = F.split(F.trim(text), ",")
        return F.struct(
            F.get(numbers, F.lit(0)).try_cast("double").alias("x"),
            F.get(numbers, F.lit(1)).try_cast("double").alias("y"),
        )

    def tuples(text: Column) -> Column:
        return F.transform(F.split(F.trim(text), r"\s+"), pair)

    def outlines(area: Column) -> Column:
        inner = F.coalesce(area["innerBoundaryIs"], F.array().cast(f"array<{_RING}>"))
        return F.transform(
            F.concat(F.array(area["outerBoundaryIs"]), inner),
            lambda ring: tuples(ring["LinearRing"]["coordinates"]),
        )

    many = F.col("MultiGeometry")
    point = pair(F.col("Point.coordinates"))
    line = lambda p: tuples(p["coordinates"])
    areas = F.flatten(F.transform(_gathered(many, "Polygon", _AREA), outlines))
    rings = F.transform(_gathered(many, "LinearRing", _PLACE), line)
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    both = F.concat(F.coalesce(areas, none), F.coalesce(rings, none))
    return marks.select(
        "name",
        point["x"].alias("lon"),
        point["y"].alias("lat"),
        tuples(F.col("LineString.coordinates")).alias("path"),
        F.when(F.col("Polygon").isNotNull(), outlines(F.col("Polygon")))
        .when(F.col("LinearRing").isNotNull(), F.array(tuples(F.col("LinearRing.coordinates"))))
        .when(F.size(both) > 0, both)
        .alias("rings"),
        F.transform(_gathered(many, "Point", _PLACE), lambda p: pair(p["coordinates"])).alias("points"),
        F.transform(_gathered(many, "LineString", _PLACE), line).alias("paths"),
    )
