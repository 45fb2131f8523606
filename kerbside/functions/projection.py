"""Longitude/latitude to and from UTM metres (Krueger series of order 4, WGS84).

Each transform has stages that use the previous stage's values several times. On columns
the stages are added one after the other; on rings each stage is one array ``transform``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: WGS84 ellipsoid and the UTM convention --------------------------------
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
# ------------------------------------------------------------------------------------------

_N = FLATTENING / (2 - FLATTENING)
_E = 2 * math.sqrt(_N) / (1 + _N)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def _conformal(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - _E * F.atanh(_E * s)), F.radians(lon - central_meridian(zone))


def _sphere(t: Column, dl: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))


def _grid(xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * _A * east, SCALE * _A * north


def _ungrid(x: Column, y: Column) -> tuple[Column, Column]:
    return y / (SCALE * _A), (x - FALSE_EASTING) / (SCALE * _A)


def _unsphere(xi: Column, eta: Column) -> tuple[Column, Column]:
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return xi1, eta1


def _unconformal(xi: Column, eta: Column) -> tuple[Column, Column]:
    return F.asin(F.sin(xi) / F.cosh(eta)), F.atan2(F.sinh(eta), F.cos(xi))


def _geographic(chi: Column, dl: Column, zone: int) -> tuple[Column, Column]:
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(dl) + central_meridian(zone), F.degrees(phi)


def _forward(zone: int):
    return (lambda a, b: _conformal(a, b, zone), _sphere, _grid)


def _inverse(zone: int):
    return (_ungrid, _unsphere, _unconformal, lambda a, b: _geographic(a, b, zone))


def _staged(df: DataFrame, a: str, b: str, out: tuple[str, str], stages) -> DataFrame:
    """The last stage leaves through ``inline``: a filter or join on the result is then not
    rewritten into the series, where each use of a stage would repeat all stages below."""
    keep = [c for c in df.columns if c not in out]
    current = (a, b)
    for i, stage in enumerate(stages[:-1]):
        names = (f"_u{i}", f"_v{i}")
        u, v = stage(F.col(current[0]), F.col(current[1]))
        df = df.withColumns({names[0]: u, names[1]: v})
        current = names
    u, v = stages[-1](F.col(current[0]), F.col(current[1]))
    return df.select(*keep, F.inline(F.array(F.struct(u.alias(out[0]), v.alias(out[1])))))


def with_utm(
    df: DataFrame,
    lon: str = "longitude",
    lat: str = "latitude",
    out: tuple[str, str] = ("x", "y"),
    zone: int = 16,
) -> DataFrame:
    """Add easting and northing in metres."""
    return _staged(df, lon, lat, out, _forward(zone))


def with_lonlat(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    out: tuple[str, str] = ("longitude", "latitude"),
    zone: int = 16,
) -> DataFrame:
    """Add longitude and latitude in degrees."""
    return _staged(df, x, y, out, _inverse(zone))


def project_rings(rings: Column, zone: int = 16) -> Column:
    """Rings of lon/lat points (``x``, ``y``) as rings of UTM points."""

    def apply(stage):
        def point(p: Column) -> Column:
            u, v = stage(p["x"], p["y"])
            return F.struct(u.alias("x"), v.alias("y"))

        return point

    def ring(r: Column) -> Column:
        for stage in _forward(zone):
            r = F.transform(r, apply(stage))
        return r

    return F.transform(rings, ring)
