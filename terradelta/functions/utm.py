"""Longitude/latitude to UTM and back, as column expressions (third-order Krueger series, WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM grid constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

N = FLATTENING / (2.0 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR / (1.0 + N) * (1.0 + N**2 / 4.0 + N**4 / 64.0)
ALPHA = (
    N / 2.0 - 2.0 * N**2 / 3.0 + 5.0 * N**3 / 16.0,
    13.0 * N**2 / 48.0 - 3.0 * N**3 / 5.0,
    61.0 * N**3 / 240.0,
)
BETA = (
    N / 2.0 - 2.0 * N**2 / 3.0 + 37.0 * N**3 / 96.0,
    N**2 / 48.0 + N**3 / 15.0,
    17.0 * N**3 / 480.0,
)
DELTA = (
    2.0 * N - 2.0 * N**2 / 3.0 - 2.0 * N**3,
    7.0 * N**2 / 3.0 - 8.0 * N**3 / 5.0,
    56.0 * N**3 / 15.0,
)
ECCENTRICITY = 2.0 * math.sqrt(N) / (1.0 + N)


def zone_of(epsg: Column) -> Column:
    """UTM zone number of an EPSG code 326zz (north) or 327zz (south)."""
    return F.pmod(epsg, F.lit(100))


def is_utm(epsg: Column) -> Column:
    """Whether an EPSG code is one of the 60 zones, north or south."""
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def is_south(epsg: Column) -> Column:
    return epsg >= 32700


def _central_meridian(epsg: Column) -> Column:
    return F.radians((zone_of(epsg) * 6 - 183).cast("double"))


def _false_northing(epsg: Column) -> Column:
    return F.when(is_south(epsg), F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))


def _atanh(x: Column) -> Column:
    return F.log((1.0 + x) / (1.0 - x)) * 0.5


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a longitude/latitude in degrees; null unless ``epsg`` is a UTM zone."""
    phi = F.radians(lat)
    dlam = F.radians(lon) - _central_meridian(epsg)
    conformal = F.sinh(_atanh(F.sin(phi)) - _atanh(F.sin(phi) * ECCENTRICITY) * ECCENTRICITY)
    xi = F.atan2(conformal, F.cos(dlam))
    eta = _atanh(F.sin(dlam) / F.sqrt(conformal * conformal + 1.0))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * a
        north = north + F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * a
    k = SCALE * RECTIFYING_RADIUS
    return F.when(is_utm(epsg), east * k + FALSE_EASTING), F.when(is_utm(epsg), north * k + _false_northing(epsg))


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an easting/northing in metres; null unless ``epsg`` is a UTM zone."""
    k = SCALE * RECTIFYING_RADIUS
    xi0 = (y - _false_northing(epsg)) / k
    eta0 = (x - FALSE_EASTING) / k
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, start=1):
        xi = xi - F.sin(xi0 * (2.0 * j)) * F.cosh(eta0 * (2.0 * j)) * b
        eta = eta - F.cos(xi0 * (2.0 * j)) * F.sinh(eta0 * (2.0 * j)) * b
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + F.sin(chi * (2.0 * j)) * d
    lam = F.atan2(F.sinh(eta), F.cos(xi)) + _central_meridian(epsg)
    return F.when(is_utm(epsg), F.degrees(lam)), F.when(is_utm(epsg), F.degrees(phi))
