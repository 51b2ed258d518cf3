"""Longitude/latitude to the CRS of a raster and back, chosen by EPSG code: geographic, Web Mercator and UTM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta.functions import utm

# EPSG codes, and the sphere of Web Mercator.
GEOGRAPHIC, WEB_MERCATOR = 4326, 3857
MERCATOR_RADIUS = 6378137.0
MERCATOR_EDGE = math.pi * MERCATOR_RADIUS

UNSUPPORTED = "raster CRS is not supported"


def is_supported(epsg: Column) -> Column:
    return F.coalesce(epsg.isin(GEOGRAPHIC, WEB_MERCATOR) | utm.is_utm(epsg), F.lit(False))


def _by_epsg(epsg: Column, geographic: Column, mercator: Column, grid: Column) -> Column:
    """The column of the code's kind; null for codes of no kind."""
    return F.when(utm.is_utm(epsg), grid).when(epsg == GEOGRAPHIC, geographic).when(epsg == WEB_MERCATOR, mercator)


def to_crs(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """x and y in the CRS ``epsg`` of a longitude/latitude in degrees; null where the CRS is not supported.

    Latitudes of 90 degrees have no place in Web Mercator and give null there.
    """
    east, north = utm.to_utm(lon, lat, epsg)
    inner = F.abs(lat) < 90.0
    mercator_y = F.when(inner, F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4.0)) * MERCATOR_RADIUS)
    return _by_epsg(epsg, lon, F.radians(lon) * MERCATOR_RADIUS, east), _by_epsg(epsg, lat, mercator_y, north)


def from_crs(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in the CRS ``epsg``; null where the CRS is not supported."""
    lon, lat = utm.from_utm(x, y, epsg)
    mercator_lat = F.degrees(F.atan(F.exp(y / MERCATOR_RADIUS)) * 2.0) - 90.0
    return _by_epsg(epsg, x, F.degrees(x / MERCATOR_RADIUS), lon), _by_epsg(epsg, y, mercator_lat, lat)


def corner_of(epsg: Column) -> tuple[Column, Column]:
    """A place left of and above everything in the CRS, from which rows and columns can be counted."""
    def pick(geographic: float, mercator: float, grid: float) -> Column:
        return _by_epsg(epsg, F.lit(geographic), F.lit(mercator), F.lit(grid))

    return pick(-360.0, -2 * MERCATOR_EDGE, -1e7), pick(90.0, MERCATOR_EDGE, 1e7)


