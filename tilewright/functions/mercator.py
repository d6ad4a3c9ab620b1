"""Web Mercator as column expressions: degrees, meters, tiles (rows counted from the top)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.tiles import span

RADIUS = 6378137.0
MAX_LATITUDE = 85.0511287798
HALF_WORLD = math.pi * RADIUS


def to_meters(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y in meters. Latitude is clamped to the square world, longitude isn't."""
    held = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2)) * RADIUS


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """lon, lat in degrees."""
    return F.degrees(x / RADIUS), F.degrees(F.lit(math.pi / 2) - F.atan(F.exp(-y / RADIUS)) * 2)


def tile_of_meters(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Column and row of the tile at zoom z, clamped to the world."""
    side = span(z)

    def held(v: Column) -> Column:
        return F.greatest(F.least(F.floor(v * side), side - 1), F.lit(0).cast("long"))

    return held((x + HALF_WORLD) / (2 * HALF_WORLD)), held((F.lit(HALF_WORLD) - y) / (2 * HALF_WORLD))


def tile_of_degrees(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    return tile_of_meters(*to_meters(lon, lat), z)


def tile_box_meters(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy in meters."""
    size = F.lit(2 * HALF_WORLD) / span(z)
    return x * size - HALF_WORLD, F.lit(HALF_WORLD) - (y + 1) * size, (x + 1) * size - HALF_WORLD, F.lit(HALF_WORLD) - y * size


def tile_box_degrees(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    minx, miny, maxx, maxy = tile_box_meters(z, x, y)
    return (*to_degrees(minx, miny), *to_degrees(maxx, maxy))
