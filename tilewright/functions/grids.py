"""Tiles of a matrix whose origin, resolution and size are columns; reference systems and scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.mercator import RADIUS

#: Part of a tile by which an edge is moved so that touching a boundary adds no tile.
EDGE = 1e-6
PIXEL_METERS = 0.00028
METERS_PER_DEGREE = 2 * math.pi * RADIUS / 360


def tile_at(x: Column, y: Column, origin: Column, origin_x: Column, origin_y: Column, span_x: Column, span_y: Column) -> tuple[Column, Column]:
    """Column and row of a coordinate, without regard to the matrix' size."""
    down = F.when(origin == "BOTTOM_LEFT", (y - origin_y) / span_y).otherwise((origin_y - y) / span_y)
    return F.floor((x - origin_x) / span_x + EDGE), F.floor(down + EDGE)


def inside_or_null(v: Column, low: Column, high: Column) -> Column:
    return F.when(v.between(low, high), v)


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(v, high), low)


def tile_extent(x: Column, y: Column, origin: Column, origin_x: Column, origin_y: Column, span_x: Column, span_y: Column) -> tuple[Column, Column, Column, Column]:
    minx = origin_x + x * span_x
    miny = F.when(origin == "BOTTOM_LEFT", origin_y + y * span_y).otherwise(origin_y - (y + 1) * span_y)
    return minx, miny, minx + span_x, miny + span_y


def box_range(minx: Column, miny: Column, maxx: Column, maxy: Column, origin_x: Column, origin_y: Column, span: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Tile range of a box in a top-left matrix, clipped to it; all null where the box lies outside."""
    x0, x1 = F.floor((minx - origin_x) / span + EDGE), F.floor((maxx - origin_x) / span - EDGE)
    y0, y1 = F.floor((origin_y - maxy) / span + EDGE), F.floor((origin_y - miny) / span - EDGE)
    ok = (x1 >= 0) & (y1 >= 0) & (x0 < width) & (y0 < height) & (x1 >= x0) & (y1 >= y0)
    zero = F.lit(0).cast("long")
    return tuple(F.when(ok, v) for v in (F.greatest(x0, zero), F.greatest(y0, zero), F.least(x1, width - 1), F.least(y1, height - 1)))


def to_pixel(x: Column, y: Column, minx: Column, maxy: Column, resolution: Column, width: int, height: int) -> Column:
    """Struct px, py of a map coordinate in a tile; null outside it."""
    px, py = F.floor((x - minx) / resolution), F.floor((maxy - y) / resolution)
    ok = (x >= minx) & (y <= maxy) & (x <= minx + resolution * width) & (y >= maxy - resolution * height)
    return F.when(ok, F.struct(F.least(px, F.lit(width - 1)).alias("px"), F.least(py, F.lit(height - 1)).alias("py")))


def to_map(px: Column, py: Column, minx: Column, maxy: Column, resolution: Column, width: int, height: int) -> Column:
    """Struct x, y of a pixel's corner; an error for a pixel outside the tile."""
    ok = px.between(0, width - 1) & py.between(0, height - 1)
    at = F.struct((minx + px * resolution).alias("x"), (maxy - py * resolution).alias("y"))
    return F.when(ok, at).otherwise(F.raise_error(F.lit("pixel outside the tile")))


def meters_per_unit(crs: Column) -> Column:
    geographic = crs.contains("4326") | crs.contains("4979") | crs.contains("CRS84") | crs.contains("CRS:84")
    return F.when(geographic, F.lit(METERS_PER_DEGREE)).otherwise(F.lit(1.0))


def resolution_of_scale(denominator: Column, crs: Column) -> Column:
    return denominator * PIXEL_METERS / meters_per_unit(crs)


def scale_of_resolution(resolution: Column, crs: Column) -> Column:
    return resolution * meters_per_unit(crs) / PIXEL_METERS


def crs_code(uri: Column) -> Column:
    """AUTHORITY:code of an address under www.opengis.net/def/crs, CRS:84 of that of CRS84; other text trimmed, as it is."""
    plain = F.trim(uri)
    parts = F.split(plain, "/")
    authority, code = F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 1)
    known = plain.rlike("^https?://www[.]opengis[.]net/def/crs/") & (F.size(parts) >= 3)
    plate = (F.lower(authority) == "ogc") & (F.lower(code) == "crs84")
    return F.when(known & plate, "CRS:84").when(known, F.concat(authority, F.lit(":"), code)).otherwise(plain)


def range_extent(minx: Column, miny: Column, maxx: Column, maxy: Column, origin: Column, origin_x: Column, origin_y: Column, span_x: Column, span_y: Column) -> tuple[Column, Column, Column, Column]:
    """Bounding box of a range of tiles, from its corners alone."""
    a = tile_extent(minx, miny, origin, origin_x, origin_y, span_x, span_y)
    b = tile_extent(maxx, maxy, origin, origin_x, origin_y, span_x, span_y)
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])
