"""Boxes and coordinates as four or two columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import mercator

Box = tuple[Column, Column, Column, Column]


def expand(b: Box, by: Column) -> Box:
    return b[0] - by, b[1] - by, b[2] + by, b[3] + by


def centered(x: Column, y: Column, width: Column, height: Column) -> Box:
    return x - width / 2, y - height / 2, x + width / 2, y + height / 2


def contains(b: Box, x: Column, y: Column) -> Column:
    """Edges included."""
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def covers(a: Box, b: Box) -> Column:
    return (b[0] >= a[0]) & (b[1] >= a[1]) & (b[2] <= a[2]) & (b[3] <= a[3])


def intersects(a: Box, b: Box) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def intersection(a: Box, b: Box) -> Box:
    """All null when the boxes are disjoint."""
    ok = intersects(a, b)
    return tuple(F.when(ok, f(p, q)) for f, p, q in zip((F.greatest, F.greatest, F.least, F.least), a, b))


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def wkt(b: Box) -> Column:
    ring = [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]
    points = F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in ring])
    return F.concat(F.lit("POLYGON (("), points, F.lit("))"))


def of_tile(z: Column, x: Column, y: Column) -> Box:
    """A tile of the Web Mercator quad in meters; with contains and intersects, whether it holds a point or meets a box."""
    return mercator.tile_box_meters(z, x, y)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
