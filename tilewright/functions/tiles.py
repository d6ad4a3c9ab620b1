"""Tile columns: origins, validity, flips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above this zoom a tile count of a row no longer fits into a BIGINT.
MAX_ZOOM = 62


def span(z: Column) -> Column:
    """2^z, tiles along one side."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def is_bottom_left(origin: Column) -> Column:
    """Whatever the case and separators; a missing or other origin is TOP_LEFT."""
    return F.coalesce(F.regexp_replace(F.lower(origin), "[^a-z]", "") == "bottomleft", F.lit(False))


def is_valid(z: Column, x: Column, y: Column) -> Column:
    """All present, 0 <= z <= 62 and 0 <= x, y < 2^z. Never null."""
    side = span(F.greatest(F.least(z, F.lit(MAX_ZOOM)), F.lit(0)))
    ok = z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < side) & (y < side)
    return F.coalesce(ok, F.lit(False))


def flip(z: Column, y: Column) -> Column:
    """The row counted from the other side."""
    return span(z) - 1 - y


def top_left_row(z: Column, y: Column, origin: Column) -> Column:
    return F.when(is_bottom_left(origin), flip(z, y)).otherwise(y)


def in_range(z: Column, x: Column, y: Column, rz: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Same zoom and inside the range, edges included."""
    return (z == rz) & x.between(minx, maxx) & y.between(miny, maxy)


def n_tiles(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Tiles of a range; an error on overflow in ANSI mode."""
    return (maxx - minx + 1) * (maxy - miny + 1)


def corner(which: str, origin: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, Column]:
    """x, y of lower_left, lower_right, upper_left or upper_right; which row is low depends on the origin."""
    low = F.when(is_bottom_left(origin), miny).otherwise(maxy)
    high = F.when(is_bottom_left(origin), maxy).otherwise(miny)
    return minx if which.endswith("left") else maxx, low if which.startswith("lower") else high


def next_in_range(x: Column, y: Column, minx: Column, maxx: Column, maxy: Column) -> Column:
    """Struct x, y of the tile after this one, x fastest; null after the last."""
    wraps = x >= maxx
    return F.when(~(wraps & (y >= maxy)), F.struct(F.when(wraps, minx).otherwise(x + 1).alias("x"), F.when(wraps, y + 1).otherwise(y).alias("y")))


def previous_in_range(x: Column, y: Column, minx: Column, miny: Column, maxx: Column) -> Column:
    wraps = x <= minx
    return F.when(~(wraps & (y <= miny)), F.struct(F.when(wraps, maxx).otherwise(x - 1).alias("x"), F.when(wraps, y - 1).otherwise(y).alias("y")))


def shifted(z: Column, x: Column, y: Column, by_x: Column | int, by_y: Column | int) -> tuple[Column, Column, Column]:
    """The tile so many columns and rows away, also outside the level."""
    return z, x + by_x, y + by_y


def at_zoom(z: Column, x: Column, y: Column, zoom: Column) -> tuple[Column, Column, Column]:
    """The tile of the same column and row at another zoom: nothing is rescaled."""
    return zoom, x, y
