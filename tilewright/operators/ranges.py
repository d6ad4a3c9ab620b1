"""Tile ranges and pyramids as rows: z, minx, miny, maxx, maxy (edges included), with any other columns.

Set operations have set semantics on tiles: unions hold every tile once, and coverage is exact, also around holes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import tiles
from tilewright.operators.blocks import beside

BOUNDS = ["minx", "miny", "maxx", "maxy"]
#: The natural order of ranges of one zoom: row before column, first tile before last.
ORDER = ["miny", "minx", "maxy", "maxx"]


def expand(ranges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, z, x, y: every tile of every range. Rows are exploded before columns, so a wide range is split over generators."""
    valid = ranges.where((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")))
    rows = valid.select(*keep, "z", "minx", "maxx", F.explode(F.sequence("miny", "maxy")).alias("y"))
    return rows.select(*keep, "z", F.explode(F.sequence("minx", "maxx")).alias("x"), "y")


def intersect_ranges(a: DataFrame, b: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Non-empty intersections of every range of ``a`` with those of ``b`` at its zoom; keep columns come from both sides.

    An equi-join on zoom: ``b`` is meant to be the few ranges of a query.
    """
    other = b.select("z", *[F.col(c).alias(f"o_{c}") for c in BOUNDS], *[c for c in b.columns if c in keep])
    meet = (F.col("minx") <= F.col("o_maxx")) & (F.col("o_minx") <= F.col("maxx")) & (F.col("miny") <= F.col("o_maxy")) & (F.col("o_miny") <= F.col("maxy"))
    low = lambda c: F.greatest(c, f"o_{c}").alias(c)
    high = lambda c: F.least(c, f"o_{c}").alias(c)
    return a.join(other, "z").where(meet).select(*keep, "z", low("minx"), low("miny"), high("maxx"), high("maxy"))


def bounding(ranges: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    return ranges.groupBy(*by).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def count_tiles(ranges: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    """Sum over ranges; overlapping ranges count twice, as parts of a pyramid don't overlap."""
    return ranges.groupBy(*by).agg(F.sum(tiles.n_tiles(*map(F.col, BOUNDS))).alias("n_tiles"))


def flipped(ranges: DataFrame, height: Column | None = None) -> DataFrame:
    """Counted from the other side; ``height`` rows if the matrix isn't 2^z high."""
    top = (height if height is not None else tiles.span(F.col("z"))) - 1
    return ranges.withColumns({"miny": top - F.col("maxy"), "maxy": top - F.col("miny")})


def _relative(a: DataFrame, b: DataFrame) -> list[Column]:
    """o_miny and o_maxy in the origin of ``a``, where both sides have one."""
    if "origin" not in a.columns or "origin" not in b.columns:
        return [F.col("o_miny"), F.col("o_maxy")]
    turned = tiles.is_bottom_left(F.col("origin")) != tiles.is_bottom_left(F.col("o_origin"))
    return [F.when(turned, tiles.flip(F.col("z"), F.col(t))).otherwise(F.col(c)) for c, t in (("o_miny", "o_maxy"), ("o_maxy", "o_miny"))]


def range_relations(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """a_key, b_key, z, contains, intersects for ranges of one zoom; ``b`` is meant to be the few ranges of a query. Where
    both sides have a column origin, ``b`` is turned to that of ``a``."""
    origin = [F.col("origin").alias("o_origin")] if "origin" in b.columns else []
    few = b.select(F.col(b_key), "z", *[F.col(c).alias(f"o_{c}") for c in BOUNDS], *origin)
    low, high = _relative(a, b)
    inside = (F.col("o_minx") >= F.col("minx")) & (F.col("o_maxx") <= F.col("maxx")) & (low >= F.col("miny")) & (high <= F.col("maxy"))
    meet = (F.col("minx") <= F.col("o_maxx")) & (F.col("o_minx") <= F.col("maxx")) & (F.col("miny") <= high) & (low <= F.col("maxy"))
    return a.join(few, "z").select(a_key, b_key, "z", inside.alias("contains"), meet.alias("intersects"))


def inside_pyramid(tiles_df: DataFrame, pyramid: DataFrame) -> DataFrame:
    """The tiles (z, x, y) inside any range of the pyramid: a semi-join on zoom, so a tile comes once."""
    few = pyramid.select(F.col("z").alias("pz"), *BOUNDS)
    inside = tiles.in_range(F.col("z"), F.col("x"), F.col("y"), F.col("pz"), *map(F.col, BOUNDS))
    return tiles_df.join(few, inside, "left_semi")


# ---- unions and differences as ranges that don't overlap. No tile and no row of tiles is enumerated: y is cut into bands
# at the ranges' edges, x is swept inside each band, and bands that hold the same run are put together again.


def _banded(ranges: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, band, minx, maxx: each range in every band that it covers. ``edges`` numbers the edges of each group."""
    at = lambda name, y: edges.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("edge").alias(f"__{name}_edge"), F.col("n").alias(name), y)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    low = ranges.join(at("low", F.lit(0).alias("__l")), same & (F.col("miny") == F.col("__low_edge"))).drop(*[f"__{c}" for c in by])
    both = low.join(at("high", F.lit(0).alias("__h")), same & (F.col("maxy") + 1 == F.col("__high_edge")))
    return both.select(*by, F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("band"), "minx", "maxx")


def _disjoint(a: DataFrame, b: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """by and BOUNDS: ranges that together are those of ``a`` without those of ``b``, none over another."""
    whole = lambda df: df.where((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))).select(*by, *BOUNDS)
    a = whole(a)
    b = None if b is None else whole(b)
    both = a if b is None else a.unionByName(b)
    edges = both.select(*by, F.explode(F.array(F.col("miny"), F.col("maxy") + 1)).alias("edge")).distinct()
    up = Window.partitionBy(*by).orderBy("edge")
    edges = edges.select(*by, "edge", F.row_number().over(up).alias("n"), F.lead("edge").over(up).alias("next"))
    group = [*by, "band"]
    marks = lambda df, n, m: df.select(*group, F.inline(F.array(
        F.struct(F.col("minx").alias("x"), F.lit(n).alias("a"), F.lit(m).alias("b")), F.struct((F.col("maxx") + 1).alias("x"), F.lit(-n).alias("a"), F.lit(-m).alias("b")))))
    counted = marks(_banded(a, edges, by), 1, 0)
    if b is not None:
        counted = counted.unionByName(marks(_banded(b, edges, by), 0, 1))
    order = Window.partitionBy(*group).orderBy("x")
    at = counted.groupBy(*group, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    depth = at.select(*group, "x", F.lead("x").over(order).alias("next"), F.sum("a").over(order).alias("in_a"), F.sum("b").over(order).alias("in_b"))
    pieces = depth.where("in_a > 0 AND in_b = 0").select(*group, F.col("x").alias("minx"), (F.col("next") - 1).alias("maxx"))
    along = Window.partitionBy(*group).orderBy("minx")
    pieces = pieces.withColumn("first", F.coalesce((F.col("minx") > F.lag("maxx").over(along) + 1).cast("int"), F.lit(1)))
    runs = pieces.withColumn("run", F.sum("first").over(along)).groupBy(*group, "run").agg(F.min("minx").alias("minx"), F.max("maxx").alias("maxx"))
    down = Window.partitionBy(*by, "minx", "maxx").orderBy("band")
    runs = runs.withColumn("first", F.coalesce((F.col("band") > F.lag("band").over(down) + 1).cast("int"), F.lit(1)))
    joined = runs.withColumn("part", F.sum("first").over(down)).groupBy(*by, "minx", "maxx", "part").agg(F.min("band").alias("low"), F.max("band").alias("high"))
    of = lambda name, c, n: edges.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("n").alias(n), F.col(c).alias(name))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    low = joined.join(of("miny", "edge", "__low"), same & (F.col("low") == F.col("__low"))).drop(*[f"__{c}" for c in by])
    high = low.join(of("__end", "next", "__high"), same & (F.col("high") == F.col("__high")))
    return high.select(*by, "minx", "miny", "maxx", (F.col("__end") - 1).alias("maxy"))


def union_ranges(ranges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, z and BOUNDS: the tiles of all ranges, each in one range. Ranges of different zooms stay apart."""
    return _disjoint(ranges, None, [*keep, "z"])


def subtract_ranges(a: DataFrame, b: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, z and BOUNDS: the tiles of ``a`` outside all ranges of ``b``."""
    return _disjoint(a, b, [*keep, "z"])


def covered_ranges(ranges: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """key, covered: whether the parts together hold every tile of the key's ranges (which may overlap), by areas."""
    want, have = union_ranges(ranges, [key]), union_ranges(parts)
    area = lambda df, name: df.groupBy(key).agg(F.sum(tiles.n_tiles(*map(F.col, BOUNDS))).alias(name))
    met = area(intersect_ranges(want, have, [key]), "held")
    return area(want, "n").join(met, key, "left").select(key, (F.coalesce("held", F.lit(0)) == F.col("n")).alias("covered"))


def rows(ranges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, z, y, minx, maxx: every row of tiles of every range."""
    valid = ranges.where((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")))
    return valid.select(*keep, "z", F.explode(F.sequence("miny", "maxy")).alias("y"), "minx", "maxx")


def traversed(ranges: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    """by, y, minx, maxx: the runs of the union in the order in which its tiles are traversed (y, then x), each with the
    tile before its first (px, py) and the one after its last (nx, ny); inside a run they are x - 1 and x + 1."""
    return beside(
        rows(_disjoint(ranges, None, by), [c for c in by if c != "z"]), by, "y", ["minx"],
        {"px": F.col("maxx"), "py": F.col("y")}, {"nx": F.col("minx"), "ny": F.col("y")},
    )


def ends(ranges: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    """by, first_x, first_y, last_x, last_y: the first and the last tile of the ranges together, y before x."""
    first, last = F.min(F.struct(F.col("miny").alias("y"), F.col("minx").alias("x"))), F.max(F.struct(F.col("maxy").alias("y"), F.col("maxx").alias("x")))
    return ranges.groupBy(*by).agg(first.alias("f"), last.alias("l")).select(*by, F.col("f.x").alias("first_x"), F.col("f.y").alias("first_y"), F.col("l.x").alias("last_x"), F.col("l.y").alias("last_y"))


def require_one_zoom(*sides: DataFrame) -> None:
    """Raises unless all ranges have one zoom: set operations on ranges of different zooms give nothing, which is seldom
    what was meant. One small aggregate per side."""
    zooms = {r[0] for s in sides for r in s.select("z").distinct().limit(2).collect()}
    if len(zooms) > 1:
        raise ValueError(f"ranges of different zooms: {sorted(zooms)}")
