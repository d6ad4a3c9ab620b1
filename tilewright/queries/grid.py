"""Queries on points, tiles, ranges and matrices. The driver's relational tables carry no geometry: their points are
synthetic, derived from integer keys; boxes and ranges come from the tiles of tile_features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import boxes, grids, hilbert, mercator, tiles
from tilewright.operators import matrixsets, ranges
from tilewright.session import table


def points(df, key):
    k = F.col(key)
    return df.select(key, ((k * 7919) % 360000 / 1000.0 - 180).alias("lon"), ((k * 104729) % 170000 / 1000.0 - 85).alias("lat"))


def PTS(t, k):
    return f"SELECT *, ({k} * 7919) % 360000 / 1000.0::DOUBLE - 180 AS lon, ({k} * 104729) % 170000 / 1000.0::DOUBLE - 85 AS lat FROM {t}"


def rounded(cols, digits=3):
    return [F.round(c, digits).alias(n) for n, c in cols.items()]


def point_to_mercator(spark, d):
    p = points(table(spark, d, "orders"), "o_orderkey")
    x, y = mercator.to_meters(F.col("lon"), F.col("lat"))
    return p.select("o_orderkey", *rounded({"mx": x, "my": y}))


def mercator_roundtrip(spark, d):
    p = points(table(spark, d, "customer"), "c_custkey")
    lon, lat = mercator.to_degrees(*mercator.to_meters(F.col("lon"), F.col("lat")))
    return p.select("c_custkey", *rounded({"lon": lon, "lat": lat}, 6))


def point_to_tile(spark, d):
    p = points(table(spark, d, "orders"), "o_orderkey")
    out = []
    for z in (0, 8, 18):
        x, y = mercator.tile_of_degrees(F.col("lon"), F.col("lat"), F.lit(z))
        out += [x.alias(f"x{z}"), y.alias(f"y{z}")]
    return p.select("o_orderkey", *out)


def _tiles(spark, d):
    f = table(spark, d, "tile_features")
    ok = f.where(tiles.is_valid(F.col("z"), F.col("x"), F.col("y")))
    return ok.select("z", "x", tiles.top_left_row(F.col("z"), F.col("y"), F.col("origin")).alias("y")).distinct()


TILES = """SELECT DISTINCT z, x, CASE WHEN regexp_replace(lower(origin), '[^a-z]', '', 'g') = 'bottomleft' THEN (1::BIGINT << z) - 1 - y ELSE y END AS y
  FROM tile_features WHERE z BETWEEN 0 AND 62 AND x >= 0 AND y >= 0 AND x < (1::BIGINT << z) AND y < (1::BIGINT << z)"""

BOX = ("minx", "miny", "maxx", "maxy")


def tile_bbox_mercator(spark, d):
    return _tiles(spark, d).select("z", "x", "y", *rounded(dict(zip(BOX, mercator.tile_box_meters(*map(F.col, "zxy"))))))


def tile_bbox_geographic(spark, d):
    return _tiles(spark, d).select("z", "x", "y", *rounded(dict(zip(("west", "south", "east", "north"), mercator.tile_box_degrees(*map(F.col, "zxy")))), 7))


def tile_to_hilbert(spark, d):
    return _tiles(spark, d).select("z", "x", "y", hilbert.checked_tile_id(*map(F.col, "zxy")).alias("tile_id"))


def hilbert_to_tile(spark, d):
    ids = table(spark, d, "tile_entries").select("tile_id").distinct()
    return ids.select("tile_id", hilbert.tiles_of_ids("tile_id").alias("t")).select("tile_id", "t.z", "t.x", "t.y")


def _grid_args():
    return [F.lit(v) for v in ("TOP_LEFT", -180.0, 90.0, 11.25, 11.25)]


def coord_to_tile(spark, d):
    """Strict (null outside) and clamped columns and rows on a grid that doesn't cover the whole south."""
    p = points(table(spark, d, "customer"), "c_custkey")
    cx, cy = grids.tile_at(F.col("lon"), F.col("lat"), *_grid_args())
    low, wide, high = F.lit(0).cast("long"), F.lit(31).cast("long"), F.lit(11).cast("long")
    inside = cx.between(low, wide) & cy.between(low, high)
    return p.select("c_custkey", F.when(inside, cx).alias("strict_x"), F.when(inside, cy).alias("strict_y"), grids.clamp(cx, low, wide).alias("x"), grids.clamp(cy, low, high).alias("y"))


def tile_extents(spark, d):
    """Extents of a grid's tiles counted from either corner, and the bounding box of all of them."""
    t = _tiles(spark, d)
    out = []
    for name, oy in (("TOP_LEFT", 90.0), ("BOTTOM_LEFT", -90.0)):
        size = F.lit(180.0) / tiles.span(F.col("z"))
        box = grids.tile_extent(F.col("x"), F.col("y"), F.lit(name), F.lit(-180.0), F.lit(oy), size, size)
        out.append(t.select(F.lit(name).alias("origin"), "z", "x", "y", *rounded(dict(zip(BOX, box)), 9)))
    return out[0].unionByName(out[1])


def matrix_bounds(spark, d):
    boxes_ = tile_extents(spark, d)
    return boxes_.groupBy("origin", "z").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def map_to_pixel(spark, d):
    p = points(table(spark, d, "customer"), "c_custkey")
    px = grids.to_pixel(F.col("lon"), F.col("lat"), F.lit(-90.0), F.lit(45.0), F.lit(0.25), 512, 256)
    back = grids.to_map(F.col("px"), F.col("py"), F.lit(-90.0), F.lit(45.0), F.lit(0.25), 512, 256)
    return p.select("c_custkey", px.alias("p")).where("p IS NOT NULL").select("c_custkey", "p.*").select("c_custkey", "px", "py", back.alias("m")).select("c_custkey", "px", "py", "m.x", "m.y")


def scale_denominators(spark, d):
    m = matrixsets.default_sets(spark)
    crs = F.col("crs")
    again = grids.resolution_of_scale(grids.scale_of_resolution(F.col("resolution"), crs), crs)
    return m.select("set_id", "z", F.round(grids.scale_of_resolution(F.col("resolution"), crs), 4).alias("scale"), F.round(again, 9).alias("resolution"))


def default_matrix_sets(spark, d):
    return matrixsets.default_sets(spark).select("set_id", "z", "crs", "tile_width", "matrix_width", "matrix_height", F.round("resolution", 8).alias("resolution"), F.round("origin_x", 3).alias("origin_x"))


def well_known_scales(spark, d):
    s = matrixsets.scale_sets(spark)
    return s.select("name", "crs", "z", F.round("scale_denominator", 4).alias("scale"), F.round("resolution", 9).alias("resolution"))


def _levels(spark):
    return matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")


def zoom_for_resolution(spark, d):
    wishes = table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.col("p_retailprice")).alias("resolution"))
    fast = matrixsets.zoom_for_resolution(wishes, _levels(spark), "p_partkey", "SPEED").withColumnRenamed("z", "z_speed")
    fine = matrixsets.zoom_for_resolution(wishes, _levels(spark), "p_partkey", "QUALITY").withColumnRenamed("z", "z_quality")
    return fast.join(fine, "p_partkey")


def tile_moves(spark, d):
    """Shifted, flipped and moved to another zoom (which keeps x and y)."""
    t = _tiles(spark, d)
    moved = tiles.shifted(*map(F.col, "zxy"), 3, -2)
    deeper = tiles.at_zoom(*map(F.col, "zxy"), F.col("z") + 1)
    return t.select("z", "x", "y", moved[1].alias("x_shifted"), moved[2].alias("y_shifted"), tiles.flip(F.col("z"), F.col("y")).alias("y_flipped"), deeper[0].alias("z_deeper"))


def _ranges(spark, d):
    """The range of each layer and zoom of the features, as delivered: overlapping, of many sizes, up to whole levels."""
    f = table(spark, d, "tile_features").where(tiles.is_valid(F.col("z"), F.col("x"), F.col("y")))
    return f.groupBy("layer", "z").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


RANGES = """SELECT layer, z, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy
  FROM tile_features WHERE z BETWEEN 0 AND 62 AND x >= 0 AND y >= 0 AND x < (1::BIGINT << z) AND y < (1::BIGINT << z) GROUP BY layer, z"""
ROWS = "SELECT layer, z, unnest(range(miny, maxy + 1)) AS y, minx, maxx FROM r"


def UNITED(rows):
    """Runs of each row of tiles by the greatest end so far, another way than the operator's. Rows alike are one, as windows
    put them in any order."""
    w = "OVER (PARTITION BY z, y ORDER BY minx, maxx ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    return f"""SELECT z, y, min(minx) AS minx, max(maxx) AS maxx FROM (SELECT *, sum(begins) {w.format('CURRENT ROW')} AS run FROM (
  SELECT *, CASE WHEN minx <= max(maxx) {w.format('1 PRECEDING')} + 1 THEN 0 ELSE 1 END AS begins FROM (SELECT DISTINCT z, y, minx, maxx FROM ({rows})))) GROUP BY z, y, run"""


def STACKED(runs):
    """Ranges of rows one under another that have the same run."""
    return f"""SELECT z, minx, min(y) AS miny, maxx, max(y) AS maxy FROM (SELECT *, y - row_number() OVER (PARTITION BY z, minx, maxx ORDER BY y) AS stack FROM ({runs})) GROUP BY z, minx, maxx, stack"""


def range_corners(spark, d):
    r = _ranges(spark, d)
    b = [F.col(c) for c in ranges.BOUNDS]
    out = []
    for origin in ("TOP_LEFT", "BOTTOM_LEFT"):
        cols = []
        for which in ("lower_left", "upper_right"):
            x, y = tiles.corner(which, F.lit(origin), *b)
            cols += [x.alias(f"{which}_x"), y.alias(f"{which}_y")]
        out.append(r.select("layer", "z", F.lit(origin).alias("origin"), *cols))
    return out[0].unionByName(out[1])


def range_tiles(spark, d):
    """Every tile of the ranges that tiles have at the next level: four of each."""
    t = _tiles(spark, d)
    below = t.select((F.col("z") + 1).alias("z"), (F.col("x") * 2).alias("minx"), (F.col("y") * 2).alias("miny"), (F.col("x") * 2 + 1).alias("maxx"), (F.col("y") * 2 + 1).alias("maxy"))
    return ranges.expand(below)


def range_union(spark, d):
    return ranges.union_ranges(_ranges(spark, d))


def range_counts(spark, d):
    """Tiles of each level's ranges, their bounding range and its tiles."""
    r = _ranges(spark, d)
    b = ranges.bounding(r)
    return b.join(ranges.count_tiles(r), "z").withColumn("n_bounding", tiles.n_tiles(*[F.col(c) for c in ranges.BOUNDS]))


def pyramid_levels(spark, d):
    r = _ranges(spark, d)
    return r.agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count_distinct("z").alias("n_levels"), F.sum(tiles.n_tiles(*[F.col(c) for c in ranges.BOUNDS])).alias("n_tiles"))


def range_intersection(spark, d):
    """Every range with those of the layer roads."""
    r = _ranges(spark, d)
    roads = r.where("layer = 'roads'").drop("layer")
    return ranges.intersect_ranges(r, roads, ["layer"])


def range_subtract(spark, d):
    r = _ranges(spark, d)
    return ranges.subtract_ranges(r.where("layer <> 'roads'"), r.where("layer = 'roads'"))


def range_covered(spark, d):
    """Which ranges of the layer water at each zoom the other layers' ranges hold completely."""
    r = _ranges(spark, d).withColumn("key", F.concat_ws("/", "layer", "z"))
    return ranges.covered_ranges(r.where("layer = 'water'"), r.where("layer <> 'water'"), "key")


def range_flip(spark, d):
    return ranges.flipped(_ranges(spark, d)).select("layer", "z", *ranges.BOUNDS)


def next_and_previous_tile(spark, d):
    """The tiles before and after each run of the union."""
    return ranges.traversed(_ranges(spark, d)).select("z", "y", "minx", "maxx", "px", "py", "nx", "ny")


def next_in_closed_form(spark, d):
    """The tiles before and after each row of each range."""
    r = _ranges(spark, d)
    c = ranges.rows(r, ["layer"]).join(r.select("layer", "z", "miny", "maxy"), ["layer", "z"])
    n = tiles.next_in_range(F.col("maxx"), F.col("y"), F.col("minx"), F.col("maxx"), F.col("maxy"))
    p = tiles.previous_in_range(F.col("minx"), F.col("y"), F.col("minx"), F.col("miny"), F.col("maxx"))
    return c.select("layer", "z", "y", "minx", "maxx", n.alias("n"), p.alias("p")).select("layer", "z", "y", "minx", "maxx", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def range_order(spark, d):
    """Ranges in their natural order: by zoom, then row, then column of their first tile, then of their last."""
    r = _ranges(spark, d)
    return r.select("layer", "z", *ranges.BOUNDS, F.row_number().over(Window.partitionBy("z").orderBy(*ranges.ORDER, "layer")).alias("place"))


def range_ends(spark, d):
    """The first and the last tile of each level's union, in traversal order."""
    return ranges.ends(_ranges(spark, d), ["z"])


def _nation_boxes(spark, d):
    p = points(table(spark, d, "nation"), "n_nationkey")
    k = F.col("n_nationkey")
    return p.select("n_nationkey", F.col("lon").alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 5 + k).alias("maxx"), (F.col("lat") + 3 + k / 2).alias("maxy"))


NATIONS = f"SELECT n_nationkey, lon AS minx, lat AS miny, lon + 5 + n_nationkey AS maxx, lat + 3 + n_nationkey / 2 AS maxy FROM ({PTS('nation', 'n_nationkey')})"


def bbox_tile_range(spark, d):
    """Boxes in degrees against all levels of the quad of degrees, touching edges left out."""
    levels = matrixsets.default_sets(spark).where("set_id = 'WorldCRS84Quad'").select("z", (F.col("resolution") * F.col("tile_width")).alias("side"), "matrix_width", "matrix_height")
    joined = _nation_boxes(spark, d).crossJoin(F.broadcast(levels))  # at most 18 levels
    found = grids.box_range(*[F.col(c) for c in BOX], F.lit(-180.0), F.lit(90.0), F.col("side"), F.col("matrix_width"), F.col("matrix_height"))
    out = joined.select("n_nationkey", "z", *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), found)])
    return out.where("x0 IS NOT NULL")


def bbox_algebra(spark, d):
    b = _nation_boxes(spark, d)
    box, region = tuple(F.col(c) for c in BOX), tuple(F.lit(v) for v in (-90.0, -45.0, 90.0, 45.0))
    meet, both = boxes.intersection(box, region), boxes.union(box, region)
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    cols = {"width": box[2] - box[0], "area": (box[2] - box[0]) * (box[3] - box[1]), "cx": cx, "cy": cy, "dist": boxes.distance(cx, cy, F.lit(0.0), F.lit(0.0)), "meet_w": meet[2] - meet[0], "union_w": both[2] - both[0], "wider": boxes.expand(box, F.lit(1.0))[2]}
    flags = {"inside": boxes.covers(region, box), "touches": boxes.intersects(region, box), "has_center": boxes.contains(region, cx, cy)}
    return b.select("n_nationkey", *rounded(cols, 6), *[c.alias(n) for n, c in flags.items()])


def bbox_union_all(spark, d):
    return _nation_boxes(spark, d).agg(*[F.round(f(c), 6).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))])


def tile_agg(spark, d):
    p = points(table(spark, d, "customer"), "c_custkey").join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    x, y = mercator.tile_of_degrees(F.col("lon"), F.col("lat"), F.lit(6))
    return p.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))


def tile_join_points(spark, d):
    """Customers and orders that share a tile at zoom 5: both sides are counted per tile before they meet."""
    def counted(t, key, name):
        p = points(table(spark, d, t), key)
        x, y = mercator.tile_of_degrees(F.col("lon"), F.col("lat"), F.lit(5))
        return p.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias(name))
    return counted("customer", "c_custkey", "n_customers").join(counted("orders", "o_orderkey", "n_orders"), ["x", "y"])


def tiles_without_points(spark, d):
    p = points(table(spark, d, "customer"), "c_custkey")
    x, y = mercator.tile_of_degrees(F.col("lon"), F.col("lat"), F.lit(9))
    return _tiles(spark, d).where("z = 9").join(p.select(x.alias("x"), y.alias("y")).distinct(), ["x", "y"], "left_anti").select("z", "x", "y")


def first_tiles(spark, d):
    """The first ten in traversal order (y before x), which is not that of (z, x, y)."""
    return _tiles(spark, d).orderBy("z", "y", "x").limit(10)


def windowed_tile_counts(spark, d):
    from tilewright.streaming.tile_counts import tile_counts

    e = table(spark, d, "events")
    e = e.join(points(e, "event_id"), "event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return tile_counts(e, "ts", "lon", "lat", 3).select(F.unix_seconds("window_start").alias("start_s"), "x", "y", "n_events")


R = "6378137.0::DOUBLE"
HW = f"(pi() * {R})"
MX, MY = f"radians(lon) * {R}", f"ln(tan(pi() / 4 + radians(greatest(least(lat, 85.0511287798::DOUBLE), -85.0511287798::DOUBLE)) / 2)) * {R}"


def TX(z):
    return f"greatest(least(floor(({MX} + {HW}) / (2 * {HW}) * {2**z})::BIGINT, {2**z - 1}), 0)", f"greatest(least(floor(({HW} - {MY}) / (2 * {HW}) * {2**z})::BIGINT, {2**z - 1}), 0)"


MERC = f"SELECT z, x, y, x * s - {HW} AS minx, {HW} - (y + 1) * s AS miny, (x + 1) * s - {HW} AS maxx, {HW} - y * s AS maxy FROM (SELECT *, 2 * {HW} / (1::BIGINT << z) AS s FROM ({TILES}))"


def LAT(c):
    return f"degrees(pi() / 2 - 2 * atan(exp(-{c} / {R})))"


SETS = f"""SELECT * FROM (VALUES ('EPSG4326','EPSG:4326',22,2,1,256,-180::DOUBLE,360::DOUBLE), ('EPSG4326x2','EPSG:4326',22,2,1,512,-180,360),
  ('EPSG3857','EPSG:3857',25,1,1,256,-{HW},2*{HW}), ('EPSG3857x2','EPSG:3857',25,1,1,512,-{HW},2*{HW}), ('WebMercatorQuad','EPSG:3857',25,1,1,256,-{HW},2*{HW}),
  ('WebMercatorQuadx2','EPSG:3857',25,1,1,512,-{HW},2*{HW}), ('WorldCRS84Quad','CRS:84',18,2,1,256,-180,360), ('WorldCRS84Quadx2','CRS:84',18,2,1,512,-180,360)
) s(set_id, crs, levels, across, down, side, origin_x, world)"""
LEVELS = f"SELECT *, (1::BIGINT << z) AS n, world / (across * (1::BIGINT << z) * side) AS resolution FROM (SELECT *, unnest(range(levels))::INT AS z FROM ({SETS}))"
MPU = f"CASE WHEN crs = 'EPSG:3857' THEN 1 ELSE 2 * pi() * {R} / 360 END"

HILBERT = f"""
WITH RECURSIVE t AS ({TILES}),
h AS (SELECT z, x, y, z - 1 AS i, x AS cx, y AS cy, 0::BIGINT AS d FROM t
  UNION ALL
  SELECT z, x, y, i - 1, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - ly ELSE ly END) ELSE lx END, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - lx ELSE lx END) ELSE ly END, d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, cx // s AS rx, cy // s AS ry, cx % s AS lx, cy % s AS ly FROM (SELECT *, 1::BIGINT << i AS s FROM h WHERE i >= 0)))
SELECT z, x, y, (((1::BIGINT << (2 * z)) - 1) // 3 + d)::BIGINT AS tile_id FROM h WHERE i = -1"""

UNHILBERT = """
WITH RECURSIVE e AS (SELECT DISTINCT tile_id FROM {source}),
l AS (SELECT tile_id, (SELECT max(k) FROM range(27) g(k) WHERE ((1::BIGINT << (2 * k)) - 1) // 3 <= tile_id)::INT AS z FROM e),
h AS (SELECT tile_id, z, 0 AS i, (tile_id - ((1::BIGINT << (2 * z)) - 1) // 3)::BIGINT AS t, 0::BIGINT AS x, 0::BIGINT AS y FROM l
  UNION ALL
  SELECT tile_id, z, i + 1, t // 4, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - y ELSE y END) ELSE x END + s * rx, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN s - 1 - x ELSE x END) ELSE y END + s * ry
  FROM (SELECT *, xor(t, rx) & 1 AS ry FROM (SELECT *, 1::BIGINT << i AS s, (t // 2) & 1 AS rx FROM h WHERE i < z)))
"""

ORACLE = {
    "point_to_mercator": f"SELECT o_orderkey, round({MX}, 3) AS mx, round({MY}, 3) AS my FROM ({PTS('orders', 'o_orderkey')})",
    "mercator_roundtrip": f"SELECT c_custkey, round(degrees(mx / {R}), 6) AS lon, round({LAT('my')}, 6) AS lat FROM (SELECT c_custkey, {MX} AS mx, {MY} AS my FROM ({PTS('customer', 'c_custkey')}))",
    "point_to_tile": f"SELECT o_orderkey, {', '.join(f'{TX(z)[0]} AS x{z}, {TX(z)[1]} AS y{z}' for z in (0, 8, 18))} FROM ({PTS('orders', 'o_orderkey')})",
    "tile_bbox_mercator": f"SELECT z, x, y, {', '.join(f'round({c}, 3) AS {c}' for c in BOX)} FROM ({MERC})",
    "tile_bbox_geographic": f"SELECT z, x, y, round(degrees(minx / {R}), 7) AS west, round({LAT('miny')}, 7) AS south, round(degrees(maxx / {R}), 7) AS east, round({LAT('maxy')}, 7) AS north FROM ({MERC})",
    "tile_to_hilbert": HILBERT,
    "hilbert_to_tile": UNHILBERT.format(source="tile_entries") + "SELECT tile_id, z, x, y FROM h WHERE i = z",
    "coord_to_tile": f"""
WITH c AS (SELECT c_custkey, floor((lon + 180) / 11.25 + 1e-6)::BIGINT AS cx, floor((90 - lat) / 11.25 + 1e-6)::BIGINT AS cy FROM ({PTS('customer', 'c_custkey')}))
SELECT c_custkey, CASE WHEN cx BETWEEN 0 AND 31 AND cy BETWEEN 0 AND 11 THEN cx END AS strict_x, CASE WHEN cx BETWEEN 0 AND 31 AND cy BETWEEN 0 AND 11 THEN cy END AS strict_y,
       greatest(least(cx, 31), 0) AS x, greatest(least(cy, 11), 0) AS y FROM c""",
    "tile_extents": f"""
WITH t AS (SELECT *, 180.0::DOUBLE / (1::BIGINT << z) AS s FROM ({TILES}))
SELECT 'TOP_LEFT' AS origin, z, x, y, round(-180 + x * s, 9) AS minx, round(90 - (y + 1) * s, 9) AS miny, round(-180 + x * s + s, 9) AS maxx, round(90 - (y + 1) * s + s, 9) AS maxy FROM t
UNION ALL SELECT 'BOTTOM_LEFT', z, x, y, round(-180 + x * s, 9), round(-90 + y * s, 9), round(-180 + x * s + s, 9), round(-90 + y * s + s, 9) FROM t""",
    "map_to_pixel": f"""
SELECT c_custkey, px, py, -90 + px * 0.25::DOUBLE AS x, 45 - py * 0.25::DOUBLE AS y FROM (
  SELECT c_custkey, least(floor((lon + 90) / 0.25::DOUBLE)::BIGINT, 511) AS px, least(floor((45 - lat) / 0.25::DOUBLE)::BIGINT, 255) AS py FROM ({PTS('customer', 'c_custkey')})
  WHERE lon >= -90 AND lat <= 45 AND lon <= 38 AND lat >= -19)""",
    "scale_denominators": f"SELECT set_id, z, round(resolution * ({MPU}) / 0.00028::DOUBLE, 4) AS scale, round(resolution, 9) AS resolution FROM ({LEVELS})",
    "default_matrix_sets": f"SELECT set_id, z, crs, side AS tile_width, across * n AS matrix_width, down * n AS matrix_height, round(resolution, 8) AS resolution, round(origin_x, 3) AS origin_x FROM ({LEVELS})",
    "well_known_scales": f"""
WITH s AS (SELECT 'GoogleCRS84Quad' AS name, 'CRS:84' AS crs, z::INT AS z, 559082264.0287178::DOUBLE / (1::BIGINT << z) AS d FROM range(19) g(z)
  UNION ALL SELECT 'GoogleMapsCompatible', 'EPSG:3857', z::INT, 559082264.0287178::DOUBLE / (1::BIGINT << z) FROM range(19) g(z)
  UNION ALL SELECT 'GlobalCRS84Scale', 'CRS:84', (row_number() OVER (ORDER BY d DESC) - 1)::INT, d::DOUBLE FROM (SELECT unnest([5e8, 2.5e8, 1e8, 5e7, 2.5e7, 1e7, 5e6, 2.5e6, 1e6, 5e5, 2.5e5, 1e5, 5e4, 2.5e4, 1e4, 5e3, 2.5e3, 1e3, 5e2, 2.5e2, 1e2]) AS d))
SELECT name, crs, z, round(d, 4) AS scale, round(d * 0.00028::DOUBLE / ({MPU}), 9) AS resolution FROM s""",
    "zoom_for_resolution": f"""
WITH l AS (SELECT z, resolution AS r FROM ({LEVELS}) WHERE set_id = 'WebMercatorQuad'),
b AS (SELECT p_partkey, w, arg_min(z, (abs(r - w), z)) AS z, arg_min(r, (abs(r - w), z)) AS r FROM (SELECT p_partkey, p_size * p_retailprice AS w FROM part) CROSS JOIN l GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN r < w THEN greatest(z - 1, 0) ELSE z END AS z_speed, CASE WHEN r > w THEN least(z + 1, 24) ELSE z END AS z_quality FROM b""",
    "tile_moves": f"SELECT z, x, y, x + 3 AS x_shifted, y - 2 AS y_shifted, (1::BIGINT << z) - 1 - y AS y_flipped, z + 1 AS z_deeper FROM ({TILES})",
    "range_corners": f"""WITH r AS ({RANGES})
SELECT layer, z, 'TOP_LEFT' AS origin, minx AS lower_left_x, maxy AS lower_left_y, maxx AS upper_right_x, miny AS upper_right_y FROM r
UNION ALL SELECT layer, z, 'BOTTOM_LEFT', minx, miny, maxx, maxy FROM r""",
    "range_tiles": f"SELECT z + 1 AS z, 2 * x + i AS x, 2 * y + j AS y FROM ({TILES}), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)",
    "range_union": f"WITH r AS ({RANGES}) {STACKED(UNITED(ROWS))}",
    "range_counts": f"""WITH r AS ({RANGES})
SELECT z, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, sum((maxx - minx + 1) * (maxy - miny + 1))::BIGINT AS n_tiles,
       (max(maxx) - min(minx) + 1) * (max(maxy) - min(miny) + 1) AS n_bounding FROM r GROUP BY z""",
    "pyramid_levels": f"WITH r AS ({RANGES}) SELECT min(z) AS min_zoom, max(z) AS max_zoom, count(DISTINCT z) AS n_levels, sum((maxx - minx + 1) * (maxy - miny + 1))::BIGINT AS n_tiles FROM r",
    "range_intersection": f"""WITH r AS ({RANGES})
SELECT a.layer, z, greatest(a.minx, b.minx) AS minx, greatest(a.miny, b.miny) AS miny, least(a.maxx, b.maxx) AS maxx, least(a.maxy, b.maxy) AS maxy
FROM r a JOIN r b USING (z) WHERE b.layer = 'roads' AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy""",
    "range_subtract": f"""WITH r AS ({RANGES}), u AS ({UNITED(ROWS + " WHERE layer <> 'roads'")}), o AS (SELECT * FROM ({ROWS}) WHERE layer = 'roads'),
j AS (SELECT u.*, o.minx AS a, o.maxx AS b FROM u LEFT JOIN o ON u.z = o.z AND u.y = o.y AND o.minx <= u.maxx AND o.maxx >= u.minx),
s AS (SELECT z, y, minx, maxx FROM j WHERE a IS NULL UNION ALL SELECT z, y, minx, a - 1 FROM j WHERE minx < a UNION ALL SELECT z, y, b + 1, maxx FROM j WHERE maxx > b)
{STACKED('SELECT * FROM s')}""",
    "range_covered": f"""WITH r AS ({RANGES}), u AS ({UNITED(ROWS + " WHERE layer <> 'water'")}), w AS (SELECT * FROM ({ROWS}) WHERE layer = 'water')
SELECT w.layer || '/' || w.z AS key, count(*) = count(u.z) AS covered FROM w LEFT JOIN u ON w.z = u.z AND w.y = u.y AND u.minx <= w.minx AND u.maxx >= w.maxx GROUP BY 1""",
    "range_order": f"WITH r AS ({RANGES}) SELECT *, row_number() OVER (PARTITION BY z ORDER BY miny, minx, maxy, maxx, layer)::INT AS place FROM r",
    "range_ends": f"""WITH r AS ({RANGES}), u AS ({UNITED(ROWS)}) SELECT z, arg_min(minx, (y, minx)) AS first_x, min(y) AS first_y, arg_max(maxx, (y, maxx)) AS last_x, max(y) AS last_y FROM u GROUP BY z""",
    "range_flip": f"WITH r AS ({RANGES}) SELECT layer, z, minx, (1::BIGINT << z) - 1 - maxy AS miny, maxx, (1::BIGINT << z) - 1 - miny AS maxy FROM r",
    "next_and_previous_tile": f"""WITH r AS ({RANGES}), u AS ({UNITED(ROWS)})
SELECT z, y, minx, maxx, lag(maxx) OVER w AS px, lag(y) OVER w AS py, lead(minx) OVER w AS nx, lead(y) OVER w AS ny FROM u WINDOW w AS (PARTITION BY z ORDER BY y, minx)""",
    "next_in_closed_form": f"""WITH r AS ({RANGES}), c AS ({ROWS})
SELECT layer, z, y, minx, maxx, lead(minx) OVER w AS nx, lead(y) OVER w AS ny, lag(maxx) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY layer, z ORDER BY y)""",
    "bbox_tile_range": f"""
WITH l AS (SELECT z, resolution * side AS s, across * n AS w, down * n AS h FROM ({LEVELS}) WHERE set_id = 'WorldCRS84Quad'),
b AS (SELECT n_nationkey, z, w, h, floor((minx + 180) / s + 1e-6)::BIGINT AS x0, floor((maxx + 180) / s - 1e-6)::BIGINT AS x1, floor((90 - maxy) / s + 1e-6)::BIGINT AS y0, floor((90 - miny) / s - 1e-6)::BIGINT AS y1
      FROM ({NATIONS}) CROSS JOIN l)
SELECT n_nationkey, z, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, w - 1) AS x1, least(y1, h - 1) AS y1 FROM b WHERE x1 >= 0 AND y1 >= 0 AND x0 < w AND y0 < h AND x1 >= x0 AND y1 >= y0""",
    "bbox_algebra": f"""
SELECT n_nationkey, round(maxx - minx, 6) AS width, round((maxx - minx) * (maxy - miny), 6) AS area, round((minx + maxx) / 2, 6) AS cx, round((miny + maxy) / 2, 6) AS cy,
       round(sqrt(((minx + maxx) / 2) ** 2 + ((miny + maxy) / 2) ** 2), 6) AS dist, CASE WHEN t THEN round(least(maxx, 90) - greatest(minx, -90), 6) END AS meet_w,
       round(greatest(maxx, 90) - least(minx, -90), 6) AS union_w, round(maxx + 1, 6) AS wider, minx >= -90 AND miny >= -45 AND maxx <= 90 AND maxy <= 45 AS inside, t AS touches,
       (minx + maxx) / 2 BETWEEN -90 AND 90 AND (miny + maxy) / 2 BETWEEN -45 AND 45 AS has_center
FROM (SELECT *, minx <= 90 AND maxx >= -90 AND miny <= 45 AND maxy >= -45 AS t FROM ({NATIONS}))""",
    "bbox_union_all": f"SELECT round(min(minx), 6) AS minx, round(min(miny), 6) AS miny, round(max(maxx), 6) AS maxx, round(max(maxy), 6) AS maxy FROM ({NATIONS})",
    "tile_agg": f"SELECT {TX(6)[0]} AS x, {TX(6)[1]} AS y, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM ({PTS('customer', 'c_custkey')}) GROUP BY 1, 2",
    "tile_join_points": f"""
WITH a AS (SELECT {TX(5)[0]} AS x, {TX(5)[1]} AS y, count(*) AS n_customers FROM ({PTS('customer', 'c_custkey')}) GROUP BY 1, 2),
b AS (SELECT {TX(5)[0]} AS x, {TX(5)[1]} AS y, count(*) AS n_orders FROM ({PTS('orders', 'o_orderkey')}) GROUP BY 1, 2) SELECT * FROM a JOIN b USING (x, y)""",
    "tiles_without_points": f"SELECT z, x, y FROM ({TILES}) t WHERE z = 9 AND NOT EXISTS (SELECT 1 FROM (SELECT {TX(9)[0]} AS px, {TX(9)[1]} AS py FROM ({PTS('customer', 'c_custkey')})) WHERE px = t.x AND py = t.y)",
    "first_tiles": f"SELECT z, x, y FROM ({TILES}) ORDER BY z, y, x LIMIT 10",
    "windowed_tile_counts": f"SELECT (epoch_us(ts) // 3600000000) * 3600 AS start_s, {TX(3)[0]} AS x, {TX(3)[1]} AS y, count(*) AS n_events FROM ({PTS('events', 'event_id')}) GROUP BY 1, 2, 3",
}
ORACLE["matrix_bounds"] = f"SELECT origin, z, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM ({ORACLE['tile_extents']}) GROUP BY 1, 2"

QUERIES = {n: globals()[n] for n in ORACLE}
