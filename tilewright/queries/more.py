"""Further queries: relations of ranges, pyramids, archives' levels, requested layers, collections, orders."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tilewright.functions import boxes, mercator
from tilewright.operators import blocks, layers, matrixsets, ranges
from tilewright.queries.grid import HW, LEVELS, PTS, R, RANGES, TILES, _ranges, _tiles, points
from tilewright.session import table
from tilewright.sources import tilejson


def range_relations(spark, d):
    r = _ranges(spark, d)
    return ranges.range_relations(r.withColumnRenamed("layer", "a_layer"), r.withColumnRenamed("layer", "b_layer"), "a_layer", "b_layer")


def tiles_in_pyramid(spark, d):
    return ranges.inside_pyramid(_tiles(spark, d), _ranges(spark, d))


def archive_levels(spark, d):
    """Levels and ranges of the quad for archives that cover a box around each nation's point."""
    p = points(table(spark, d, "nation"), "n_nationkey")
    e7 = lambda c: (c * 10_000_000).cast("int")
    k = F.col("n_nationkey")
    h = p.select("n_nationkey", e7(F.col("lon")).alias("min_lon_e7"), e7(F.col("lat")).alias("min_lat_e7"), e7(F.col("lon") + 7.5).alias("max_lon_e7"), e7(F.col("lat") + 4.25).alias("max_lat_e7"), (k % 5).cast("int").alias("min_zoom"), (k % 5 + 3).cast("int").alias("max_zoom"))
    quad = matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    return matrixsets.for_archives(h, quad, "n_nationkey").select("n_nationkey", "z", *ranges.BOUNDS)


def requested_layers(spark, d):
    return layers.requested_layers(table(spark, d, "tile_features"), ["water", "no such layer", "roads", "pois", "water"], ["z"])


def collection_members(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.split("c_name", "#").alias("parts"), (F.col("c_custkey") * 10).alias("first_id"))
    return layers.collection_members(c, "c_custkey", "parts", "first_id")


def matrix_order(spark, d):
    """Levels numbered again by falling scale, whatever the sets' own ids."""
    return matrixsets.renumbered(matrixsets.default_sets(spark)).select("set_id", "id", F.col("z").cast("int").alias("z"))


def matrix_documents(spark, d):
    """All default sets written as JSON and as XML, and read again."""
    out = None
    sets = matrixsets.default_sets(spark)
    for (name, *_), (kind, write, read) in product(matrixsets.DEFAULT_SETS, (("json", matrixsets.write_json, matrixsets.read_json), ("xml", matrixsets.write_xml, matrixsets.read_xml))):
        part = read(spark, write(sets.where(F.col("set_id") == name))).select(F.lit(kind).alias("document"), "set_id", "z", "id", "crs", F.round("resolution", 6).alias("resolution"), F.round("origin_x", 3).alias("origin_x"), "tile_width", "matrix_width", "matrix_height")
        out = part if out is None else out.unionByName(part)
    return out


def matrix_builder(spark, d):
    """A set for the extent of each region's nations: levels of halving resolution, as many tiles as cover it."""
    boxes = points(table(spark, d, "nation"), "n_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    rows = boxes.groupBy("n_regionkey").agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).orderBy("n_regionkey").collect()  # five of them
    out = None
    for key, *extent in rows:
        part = matrixsets.build(spark, f"region {key}", "CRS:84", tuple(extent), [1.0 / 2**z for z in range(6)], (64, 32), zooms=(1, 5))
        out = part if out is None else out.unionByName(part)
    return out.select("set_id", "z", F.round("resolution", 9).alias("resolution"), F.round("origin_x", 6).alias("origin_x"), F.round("origin_y", 6).alias("origin_y"), "matrix_width", "matrix_height", F.round("scale_denominator", 3).alias("scale"))


def matrix_extents(spark, d):
    """Bounding boxes of the quad's levels, whole and cut to the tiles of the features, and whether the one holds the other."""
    quad = matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    cut = ranges.bounding(_ranges(spark, d)).select(F.col("z").alias("cut_z"), *[F.col(c).alias(n) for c, n in zip(ranges.BOUNDS, ("left", "low", "right", "high"))])
    met = quad.join(cut, F.col("z") == F.col("cut_z")).drop("cut_z")
    outer = {"z": F.col("z"), "minx": F.lit(0).cast("long"), "miny": F.lit(0).cast("long"), "maxx": F.col("matrix_width") - 1, "maxy": F.col("matrix_height") - 1}
    inner = {"z": F.col("z"), "minx": F.col("left"), "miny": F.col("low"), "maxx": F.col("right"), "maxy": F.col("high")}
    b = matrixsets.bounds(met.withColumn("held", matrixsets.contains(outer, inner)).withColumn("turned", matrixsets.contains(inner, outer)))
    return b.select("z", *[F.round(c, 3).alias(c) for c in ranges.BOUNDS], "held", "turned")


def set_limits(spark, d):
    """Levels of the quad that a tileset's limits leave: rows and columns of the features' tiles, by the level's id."""
    lim = ranges.bounding(_ranges(spark, d)).select(F.col("z").cast("string").alias("tile_matrix"), F.col("miny").alias("min_row"), F.col("maxy").alias("max_row"), F.col("minx").alias("min_col"), F.col("maxx").alias("max_col"))
    quad = matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    return matrixsets.limits(quad, lim).select("z", "id", *ranges.BOUNDS)


def matrix_views(spark, d):
    """Levels 3 to 12 of the quad in a box, as a view of a view."""
    quad = matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    once = matrixsets.view(quad, min_zoom=3, box=(-1e7, -5e6, 2e7, 1.5e7))
    return matrixsets.view(once, max_zoom=12, box=(-2e6, -5e7, 3e7, 5e6)).select("z", *ranges.BOUNDS)


def tiles_and_points(spark, d):
    """Whether the tile of each nation's point at zoom 4 holds it, its neighbour to the right does, and meets a box around it."""
    p = points(table(spark, d, "nation"), "n_nationkey")
    mx, my = mercator.to_meters(F.col("lon"), F.col("lat"))
    x, y = mercator.tile_of_degrees(F.col("lon"), F.col("lat"), F.lit(4))
    q = p.select("n_nationkey", mx.alias("mx"), my.alias("my"), x.alias("x"), y.alias("y"))
    own, right = boxes.of_tile(F.lit(4), F.col("x"), F.col("y")), boxes.of_tile(F.lit(4), F.col("x") + 1, F.col("y"))
    around = boxes.centered(F.col("mx"), F.col("my"), F.lit(3e6), F.lit(1e6))
    return q.select("n_nationkey", boxes.contains(own, F.col("mx"), F.col("my")).alias("holds"), boxes.contains(right, F.col("mx"), F.col("my")).alias("right_holds"), boxes.intersects(right, around).alias("right_meets"), boxes.wkt(tuple(F.round(v).cast("long") for v in around)).alias("text"))


def tile_orders(spark, d):
    """Places of tiles in the order (x, y) and in traversal order (y, x) of their level."""
    compared = blocks.numbered(_tiles(spark, d), ["z"], "x", ["y"], "compared")
    return blocks.numbered(compared, ["z"], "y", ["x"], "traversed")


def metadata_changes(spark, d):
    """Copies of the metadata with a description where there is none, and layers that start a level later."""
    m = table(spark, d, "archive_metadata").where("vector_layers IS NOT NULL").select("archive_id", F.struct("description", "vector_layers").alias("doc"))
    later = tilejson.each_layer(F.col("doc.vector_layers"), lambda l: tilejson.with_value(l, "minzoom", l["minzoom"] + 1))
    doc = tilejson.with_value(tilejson.with_value(F.col("doc"), "description", F.coalesce("doc.description", F.lit("none"))), "vector_layers", later)
    m = m.select("archive_id", doc.alias("doc")).select("archive_id", "doc.*")
    return m.select("archive_id", "description", F.get("vector_layers", F.lit(0))["minzoom"].alias("first_minzoom"), F.aggregate("vector_layers", F.lit(0), lambda s, l: s + F.coalesce(l["minzoom"], F.lit(0))).alias("sum_minzoom"))


def zoom_rollup(spark, d):
    """An extension: features per zoom and layer with totals."""
    f = table(spark, d, "tile_features").where("z IS NOT NULL")
    return f.rollup("z", "layer").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


QUERIES = {f.__name__: f for f in (range_relations, tiles_in_pyramid, archive_levels, requested_layers, collection_members, matrix_order, matrix_documents, matrix_builder, matrix_extents, set_limits, matrix_views, tiles_and_points, tile_orders, metadata_changes, zoom_rollup)}

E7 = "trunc({} * 10000000)::BIGINT / 1e7::DOUBLE"


def MERCY(lat):
    return f"ln(tan(pi() / 4 + radians(greatest(least({lat}, 85.0511287798::DOUBLE), -85.0511287798::DOUBLE)) / 2)) * {R}"


ORACLE = {
    "range_relations": f"""WITH r AS ({RANGES})
SELECT a.layer AS a_layer, b.layer AS b_layer, z, b.minx >= a.minx AND b.maxx <= a.maxx AND b.miny >= a.miny AND b.maxy <= a.maxy AS contains,
       NOT (a.minx > b.maxx OR b.minx > a.maxx OR a.miny > b.maxy OR b.miny > a.maxy) AS intersects FROM r a JOIN r b USING (z)""",
    "tiles_in_pyramid": f"WITH r AS ({RANGES}) SELECT z, x, y FROM ({TILES}) t WHERE EXISTS (SELECT 1 FROM r WHERE r.z = t.z AND t.x BETWEEN minx AND maxx AND t.y BETWEEN miny AND maxy)",
    "archive_levels": f"""
WITH h AS (SELECT n_nationkey, {E7.format('lon')} AS w, {E7.format('lat')} AS s, {E7.format('(lon + 7.5::DOUBLE)')} AS e, {E7.format('(lat + 4.25::DOUBLE)')} AS n, n_nationkey % 5 AS z0, n_nationkey % 5 + 3 AS z1 FROM ({PTS('nation', 'n_nationkey')})),
b AS (SELECT n_nationkey, l.z, resolution * side AS t, l.n AS k, radians(w) * {R} AS x0, {MERCY('s')} AS y0, radians(e) * {R} AS x1, {MERCY('h.n')} AS y1 FROM h JOIN ({LEVELS}) l ON l.z BETWEEN z0 AND z1 WHERE set_id = 'WebMercatorQuad'),
c AS (SELECT n_nationkey, z, k, floor((x0 + {HW}) / t + 1e-6)::BIGINT AS a0, floor((x1 + {HW}) / t - 1e-6)::BIGINT AS a1, floor(({HW} - y1) / t + 1e-6)::BIGINT AS b0, floor(({HW} - y0) / t - 1e-6)::BIGINT AS b1 FROM b)
SELECT n_nationkey, z, greatest(a0, 0) AS minx, greatest(b0, 0) AS miny, least(a1, k - 1) AS maxx, least(b1, k - 1) AS maxy FROM c WHERE a1 >= 0 AND b1 >= 0 AND a0 < k AND b0 < k AND a1 >= a0 AND b1 >= b0""",
    "requested_layers": "SELECT DISTINCT z, f.layer, wish FROM tile_features f JOIN (VALUES ('water', 0), ('no such layer', 1), ('roads', 2), ('pois', 3)) w(layer, wish) ON f.layer = w.layer",
    "collection_members": "SELECT c_custkey, first_id, member_no, parts[member_no + 1] AS member, first_id + member_no AS member_id FROM (SELECT *, unnest(range(len(parts)))::INT AS member_no FROM (SELECT c_custkey, string_split(c_name, '#') AS parts, c_custkey * 10 AS first_id FROM customer))",
    "matrix_order": f"SELECT set_id, z::VARCHAR AS id, (row_number() OVER (PARTITION BY set_id ORDER BY resolution DESC) - 1)::INT AS z FROM ({LEVELS})",
    "matrix_documents": f"""SELECT k.document, set_id, z::INT AS z, z::VARCHAR AS id, crs, round(resolution, 6) AS resolution, round(origin_x, 3) AS origin_x, side AS tile_width, across * n AS matrix_width, down * n AS matrix_height
  FROM ({LEVELS}), (VALUES ('json'), ('xml')) k(document)""",
    "matrix_builder": f"""
WITH b AS (SELECT n_regionkey, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM ({PTS('nation', 'n_nationkey')}) GROUP BY 1), l AS (SELECT z::INT AS z, 1::DOUBLE / (1 << z) AS r FROM range(1, 6) g(z))
SELECT 'region ' || n_regionkey AS set_id, z, round(r, 9) AS resolution, round(x0, 6) AS origin_x, round(y1, 6) AS origin_y, ceil((x1 - x0) / (r * 64))::BIGINT AS matrix_width, ceil((y1 - y0) / (r * 32))::BIGINT AS matrix_height,
       round(r * 2 * pi() * {R} / 360 / 0.00028::DOUBLE, 3) AS scale FROM b, l""",
    "matrix_extents": f"""
WITH r AS ({RANGES}), b AS (SELECT z, min(minx) AS a, min(miny) AS b, max(maxx) AS c, max(maxy) AS d, 2 * {HW} / (1::BIGINT << z) AS s FROM r GROUP BY z)
SELECT z, round(a * s - {HW}, 3) AS minx, round({HW} - (d + 1) * s, 3) AS miny, round((c + 1) * s - {HW}, 3) AS maxx, round({HW} - b * s, 3) AS maxy, true AS held,
       a = 0 AND b = 0 AND c = (1::BIGINT << z) - 1 AND d = (1::BIGINT << z) - 1 AS turned FROM b""",
    "set_limits": f"WITH r AS ({RANGES}) SELECT z, z::VARCHAR AS id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM r GROUP BY z",
    "matrix_views": f"""
WITH l AS (SELECT z::INT AS z, 2 * {HW} / (1::BIGINT << z) AS s, (1::BIGINT << z) - 1 AS m FROM range(3, 13) g(z))
SELECT z, greatest(floor((-2e6::DOUBLE + {HW}) / s + 1e-6)::BIGINT, 0) AS minx, greatest(floor(({HW} - 5e6::DOUBLE) / s + 1e-6)::BIGINT, 0) AS miny,
       least(floor((2e7::DOUBLE + {HW}) / s - 1e-6)::BIGINT, m) AS maxx, least(floor(({HW} + 5e6::DOUBLE) / s - 1e-6)::BIGINT, m) AS maxy FROM l""",
    "tiles_and_points": f"""
WITH p AS (SELECT n_nationkey, radians(lon) * {R} AS mx, {MERCY('lat')} AS my FROM ({PTS('nation', 'n_nationkey')})), t AS (SELECT *, 2 * {HW} / 16 AS s, least(greatest(floor((mx + {HW}) / (2 * {HW} / 16))::BIGINT, 0), 15) AS x, least(greatest(floor(({HW} - my) / (2 * {HW} / 16))::BIGINT, 0), 15) AS y FROM p),
b AS (SELECT *, (x + 1) * s - {HW} AS e, {HW} - (y + 1) * s AS low, {HW} - y * s AS top FROM t)
SELECT n_nationkey, true AS holds, mx = e AS right_holds, mx - 1.5e6 <= e + s AND mx + 1.5e6 >= e AND my - 5e5 <= top AND my + 5e5 >= low AS right_meets,
       format('POLYGON (({{0}} {{1}}, {{2}} {{1}}, {{2}} {{3}}, {{0}} {{3}}, {{0}} {{1}}))', round(mx - 1.5e6)::BIGINT, round(my - 5e5)::BIGINT, round(mx + 1.5e6)::BIGINT, round(my + 5e5)::BIGINT) AS text FROM b""",
    "tile_orders": f"SELECT z, x, y, row_number() OVER (PARTITION BY z ORDER BY x, y) AS compared, row_number() OVER (PARTITION BY z ORDER BY y, x) AS traversed FROM ({TILES})",
    "metadata_changes": """SELECT archive_id, coalesce(description, 'none') AS description, vector_layers[1].minzoom + 1 AS first_minzoom,
  coalesce(list_sum([coalesce(l.minzoom + 1, 0) for l in vector_layers]), 0)::INT AS sum_minzoom FROM archive_metadata WHERE vector_layers IS NOT NULL""",
    "zoom_rollup": "SELECT z, layer, count(*) AS n, grouping_id(z, layer)::BIGINT AS level FROM tile_features WHERE z IS NOT NULL GROUP BY ROLLUP (z, layer)",
}
