"""Queries on the geometry and the attributes of features, of every kind and over whole tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import geometry, hilbert, tiles
from tilewright.operators import layers, matrixsets
from tilewright.plans.features import FeatureQuery, archive_features, plan
from tilewright.queries import archives, grid
from tilewright.session import scratch_path, table
from tilewright.sources import mvt, pmtiles, raster

#: The square to which features are clipped here: half a tile with a buffer of 64, so that something is cut.
EXTENT, BUFFER = 2048, 64
#: Added before rounding, so that no sum of sixteenths lies half-way between two results.
OFF = 0.000123
#: Two boxes of meters that overlap.
BOXES = ((-20037508.0, -1e7, 2e6, 1e7), (-5e6, -20037508.0, 20037508.0, 5e6))


def _streams(spark, d):
    return table(spark, d, "tile_features").select("tile_layer_id", "feature_id", "geom_type", "commands").distinct()


def geometry_decode(spark, d):
    """Geometries of all rows of features, of every kind: parts and vertices per layer of a tile, in tile pixels."""
    g = _streams(spark, d).select("tile_layer_id", mvt.geometry_parts("commands", "geom_type").alias("g")).select("tile_layer_id", "g.kind", "g.parts")
    p = g.withColumn("p", F.flatten("parts"))
    total = lambda c: F.sum(F.aggregate("p", F.lit(0).cast("long"), lambda s, q: s + q[c])).alias(f"sum_{c}")
    return p.groupBy("tile_layer_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("parts")).alias("n_parts"), F.sum(F.size("p")).alias("n_vertices"), total("x"), total("y"))


def geometry_roundtrip(spark, d):
    """Streams decoded, encoded and decoded again: how many have the same parts as before. Points of a line or ring that come
    twice in a row come back once."""
    g = _streams(spark, d).select("tile_layer_id", mvt.geometry_parts("commands", "geom_type").alias("g")).where("g IS NOT NULL")
    again = g.select("tile_layer_id", "g", mvt.geometry_parts(mvt.geometry_commands("g.parts", "g.kind"), F.col("g.kind")).alias("h"))
    flat = lambda c: F.array_sort(F.flatten(F.col(f"{c}.parts")))  # noqa: E731  # rings may be turned round, vertices stay
    return again.groupBy("tile_layer_id", F.col("g.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flat("g") == flat("h")).alias("n_same"))


def pixel_to_crs(spark, d):
    """All vertices of all features of all zooms in Web Mercator meters."""
    f = plan(FeatureQuery().at_all().in_meters(), table(spark, d, "tile_features"), table(spark, d, "tile_layers"), matrixsets.default_sets(spark))
    keep = ["z", "x", "y", "tile_layer_id", "feature_id", "kind"]
    v = f.select(*keep, F.posexplode("parts").alias("part", "p")).select(*keep, "part", F.posexplode("p").alias("vertex", "q"))
    return v.select(*keep, "part", "vertex", F.round("q.x", 2).alias("mx"), F.round("q.y", 2).alias("my")).distinct()


def cursor_deltas(spark, d):
    """Offsets from vertex to vertex, of all parts of each kind of stream, as streams store them: counts and sums per layer."""
    g = _streams(spark, d).select("tile_layer_id", mvt.geometry_parts("commands", "geom_type").alias("g")).select("tile_layer_id", F.col("g.kind").alias("kind"), F.explode(geometry.steps(F.flatten("g.parts"))).alias("s"))
    far = F.abs("s.dx") + F.abs("s.dy")
    return g.groupBy("tile_layer_id", "kind").agg(F.sum("s.dx").alias("sum_dx"), F.sum("s.dy").alias("sum_dy"), F.sum(far).alias("way"), F.max(far).alias("longest"))


def clip_points(spark, d):
    """Points of all streams in the square, snapped to whole pixels, through the encoder's preparation."""
    c = mvt.prepared(F.col("commands"), F.col("geom_type"), EXTENT, BUFFER)
    g = _streams(spark, d).where("geom_type = 'POINT'").select("tile_layer_id", F.flatten(mvt.geometry_parts(c, F.col("geom_type"))["parts"]).alias("p"))
    q = g.select("tile_layer_id", F.explode("p").alias("q"))
    return q.groupBy("tile_layer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("q.x").alias("sum_x"), F.sum("q.y").alias("sum_y"))


def _clipped(spark, d, kind):
    g = _streams(spark, d).select("tile_layer_id", mvt.clipped(F.col("commands"), F.col("geom_type"), EXTENT, BUFFER).alias("g"))
    return g.where(F.col("g.kind") == kind).select("tile_layer_id", F.col("g.parts").alias("parts"))


def _total(parts, of):
    return F.aggregate(F.transform(parts, of), F.lit(0.0), lambda s, v: s + v)


def clip_lines(spark, d):
    """Length of what of all lines lies in the square."""
    c = _clipped(spark, d, "LINESTRING")
    return c.groupBy("tile_layer_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_total("parts", geometry.line_length)) + OFF, 3).alias("length"))


def clip_polygons(spark, d):
    """Area of what of all rings lies in the square, holes and rings wound the other way counted as negative."""
    c = _clipped(spark, d, "POLYGON")
    return c.groupBy("tile_layer_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_total("parts", geometry.ring_area2)) / 2 + OFF, 3).alias("area"))


def extent_scaling(spark, d):
    """Vertices of all features in an extent of 256 instead of their own, and back again."""
    f = table(spark, d, "tile_features").where("extent > 0").select("tile_layer_id", "feature_id", "geom_type", "commands", "extent").distinct()
    g = f.select("tile_layer_id", "extent", mvt.geometry_parts("commands", "geom_type")["parts"].alias("p"))
    small = geometry.scaled(F.col("p"), F.lit(256.0) / F.col("extent"))
    back = geometry.scaled(small, F.col("extent") / F.lit(256.0))
    total = lambda parts, c: F.sum(_total(parts, lambda p: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[c])))
    return g.groupBy("tile_layer_id").agg(F.round(total(small, "x"), 3).alias("small_x"), F.round(total(small, "y"), 3).alias("small_y"), F.round(total(back, "x"), 3).alias("x"), F.round(total(back, "y"), 3).alias("y"))


def ring_area(spark, d):
    """Signed area of the rings that the values of each embedding make in pairs."""
    e = table(spark, d, "embeddings")
    n = F.floor(F.size("embedding") / 2).cast("int")
    pts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.round(F.get("embedding", i * 2) * 1000).cast("long").alias("x"), F.round(F.get("embedding", i * 2 + 1) * 1000).cast("long").alias("y")))
    return e.select("vec_id", (geometry.ring_area2(pts) / 2).alias("area"))


def _once(spark, d):
    """One delivery of each feature with a valid tile: the greatest, so that all of its columns belong together."""
    f = table(spark, d, "tile_features").where(tiles.is_valid(*map(F.col, "zxy")))
    rest = F.struct("z", "x", tiles.top_left_row(F.col("z"), F.col("y"), F.col("origin")).alias("y"), "layer", "extent", "geom_type", "tags", "commands")
    return f.groupBy("tile_layer_id", "feature_id").agg(F.max(rest).alias("f")).select("tile_layer_id", "feature_id", "f.*")


def mvt_roundtrip(spark, d):
    """Tiles built from the features with their attributes, and decoded again."""
    rows = layers.attributes(_once(spark, d), table(spark, d, "tile_layers"))
    back = mvt.decode(mvt.encode(rows))
    return back.groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("attributes")).alias("n_attributes"), F.sum(F.size("commands")).alias("n_commands"))


def mvt_types(spark, d):
    """The same with typed attributes: values of each kind that come back, with what they are."""
    rows = layers.attributes(_once(spark, d), table(spark, d, "tile_layers"), typed=True)
    back = mvt.decode(mvt.encode(rows), typed=True)
    v = back.select("layer", F.explode("attributes").alias("key", "v"))
    return v.groupBy("layer", "key", layers.value_kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(layers.value_text(F.col("v"))).alias("low"), F.max(layers.value_text(F.col("v"))).alias("high"))


def archive_query(spark, d):
    """Features of two layers in two boxes at zoom 9, with two attributes at least, from an archive of the vector tiles of
    all features: the way from an extent to features over the archive's directory."""
    rows = layers.attributes(_once(spark, d).where("layer IS NOT NULL"), table(spark, d, "tile_layers"))
    made = mvt.encode(rows).select(hilbert.checked_tile_id(*map(F.col, "zxy")).alias("tile_id"), "payload")
    path = scratch_path(spark, "archive") + "/tiles.pmtiles"
    pmtiles.write(made, path, leaf_entries=16)
    q = FeatureQuery().within(*BOXES).at(9).of("roads", "water", "pois").matching(F.size("attributes") >= 2)
    quad = matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    return archive_features(q, spark, path, quad).select("z", "x", "y", "layer", "feature_id", "kind", F.size("attributes").alias("n_attributes"), F.size("commands").alias("n_commands"))


def feature_texts(spark, d):
    """Points of zoom 9 in tile pixels as well-known text, and as binary that says the same, of features that a condition in
    Python lets through; with a step on the result."""
    q = FeatureQuery().at(9).keeping(lambda b: b["feature_id"] > 2).mapped(lambda df: df.where("kind = 'POINT'"))
    f, t, quad = table(spark, d, "tile_features"), table(spark, d, "tile_layers"), matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    key = ["z", "x", "y", "tile_layer_id", "feature_id"]
    text = plan(q.written_as("wkt"), f, t, quad).select(*key, "wkt").distinct()
    raw = plan(q.written_as("wkb"), f, t, quad).select(*key, F.hex("wkb").alias("wkb")).distinct()
    return text.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("wkt")), "; ").alias("texts")).join(raw.groupBy(*key).agg(F.count(F.lit(1)).alias("n_binary"), F.min(F.substring("wkb", 1, 2)).alias("order")), key)


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("rings", "vertices", "crossing")]))
def _soundness(parts: pa.Array) -> pa.Array:
    """Rings, vertices, and rings that cross themselves or have no area."""
    rows = [[[(q["x"], q["y"]) for q in ring] for ring in p or ()] for p in parts.to_pylist()]
    cols = ([len(p) for p in rows], [sum(map(len, p)) for p in rows], [sum(len(r) < 3 or not geometry.area2(r) or geometry.crosses_itself(r) for r in p) for p in rows])
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["rings", "vertices", "crossing"])


def simplify_rings(spark, d):
    """Polygons simplified by 20 pixels: as many rings as before, no more vertices, and none that crosses itself, of those
    features whose rings didn't."""
    g = _streams(spark, d).where("geom_type = 'POLYGON' AND commands IS NOT NULL")
    made = mvt.prepared(F.col("commands"), F.col("geom_type"), 1 << 20, 1 << 20, 20.0)
    parts = lambda c: mvt.geometry_parts(c, F.col("geom_type"))["parts"]
    both = g.select("tile_layer_id", _soundness(parts(F.col("commands"))).alias("a"), _soundness(parts(made)).alias("b"))
    sound = F.col("a.crossing") == 0
    return both.groupBy("tile_layer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a.rings") != F.col("b.rings")).alias("n_lost"), F.count_if(F.col("a.vertices") < F.col("b.vertices")).alias("n_longer"), F.count_if(sound & (F.col("b.crossing") > 0)).alias("n_crossing"),
    )


def simplify_lines(spark, d):
    """Lines simplified not at all, and beyond any width, where the ends of each part are left."""
    g = _streams(spark, d).where("geom_type = 'LINESTRING'")
    count = lambda t: F.sum(F.size(F.flatten(mvt.geometry_parts(mvt.prepared(F.col("commands"), F.col("geom_type"), 1 << 20, 1 << 20, t), F.col("geom_type"))["parts"])))
    return g.groupBy("tile_layer_id").agg(count(0.0).alias("n_all"), count(1e9).alias("n_ends"))


def small_parts(spark, d):
    """Lines shorter than 500 pixels and rings of less than 5,000 are left out."""
    g = _streams(spark, d).where("geom_type IN ('LINESTRING', 'POLYGON')")
    made = mvt.prepared(F.col("commands"), F.col("geom_type"), 1 << 20, 1 << 20, 0.0, 500.0, 5000.0)
    return g.select("tile_layer_id", "geom_type", F.size(mvt.geometry_parts(made, F.col("geom_type"))["parts"]).alias("k")).groupBy("tile_layer_id", "geom_type").agg(F.sum("k").alias("n_parts"))


def stream_texts(spark, d):
    """Streams of single points spelled out, and of lines the second vertex, by a slice."""
    g = _streams(spark, d).where("commands IS NOT NULL")
    p = g.select("tile_layer_id", "feature_id", mvt.commands_text("commands").alias("text"), mvt.geometry_parts("commands", "geom_type").alias("g"))
    point = p.where("g.kind = 'POINT' AND size(g.parts) = 1").select("tile_layer_id", "feature_id", F.lit("point").alias("what"), "text")
    q = geometry.slice_of(F.get("g.parts", F.lit(0)), 1, 2)[0]
    line = p.where("g.kind = 'LINESTRING' AND size(g.parts) > 0").select("tile_layer_id", "feature_id", F.lit("second vertex").alias("what"), F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string")).alias("text"))
    return point.unionByName(line).distinct()


def raster_pixels(spark, d):
    """PNG images made of nations' numbers, of 1 to 4 channels and by several filters, decoded: sizes and sums of their pixels."""
    rows = table(spark, d, "nation").select("n_nationkey").collect()  # 25 of them
    images = []
    for (k,) in rows:
        width, height, channels = 3 + k % 5, 2 + k % 7, 1 + k % 4
        data = bytes((i * (k + 3)) % 256 for i in range(width * height * channels))
        images.append((k, bytearray(raster.encode_png(width, height, channels, data, k % 3))))
    df = spark.createDataFrame(images, "n_nationkey int, payload binary")
    p = df.select("n_nationkey", raster.image_of("payload")["kind"].alias("kind"), raster.pixels_of("payload").alias("p"))
    total = F.aggregate(F.sequence(F.lit(1), F.octet_length("p.data")), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.hex(F.substr("p.data", i, F.lit(1))), 16, 10).cast("long"))
    return p.select("n_nationkey", "kind", "p.width", "p.height", "p.channels", total.alias("sum"))


def layer_attributes(spark, d):
    """Names of the attributes that the features of each layer have."""
    return layers.attribute_names(_once(spark, d), table(spark, d, "tile_layers"))


QUERIES = {f.__name__: f for f in (geometry_decode, geometry_roundtrip, pixel_to_crs, cursor_deltas, clip_points, clip_lines, clip_polygons, extent_scaling, ring_area, mvt_roundtrip, mvt_types, archive_query, feature_texts, layer_attributes, simplify_rings, simplify_lines, small_parts, stream_texts, raster_pixels)}

NUMBER = "(commands[i]::BIGINT & 4294967295)"
STEP = f"(CASE WHEN {NUMBER} % 2 = 0 THEN {NUMBER} // 2 ELSE -(({NUMBER} + 1) // 2) END)"
STEP_2 = STEP.replace("[i]", "[i + 1]")
#: Vertices of command streams, one command or pair of numbers at a time; lines of one point and rings without area fall out.
#: Streams that differ in kind are walked once.
VERTICES = f"""s AS (SELECT DISTINCT commands FROM tile_features WHERE commands IS NOT NULL),
w AS (SELECT commands, 1 AS i, 0 AS op, 0::BIGINT AS left_, 0::BIGINT AS px, 0::BIGINT AS py, 0 AS no, false AS point FROM s
  UNION ALL
  SELECT commands, i + CASE WHEN left_ = 0 THEN 1 ELSE 2 END, CASE WHEN left_ = 0 THEN commands[i] & 7 ELSE op END,
         CASE WHEN left_ > 0 THEN left_ - 1 WHEN commands[i] & 7 = 7 THEN 0 ELSE {NUMBER} >> 3 END,
         px + CASE WHEN left_ > 0 THEN {STEP} ELSE 0 END, py + CASE WHEN left_ > 0 THEN {STEP_2} ELSE 0 END, no + CASE WHEN left_ > 0 AND op = 1 THEN 1 ELSE 0 END, left_ > 0
  FROM w WHERE i <= len(commands)),
k AS (SELECT commands, CASE WHEN bool_or(op = 7) THEN 'POLYGON' WHEN bool_or(op = 2) THEN 'LINESTRING' ELSE 'POINT' END AS told FROM w GROUP BY 1),
v AS (SELECT commands, no, px, py, row_number() OVER (PARTITION BY commands, no ORDER BY i) - 1 AS vertex FROM w WHERE point),
e AS (SELECT *, lead(px) OVER o AS lx, lead(py) OVER o AS ly, first(px) OVER o AS fx, first(py) OVER o AS fy FROM v WINDOW o AS (PARTITION BY commands, no ORDER BY vertex)),
a AS (SELECT commands, no, count(*) AS n, sum(px * coalesce(ly, fy) - coalesce(lx, fx) * py) AS area2 FROM e GROUP BY 1, 2)"""
KIND = "CASE WHEN geom_type IN ('POINT', 'LINESTRING', 'POLYGON') THEN geom_type ELSE told END"
KEPT = "CASE kind WHEN 'LINESTRING' THEN a.n > 1 WHEN 'POLYGON' THEN a.n > 2 AND area2 <> 0 ELSE true END"
STREAMS = f"f AS (SELECT d.*, {KIND} AS kind, row_number() OVER () AS id FROM (SELECT DISTINCT tile_layer_id, feature_id, geom_type, commands FROM tile_features) d LEFT JOIN k USING (commands))"
LOW, HIGH = f"{-BUFFER}::DOUBLE", f"{EXTENT + BUFFER}::DOUBLE"


def NEAR(v, dv):
    """Where a segment enters and leaves the square's span of one coordinate, as parts of its length."""
    return f"CASE WHEN {dv} > 0 THEN ({LOW} - {v}) / {dv} WHEN {dv} < 0 THEN ({HIGH} - {v}) / {dv} WHEN {v} BETWEEN {LOW} AND {HIGH} THEN 0 ELSE 2 END", f"CASE WHEN {dv} > 0 THEN ({HIGH} - {v}) / {dv} WHEN {dv} < 0 THEN ({LOW} - {v}) / {dv} ELSE 1 END"


def HELD(v):
    return f"greatest(least({v}, {HIGH}), {LOW})"


def WIDTH(v):
    """The integral over v of how far a coordinate reaches into the square's span."""
    return f"(CASE WHEN {v} <= {LOW} THEN 0 WHEN {v} >= {HIGH} THEN ({HIGH} - {LOW}) * ({v} - ({HIGH} + {LOW}) / 2) ELSE ({v} - {LOW}) ** 2 / 2 END)"


#: As of each feature's key the greatest delivery holds, arrays compared number by number.
ONCE = f"""SELECT tile_layer_id, feature_id, f.* FROM (SELECT tile_layer_id, feature_id, max(struct_pack(z := z, x := x, y := {archives.TOP}, layer := layer, extent := extent, geom_type := geom_type, tags := tags, commands := commands)) AS f
  FROM tile_features WHERE {archives.VALID_ROWS} GROUP BY 1, 2)"""
HAS = f"""p AS (SELECT *, v FROM ({archives.PAIRS.format(features=f"SELECT tile_layer_id, feature_id, tags, layer FROM ({ONCE})").replace("tags, layer_keys", "tags, layer, layer_keys").replace(" AS value, i", " AS value, v, i").replace("SELECT f.*, l.layer_keys", "SELECT f.*, l.layer_keys")})),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_layer_id, feature_id, key ORDER BY i DESC) AS rn FROM p WHERE value IS NOT NULL) WHERE rn = 1)"""

ORACLE = {
    "geometry_decode": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
t AS (SELECT commands, no, count(*) AS n, sum(px) AS sx, sum(py) AS sy FROM v GROUP BY 1, 2), p AS (SELECT t.*, a.area2 FROM t JOIN a USING (commands, no))
SELECT tile_layer_id, kind, count(DISTINCT id) AS n, count(a.n) AS n_parts, sum(a.n)::BIGINT AS n_vertices, sum(sx)::BIGINT AS sum_x, sum(sy)::BIGINT AS sum_y
FROM f g LEFT JOIN p a ON g.commands = a.commands AND {KEPT} GROUP BY 1, 2""",
    "geometry_roundtrip": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
t AS (SELECT DISTINCT id FROM f JOIN a ON f.commands = a.commands AND {KEPT} JOIN e ON e.commands = a.commands AND e.no = a.no
      WHERE kind <> 'POINT' AND px = coalesce(lx, CASE kind WHEN 'POLYGON' THEN fx END) AND py = coalesce(ly, CASE kind WHEN 'POLYGON' THEN fy END))
SELECT tile_layer_id, kind, count(*) AS n, count(*) - count(t.id) AS n_same FROM f LEFT JOIN t USING (id) WHERE commands IS NOT NULL GROUP BY 1, 2""",
    "pixel_to_crs": f"""WITH RECURSIVE {VERTICES},
f AS (SELECT DISTINCT z, x, {archives.TOP} AS y, extent, tile_layer_id, feature_id, commands, {KIND} AS kind, 2 * {grid.HW} / (1::BIGINT << z) AS s FROM tile_features JOIN k USING (commands) WHERE {archives.VALID_ROWS}),
r AS (SELECT commands, kind, no, row_number() OVER (PARTITION BY commands, kind ORDER BY no) - 1 AS part FROM (SELECT DISTINCT commands, kind FROM f) JOIN a USING (commands) WHERE {KEPT})
SELECT DISTINCT z, x, y, tile_layer_id, feature_id, kind, part::INT AS part, vertex::INT AS vertex, round(x * s - {grid.HW} + px * s / extent, 2) AS mx, round({grid.HW} - y * s - py * s / extent, 2) AS my
FROM f JOIN r USING (commands, kind) JOIN v USING (commands, no)""",
    "cursor_deltas": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
q AS (SELECT tile_layer_id, kind, px - coalesce(lag(px) OVER o, 0) AS dx, py - coalesce(lag(py) OVER o, 0) AS dy FROM f JOIN a ON f.commands = a.commands AND {KEPT} JOIN v ON v.commands = a.commands AND v.no = a.no WINDOW o AS (PARTITION BY id ORDER BY v.no, vertex))
SELECT tile_layer_id, kind, sum(dx)::BIGINT AS sum_dx, sum(dy)::BIGINT AS sum_dy, sum(abs(dx) + abs(dy))::BIGINT AS way, max(abs(dx) + abs(dy))::INT AS longest FROM q GROUP BY 1, 2""",
    "clip_points": f"""WITH RECURSIVE {VERTICES}, {STREAMS}
SELECT tile_layer_id, count(*) AS n, sum(px)::BIGINT AS sum_x, sum(py)::BIGINT AS sum_y FROM f JOIN v USING (commands) WHERE geom_type = 'POINT' AND px BETWEEN {LOW} AND {HIGH} AND py BETWEEN {LOW} AND {HIGH} GROUP BY 1""",
    "clip_lines": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
g AS (SELECT commands, px::DOUBLE AS x, py::DOUBLE AS y, (lx - px)::DOUBLE AS dx, (ly - py)::DOUBLE AS dy FROM e WHERE lx IS NOT NULL),
t AS (SELECT commands, sum(greatest(least(1, {NEAR('x', 'dx')[1]}, {NEAR('y', 'dy')[1]}) - greatest(0, {NEAR('x', 'dx')[0]}, {NEAR('y', 'dy')[0]}), 0) * sqrt(dx * dx + dy * dy)) AS n FROM g GROUP BY 1)
SELECT tile_layer_id, count(*) AS n, round(coalesce(sum(t.n), 0) + {OFF}, 3) AS length FROM f LEFT JOIN t USING (commands) WHERE kind = 'LINESTRING' GROUP BY 1""",
    "clip_polygons": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
g AS (SELECT e.commands, px::DOUBLE AS x, py::DOUBLE AS y, coalesce(lx, fx)::DOUBLE AS x2, coalesce(ly, fy)::DOUBLE AS y2 FROM e JOIN a USING (commands, no) WHERE a.n > 2 AND area2 <> 0),
h AS (SELECT commands, {HELD('y2')} - {HELD('y')} AS dy, x + ({HELD('y')} - y) * (x2 - x) / (y2 - y) AS xa, x + ({HELD('y2')} - y) * (x2 - x) / (y2 - y) AS xb FROM g WHERE y2 <> y),
t AS (SELECT commands, sum(dy * CASE WHEN xa = xb THEN {HELD('xa')} - {LOW} ELSE ({WIDTH('xb')} - {WIDTH('xa')}) / (xb - xa) END) AS n FROM h GROUP BY 1)
SELECT tile_layer_id, count(*) AS n, round(coalesce(sum(t.n), 0) + {OFF}, 3) AS area FROM f LEFT JOIN t USING (commands) WHERE kind = 'POLYGON' GROUP BY 1""",
    "extent_scaling": f"""WITH RECURSIVE {VERTICES},
f AS (SELECT d.*, {KIND} AS kind FROM (SELECT DISTINCT tile_layer_id, feature_id, geom_type, commands, extent FROM tile_features WHERE extent > 0) d LEFT JOIN k USING (commands)),
t AS (SELECT commands, no, sum(px) AS sx, sum(py) AS sy FROM v GROUP BY 1, 2), p AS (SELECT t.*, a.n, a.area2 FROM t JOIN a USING (commands, no))
SELECT tile_layer_id, round(sum(sx * 256::DOUBLE / extent), 3) AS small_x, round(sum(sy * 256::DOUBLE / extent), 3) AS small_y, round(sum(sx)::DOUBLE, 3) AS x, round(sum(sy)::DOUBLE, 3) AS y
FROM f LEFT JOIN p a ON f.commands = a.commands AND {KEPT} GROUP BY 1""",
    "ring_area": """
WITH p AS (SELECT vec_id, n, i, round(embedding[2 * i + 1]::DOUBLE * 1000)::BIGINT AS x, round(embedding[2 * i + 2]::DOUBLE * 1000)::BIGINT AS y FROM (SELECT *, len(embedding) // 2 AS n, unnest(range(len(embedding) // 2)) AS i FROM embeddings))
SELECT a.vec_id, sum(a.x * b.y - b.x * a.y)::DOUBLE / 2 AS area FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % a.n GROUP BY 1""",
    "mvt_roundtrip": f"""
WITH once AS ({ONCE}), {HAS}, c AS (SELECT tile_layer_id, feature_id, count(*) AS n_attributes FROM o GROUP BY 1, 2)
SELECT z, x, y, layer, count(*) AS n, sum(coalesce(n_attributes, 0))::BIGINT AS n_attributes, sum(coalesce(len(commands), 0))::BIGINT AS n_commands FROM once LEFT JOIN c USING (tile_layer_id, feature_id) GROUP BY 1, 2, 3, 4""",
    "mvt_types": f"""
WITH {HAS}
SELECT layer, key, CASE WHEN v.string_value IS NOT NULL THEN 'string' WHEN v.float_value IS NOT NULL THEN 'float' WHEN v.double_value IS NOT NULL THEN 'double' WHEN v.int_value IS NOT NULL THEN 'int'
  WHEN v.uint_value IS NOT NULL THEN 'uint' WHEN v.sint_value IS NOT NULL THEN 'sint' WHEN v.bool_value IS NOT NULL THEN 'bool' END AS kind, count(*) AS n, min(value) AS low, max(value) AS high FROM o WHERE layer IS NOT NULL GROUP BY 1, 2, 3""",
    "archive_query": f"""
WITH RECURSIVE {VERTICES}, l AS (SELECT 2 * {grid.HW} / 512 AS s), b AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(f'{v!r}::DOUBLE' for v in box) + ')' for box in BOXES)}) t(a, b, c, d)),
r AS (SELECT greatest(floor((a + {grid.HW}) / s + 1e-6)::BIGINT, 0) AS x0, least(floor((c + {grid.HW}) / s - 1e-6)::BIGINT, 511) AS x1, greatest(floor(({grid.HW} - d) / s + 1e-6)::BIGINT, 0) AS y0, least(floor(({grid.HW} - b) / s - 1e-6)::BIGINT, 511) AS y1 FROM b, l),
once AS ({ONCE}), {HAS}, c AS (SELECT tile_layer_id, feature_id, count(*) AS n_attributes FROM o GROUP BY 1, 2)
SELECT z, x, y, layer, feature_id, {KIND} AS kind, n_attributes::INT AS n_attributes, len(commands)::INT AS n_commands
FROM once JOIN c USING (tile_layer_id, feature_id) LEFT JOIN k USING (commands) WHERE z = 9 AND layer IN ('roads', 'water', 'pois') AND n_attributes >= 2 AND EXISTS (SELECT 1 FROM r WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""",
    "feature_texts": f"""WITH RECURSIVE {VERTICES},
f AS (SELECT DISTINCT z, x, {archives.TOP} AS y, tile_layer_id, feature_id, commands, {KIND} AS kind FROM tile_features JOIN k USING (commands) WHERE z = 9 AND feature_id > 2 AND {archives.VALID_ROWS}),
t AS (SELECT commands, CASE WHEN count(*) = 1 THEN format('POINT ({{}} {{}})', any_value(px), any_value(py)) ELSE 'MULTIPOINT (' || string_agg(format('({{}} {{}})', px, py), ', ' ORDER BY no) || ')' END AS text FROM v GROUP BY 1),
d AS (SELECT DISTINCT z, x, y, tile_layer_id, feature_id, text FROM f JOIN t USING (commands) WHERE kind = 'POINT')
SELECT z, x, y, tile_layer_id, feature_id, string_agg(text, '; ' ORDER BY text) AS texts, count(*) AS n_binary, '01' AS order FROM d GROUP BY 1, 2, 3, 4, 5""",
    "simplify_rings": "SELECT tile_layer_id, count(*) AS n, 0::BIGINT AS n_lost, 0::BIGINT AS n_longer, 0::BIGINT AS n_crossing FROM (SELECT DISTINCT tile_layer_id, feature_id, commands FROM tile_features WHERE geom_type = 'POLYGON' AND commands IS NOT NULL) GROUP BY 1",
    "simplify_lines": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
q AS (SELECT e.commands, e.no, count(*) FILTER (lx IS NULL OR px <> lx OR py <> ly) AS n FROM e GROUP BY 1, 2)
SELECT tile_layer_id, sum(CASE WHEN q.n > 1 THEN q.n ELSE 0 END)::BIGINT AS n_all, sum(CASE WHEN q.n > 1 AND (h.x0, h.y0) <> (h.x1, h.y1) THEN 2 ELSE 0 END)::BIGINT AS n_ends
FROM f LEFT JOIN a ON f.commands = a.commands AND a.n > 1 LEFT JOIN q ON q.commands = a.commands AND q.no = a.no
LEFT JOIN (SELECT commands, no, arg_min(px, vertex) AS x0, arg_min(py, vertex) AS y0, arg_max(px, vertex) AS x1, arg_max(py, vertex) AS y1 FROM v GROUP BY 1, 2) h ON h.commands = a.commands AND h.no = a.no
WHERE geom_type = 'LINESTRING' GROUP BY 1""",
    "small_parts": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
q AS (SELECT commands, no, sum(sqrt((lx - px) ** 2 + (ly - py) ** 2)) AS length FROM e WHERE lx IS NOT NULL GROUP BY 1, 2)
SELECT tile_layer_id, geom_type, count(a.no) FILTER (CASE geom_type WHEN 'LINESTRING' THEN a.n > 1 AND length >= 500 ELSE a.n > 2 AND abs(area2) / 2 >= 5000 END) AS n_parts
FROM f LEFT JOIN a ON f.commands = a.commands LEFT JOIN q ON q.commands = a.commands AND q.no = a.no WHERE geom_type IN ('LINESTRING', 'POLYGON') AND f.commands IS NOT NULL GROUP BY 1, 2""",
    "stream_texts": f"""WITH RECURSIVE {VERTICES}, {STREAMS},
c AS (SELECT commands, count(*) AS parts FROM a GROUP BY 1),
l AS (SELECT f.tile_layer_id, feature_id, f.id, f.commands, min(a.no) AS no FROM f JOIN a ON f.commands = a.commands AND a.n > 1 WHERE kind = 'LINESTRING' GROUP BY 1, 2, 3, 4)
SELECT DISTINCT tile_layer_id, feature_id, 'point' AS what, printf('MoveTo(1): (%+d,%+d)', px, py) AS text FROM f JOIN c USING (commands) JOIN v USING (commands) WHERE kind = 'POINT' AND parts = 1
UNION SELECT tile_layer_id, feature_id, 'second vertex', px || ' ' || py FROM l JOIN v ON v.commands = l.commands AND v.no = l.no AND vertex = 1""",
    "raster_pixels": """
SELECT n_nationkey, 'png' AS kind, (3 + n_nationkey % 5)::INT AS width, (2 + n_nationkey % 7)::INT AS height, (1 + n_nationkey % 4)::INT AS channels,
       list_sum([(i * (n_nationkey + 3)) % 256 for i in range((3 + n_nationkey % 5) * (2 + n_nationkey % 7) * (1 + n_nationkey % 4))])::BIGINT AS sum FROM nation""",
    "layer_attributes": f"WITH {HAS} SELECT DISTINCT layer, key AS name FROM o WHERE layer IS NOT NULL",
}
