"""Tile matrix sets as rows: set_id, z, crs, resolution, scale_denominator, origin and size of each matrix."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import grids
from tilewright.functions.mercator import HALF_WORLD

SCHEMA = "set_id string, z int, id string, crs string, resolution double, scale_denominator double, origin_x double, origin_y double, origin string, tile_width int, tile_height int, matrix_width long, matrix_height long"

#: Set, system, zoom levels, tiles across and down at level 0, side of a tile in pixels, west and north edge, width of the world.
DEFAULT_SETS = [
    ("EPSG4326", "EPSG:4326", 22, 2, 1, 256, -180.0, 90.0, 360.0),
    ("EPSG4326x2", "EPSG:4326", 22, 2, 1, 512, -180.0, 90.0, 360.0),
    ("EPSG3857", "EPSG:3857", 25, 1, 1, 256, -HALF_WORLD, HALF_WORLD, 2 * HALF_WORLD),
    ("EPSG3857x2", "EPSG:3857", 25, 1, 1, 512, -HALF_WORLD, HALF_WORLD, 2 * HALF_WORLD),
    ("WebMercatorQuad", "EPSG:3857", 25, 1, 1, 256, -HALF_WORLD, HALF_WORLD, 2 * HALF_WORLD),
    ("WebMercatorQuadx2", "EPSG:3857", 25, 1, 1, 512, -HALF_WORLD, HALF_WORLD, 2 * HALF_WORLD),
    ("WorldCRS84Quad", "CRS:84", 18, 2, 1, 256, -180.0, 90.0, 360.0),
    ("WorldCRS84Quadx2", "CRS:84", 18, 2, 1, 512, -180.0, 90.0, 360.0),
]

#: Well-known scale sets, as scale denominators from the coarsest on; (name, first, steps of halving) or a list.
SCALE_SETS: list[tuple[str, str, Sequence[float]]] = [
    ("GlobalCRS84Scale", "CRS:84", [5e8, 2.5e8, 1e8, 5e7, 2.5e7, 1e7, 5e6, 2.5e6, 1e6, 5e5, 2.5e5, 1e5, 5e4, 2.5e4, 1e4, 5e3, 2.5e3, 1e3, 5e2, 2.5e2, 1e2]),
    ("GoogleCRS84Quad", "CRS:84", [559082264.0287178 / 2**z for z in range(19)]),
    ("GoogleMapsCompatible", "EPSG:3857", [559082264.0287178 / 2**z for z in range(19)]),
]


def default_sets(spark: SparkSession) -> DataFrame:
    """All default sets. Resolutions halve from level to level; a set with larger tiles has coarser pixels' tiles, not a larger world."""
    sets = spark.createDataFrame(DEFAULT_SETS, "set_id string, crs string, levels int, across long, down long, side int, origin_x double, origin_y double, world double")
    rows = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("z")).withColumn("n", F.pow(F.lit(2.0), F.col("z")).cast("long"))
    resolution = F.col("world") / (F.col("across") * F.col("n") * F.col("side"))
    return rows.select(
        "set_id", "z", F.col("z").cast("string").alias("id"), "crs", resolution.alias("resolution"), grids.scale_of_resolution(resolution, F.col("crs")).alias("scale_denominator"),
        "origin_x", "origin_y", F.lit("TOP_LEFT").alias("origin"), F.col("side").alias("tile_width"), F.col("side").alias("tile_height"),
        (F.col("across") * F.col("n")).alias("matrix_width"), (F.col("down") * F.col("n")).alias("matrix_height"),
    )


def scale_sets(spark: SparkSession) -> DataFrame:
    rows = [(name, crs, z, float(d)) for name, crs, all_d in SCALE_SETS for z, d in enumerate(all_d)]
    df = spark.createDataFrame(rows, "name string, crs string, z int, scale_denominator double")
    return df.withColumn("resolution", grids.resolution_of_scale(F.col("scale_denominator"), F.col("crs")))


def zoom_for_resolution(wishes: DataFrame, levels: DataFrame, key: str, strategy: str = "SPEED") -> DataFrame:
    """key, z: the level whose resolution is closest to the wish; SPEED steps to the coarser level where it is finer than
    wished, QUALITY to the finer one where it is coarser. Ties take the lower level. Levels are a set's few rows."""
    if strategy not in ("SPEED", "QUALITY"):
        raise ValueError(strategy)
    few = F.broadcast(levels.select("z", F.col("resolution").alias("r")))
    low, high = F.min("z"), F.max("z")
    best = F.min_by(F.struct("z", "r"), F.struct(F.abs(F.col("r") - F.col("wish")), F.col("z")))
    picked = wishes.select(key, F.col("resolution").alias("wish")).distinct().join(few).groupBy(key, "wish").agg(best.alias("b"), low.alias("low"), high.alias("high"))
    z = F.when((F.lit(strategy) == "SPEED") & (F.col("b.r") < F.col("wish")), F.greatest(F.col("b.z") - 1, "low"))
    z = z.when((F.lit(strategy) == "QUALITY") & (F.col("b.r") > F.col("wish")), F.least(F.col("b.z") + 1, "high")).otherwise(F.col("b.z"))
    return picked.select(key, z.alias("z"))


def view(matrices: DataFrame, min_zoom: int | None = None, max_zoom: int | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A subset of levels, each with the range of tiles that meet the box. Views of views compose: filters are merged."""
    out = matrices
    if min_zoom is not None:
        out = out.where(F.col("z") >= min_zoom)
    if max_zoom is not None:
        out = out.where(F.col("z") <= max_zoom)
    edges = [F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("matrix_width") - 1, F.col("matrix_height") - 1]
    if box is not None:
        edges = grids.box_range(*[F.lit(float(v)) for v in box], F.col("origin_x"), F.col("origin_y"), F.col("resolution") * F.col("tile_width"), F.col("matrix_width"), F.col("matrix_height"))
    names = ["minx", "miny", "maxx", "maxy"]
    if set(names) <= set(matrices.columns):
        edges = [(F.greatest if n.startswith("min") else F.least)(F.col(n), e) if box is not None else F.col(n) for n, e in zip(names, edges)]
    found = out.select(*[c for c in out.columns if c not in names], *[e.alias(n) for n, e in zip(names, edges)])
    return found.where((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")))


def limits(matrices: DataFrame, set_limits: DataFrame) -> DataFrame:
    """Matrices with the rows and columns that a tileset's limits (tile_matrix, min_row, max_row, min_col, max_col) leave."""
    joined = matrices.join(set_limits, matrices["id"] == set_limits["tile_matrix"])
    return joined.withColumns({"minx": F.col("min_col"), "miny": F.col("min_row"), "maxx": F.col("max_col"), "maxy": F.col("max_row")}).select(*matrices.columns, "minx", "miny", "maxx", "maxy")


def read_json(spark: SparkSession, text: str) -> DataFrame:
    """A set from its JSON document; levels are numbered by falling scale, and each matrix keeps its tile size."""
    doc = json.loads(text)
    crs = doc.get("crs") or doc.get("supportedCRS") or ""
    crs = crs if isinstance(crs, str) else crs.get("uri", "")
    rows = []
    for m in doc.get("tileMatrices") or doc.get("tileMatrix") or []:
        at = m.get("pointOfOrigin") or m.get("topLeftCorner")
        rows.append((str(m["id"]), m.get("scaleDenominator"), m.get("cellSize"), float(at[0]), float(at[1]), "BOTTOM_LEFT" if str(m.get("cornerOfOrigin", "topLeft")).lower() == "bottomleft" else "TOP_LEFT", int(m["tileWidth"]), int(m["tileHeight"]), int(m["matrixWidth"]), int(m["matrixHeight"])))
    return _rows(spark, doc.get("id") or doc.get("identifier"), crs, rows)


def read_xml(spark: SparkSession, text: str) -> DataFrame:
    """A set from its XML document, whatever the namespaces."""
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    root = root if root.tag == "TileMatrixSet" else root.find(".//TileMatrixSet")
    rows = []
    for m in root.findall("TileMatrix"):
        get = lambda k: (m.findtext(k) or "").strip()  # noqa: B023, E731
        x, y = map(float, get("TopLeftCorner").split())
        rows.append((get("Identifier"), float(get("ScaleDenominator")), None, x, y, "TOP_LEFT", int(get("TileWidth")), int(get("TileHeight")), int(get("MatrixWidth")), int(get("MatrixHeight"))))
    return _rows(spark, (root.findtext("Identifier") or "").strip(), (root.findtext("SupportedCRS") or "").strip(), rows)


def _rows(spark: SparkSession, set_id: str, crs_uri: str, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame(rows, "id string, sd double, cell double, origin_x double, origin_y double, origin string, tile_width int, tile_height int, matrix_width long, matrix_height long")
    df = df.withColumns({"set_id": F.lit(set_id), "crs": grids.crs_code(F.lit(crs_uri))})
    df = df.withColumn("resolution", F.coalesce("cell", grids.resolution_of_scale(F.col("sd"), F.col("crs"))))
    df = df.withColumn("scale_denominator", F.coalesce("sd", grids.scale_of_resolution(F.col("cell"), F.col("crs"))))
    return renumbered(df).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def renumbered(matrices: DataFrame) -> DataFrame:
    """Levels numbered by falling scale, whatever the ids; a set's few rows are put in order in one task."""
    order = Window.partitionBy("set_id").orderBy(F.col("scale_denominator").desc(), "id")
    return matrices.withColumn("z", (F.row_number().over(order) - 1).cast("int"))


def build(spark: SparkSession, set_id: str, crs: str, extent: tuple[float, float, float, float], resolutions: Sequence[float], tile_size: tuple[int, int] = (256, 256), origin: str = "TOP_LEFT", zooms: tuple[int, int] | None = None) -> DataFrame:
    """A set from an extent and the resolutions of its levels: as many tiles as cover the extent from its corner on. All of
    set_id, crs, extent and resolutions are needed; ``zooms`` takes levels from, to, which must be among them."""
    if not set_id or not crs or extent is None or not resolutions:
        raise ValueError("a set needs an id, a reference system, an extent and resolutions")
    if extent[0] >= extent[2] or extent[1] >= extent[3]:
        raise ValueError(f"extent {extent}")
    low, high = zooms or (0, len(resolutions) - 1)
    if not 0 <= low <= high < len(resolutions):
        raise ValueError(f"levels {low} to {high} of {len(resolutions)}")
    rows = []
    for z in range(low, high + 1):
        if not resolutions[z] > 0:
            raise ValueError(f"resolution {resolutions[z]} of level {z}")
        across, down = (-(-(b - a) // (resolutions[z] * n)) for a, b, n in ((extent[0], extent[2], tile_size[0]), (extent[1], extent[3], tile_size[1])))
        rows.append((z, float(resolutions[z]), int(across), int(down)))
    df = spark.createDataFrame(rows, "z int, resolution double, matrix_width long, matrix_height long")
    top = extent[3] if origin == "TOP_LEFT" else extent[1]
    parts = {"set_id": F.lit(set_id), "id": F.col("z").cast("string"), "crs": F.lit(crs), "origin_x": F.lit(float(extent[0])), "origin_y": F.lit(float(top)), "origin": F.lit(origin), "tile_width": F.lit(tile_size[0]), "tile_height": F.lit(tile_size[1])}
    df = df.withColumns(parts).withColumn("scale_denominator", grids.scale_of_resolution(F.col("resolution"), F.col("crs")))
    return df.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def bounds(matrices: DataFrame) -> DataFrame:
    """The matrices with minx, miny, maxx, maxy in their units: of their range of tiles (left, low, right, high) if they
    have one, else of the whole matrix."""
    whole = [F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("matrix_width") - 1, F.col("matrix_height") - 1]
    names = ["left", "low", "right", "high"]
    edges = [F.col(n) for n in names] if set(names) <= set(matrices.columns) else whole
    box = grids.range_extent(*edges, F.col("origin"), F.col("origin_x"), F.col("origin_y"), F.col("resolution") * F.col("tile_width"), F.col("resolution") * F.col("tile_height"))
    return matrices.select(*matrices.columns, *[c.alias(n) for n, c in zip(("minx", "miny", "maxx", "maxy"), box)])


def contains(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    """Whether a matrix' range of tiles holds another's (z, minx, miny, maxx, maxy); an error where their zooms differ."""
    inside = (outer["minx"] <= inner["minx"]) & (outer["miny"] <= inner["miny"]) & (outer["maxx"] >= inner["maxx"]) & (outer["maxy"] >= inner["maxy"])
    wrong = F.raise_error(F.format_string("matrices of zoom %s and %s can't be compared", outer["z"], inner["z"])).cast("boolean")
    return F.when(outer["z"] == inner["z"], inside).otherwise(wrong)


def write_json(matrices: DataFrame) -> str:
    """The set (a few rows) as its JSON document."""
    rows = matrices.orderBy("z").collect()
    corner = {"TOP_LEFT": "topLeft", "BOTTOM_LEFT": "bottomLeft"}
    return json.dumps({
        "id": rows[0]["set_id"], "crs": rows[0]["crs"],
        "tileMatrices": [{"id": r["id"], "scaleDenominator": r["scale_denominator"], "cellSize": r["resolution"], "cornerOfOrigin": corner[r["origin"]], "pointOfOrigin": [r["origin_x"], r["origin_y"]], "tileWidth": r["tile_width"], "tileHeight": r["tile_height"], "matrixWidth": r["matrix_width"], "matrixHeight": r["matrix_height"]} for r in rows],
    })


def write_xml(matrices: DataFrame) -> str:
    root = ET.Element("TileMatrixSet")
    rows = matrices.orderBy("z").collect()
    ET.SubElement(root, "Identifier").text = rows[0]["set_id"]
    ET.SubElement(root, "SupportedCRS").text = rows[0]["crs"]
    for r in rows:
        m = ET.SubElement(root, "TileMatrix")
        for tag, v in (("Identifier", r["id"]), ("ScaleDenominator", r["scale_denominator"]), ("TopLeftCorner", f"{r['origin_x']!r} {r['origin_y']!r}"), ("TileWidth", r["tile_width"]), ("TileHeight", r["tile_height"]), ("MatrixWidth", r["matrix_width"]), ("MatrixHeight", r["matrix_height"])):
            ET.SubElement(m, tag).text = str(v)
    return ET.tostring(root, encoding="unicode")


def for_archives(headers: DataFrame, matrices: DataFrame, key: str) -> DataFrame:
    """key, matrices' columns and the range of each level that an archive's zooms and box (degrees) leave.

    Matrices (a set's few rows, in Web Mercator meters) are broadcast; archives without usable zooms give no level.
    """
    from tilewright.functions.mercator import to_meters

    x0, y0 = to_meters(F.col("min_lon_e7") / 1e7, F.col("min_lat_e7") / 1e7)
    x1, y1 = to_meters(F.col("max_lon_e7") / 1e7, F.col("max_lat_e7") / 1e7)
    few = headers.select(key, "min_zoom", "max_zoom", x0.alias("bx0"), y0.alias("by0"), x1.alias("bx1"), y1.alias("by1"))
    met = few.join(F.broadcast(matrices), F.col("z").between(F.col("min_zoom"), F.col("max_zoom")))
    edges = grids.box_range(F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1"), F.col("origin_x"), F.col("origin_y"), F.col("resolution") * F.col("tile_width"), F.col("matrix_width"), F.col("matrix_height"))
    out = met.select(key, *matrices.columns, *[e.alias(n) for n, e in zip(("minx", "miny", "maxx", "maxy"), edges)])
    return out.where("minx IS NOT NULL")
