"""A query for features by extent, zoom, layer and attribute, as one declarative plan.

Order of work: zoom and tiles are pruned before anything is joined, layers before attributes, attributes before
geometry. Features aren't clipped to the extent: a tile that meets it counts whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry, hilbert
from tilewright.functions.mercator import HALF_WORLD
from tilewright.functions.tiles import is_valid, span, top_left_row
from tilewright.operators import directory, matrixsets, ranges
from tilewright.operators.layers import attributes
from tilewright.sources import mvt, pmtiles
from tilewright.sources.mvt import geometry_parts, parts_wkb, parts_wkt

Extent = tuple[float, float, float, float]


@dataclass(frozen=True)
class FeatureQuery:
    extents: tuple[Extent, ...] = ()
    zoom: int | None = None
    resolution: float | None = None
    strategy: str = "SPEED"
    layers: tuple[str, ...] | None = None
    where: Column | None = None
    to_crs: bool = False
    all_zooms: bool = False
    form: str = "parts"
    keep: tuple[Callable[[pd.DataFrame], pd.Series], ...] = field(default=())
    then: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())

    def within(self, *extents: Extent) -> FeatureQuery:
        """In Web Mercator meters; none means the whole level."""
        return replace(self, extents=self.extents + extents)

    def at(self, zoom: int) -> FeatureQuery:
        return replace(self, zoom=zoom)

    def at_all(self) -> FeatureQuery:
        """Every zoom of the features."""
        return replace(self, all_zooms=True)

    def near(self, resolution: float, strategy: str = "SPEED") -> FeatureQuery:
        return replace(self, resolution=resolution, strategy=strategy)

    def of(self, *layers: str) -> FeatureQuery:
        return replace(self, layers=layers)

    def matching(self, where: Column) -> FeatureQuery:
        """A condition on columns of features and on the map ``attributes``."""
        return replace(self, where=where)

    def keeping(self, test: Callable[[pd.DataFrame], pd.Series]) -> FeatureQuery:
        """A condition in Python on batches of features (all columns but geometry), after that of ``matching``. Conditions on
        columns are much faster, as they reach the scan."""
        return replace(self, keep=(*self.keep, test))

    def written_as(self, form: str) -> FeatureQuery:
        """Geometry as parts (the default), or as wkb or wkt in a column of that name."""
        if form not in ("parts", "wkb", "wkt"):
            raise ValueError(form)
        return replace(self, form=form)

    def in_meters(self) -> FeatureQuery:
        return replace(self, to_crs=True)

    def mapped(self, step: Callable[[DataFrame], DataFrame]) -> FeatureQuery:
        """A step on the result, after coordinates are transformed."""
        return replace(self, then=(*self.then, step))


def choose_zoom(query: FeatureQuery, matrices: DataFrame, layer_zooms: DataFrame | None = None) -> int | None:
    """The explicit zoom; else by resolution; else for SPEED the lowest, for QUALITY the greatest minimal zoom of layers
    (nulls ignored). Reads a set's few rows."""
    if query.zoom is not None:
        return query.zoom
    if query.resolution is not None:
        spark = matrices.sparkSession
        wish = spark.createDataFrame([(0, float(query.resolution))], "k int, resolution double")
        row = matrixsets.zoom_for_resolution(wish, matrices, "k", query.strategy).first()
        return row["z"] if row else None
    if query.strategy == "QUALITY" and layer_zooms is not None:
        best = layer_zooms.agg(F.max("minzoom")).first()[0]
        if best is not None:
            return best
    return matrices.agg(F.min("z")).first()[0]


def tile_ranges(query: FeatureQuery, matrices: DataFrame, zoom: int | None) -> DataFrame:
    level = matrices if query.all_zooms else matrices.where(F.col("z") == zoom)
    if not query.extents:
        return matrixsets.view(level).select("z", *ranges.BOUNDS)
    out = None
    for box in query.extents:
        part = matrixsets.view(level, box=box).select("z", *ranges.BOUNDS)
        out = part if out is None else out.unionByName(part)
    return out


def plan(query: FeatureQuery, features: DataFrame, dictionaries: DataFrame | None, matrices: DataFrame, layer_zooms: DataFrame | None = None) -> DataFrame:
    """The features with top-left y, their attributes, and kind, parts and points (tile pixels, or meters if asked for).

    Parts are those of any kind of geometry, as geometry.decode gives them; they are decoded in an Arrow pass, which is
    left out where nothing asks for them. Points are null but for a stream of one MoveTo, and take no Python.

    A few ranges meet the features as a filter, so no tile is enumerated and the scan prunes by zoom and layer. A tile
    inside several extents is taken once. Without dictionaries, features bring their own ``attributes``, as those do that
    any loader has decoded from tiles.
    """
    zoom = None if query.all_zooms else choose_zoom(query, matrices, layer_zooms)
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    level = F.lit(True) if query.all_zooms else z == zoom
    out = features.where(level & is_valid(z, x, y)) if query.all_zooms or zoom is not None else features.limit(0)
    if query.layers is not None:
        out = out.where(F.col("layer").isin(*query.layers))
    if "origin" in out.columns:
        out = out.withColumn("y", top_left_row(z, y, F.col("origin"))).drop("origin")
    if query.extents:
        few = F.broadcast(tile_ranges(query, matrices, zoom).select(F.col("z").alias("range_z"), *ranges.BOUNDS))  # as many rows as extents and levels were given
        out = out.join(few, (F.col("z") == F.col("range_z")) & out["x"].between(few["minx"], few["maxx"]) & out["y"].between(few["miny"], few["maxy"]), "left_semi")
    if dictionaries is not None:
        out = attributes(out, dictionaries)
    if query.where is not None:
        out = out.where(query.where)
    for test in query.keep:
        out = out.mapInPandas(lambda batches, test=test: (b[test(b).to_numpy(bool)] for b in batches), out.schema)
    kind = F.col("geom_type") if "geom_type" in out.columns else F.lit(None).cast("string")
    out = out.withColumn("geometry", geometry_parts(F.col("commands"), kind))
    points, parts = geometry.points_of(F.col("commands")), F.col("geometry.parts")
    if query.to_crs:
        size = F.lit(2 * HALF_WORLD) / span(F.col("z"))
        left, top = F.col("x") * size - HALF_WORLD, F.lit(HALF_WORLD) - F.col("y") * size
        meters = lambda p: F.struct((left + p["x"] * size / F.col("extent")).alias("x"), (top - p["y"] * size / F.col("extent")).alias("y"))
        points, parts = F.transform(points, meters), F.transform(parts, lambda part: F.transform(part, meters))
    out = out.select(*[c for c in out.columns if c != "geometry"], F.col("geometry.kind").alias("kind"), parts.alias("parts"), points.alias("points"))
    if query.form != "parts":
        out = out.withColumn(query.form, (parts_wkb if query.form == "wkb" else parts_wkt)("parts", "kind")).drop("parts", "points")
    for step in query.then:
        out = step(out)
    return out


def archive_features(query: FeatureQuery, spark: SparkSession, path: str, matrices: DataFrame, layer_zooms: DataFrame | None = None) -> DataFrame:
    """The same query on an archive of vector tiles: only the leaves of its zoom are read, of these only the tiles that the
    extents meet, and of a tile only the layers that were asked for. Raises for archives of raster tiles.

    Ids come from the directory, so no tile is enumerated that isn't there, however large the extent.
    """
    zoom = choose_zoom(query, matrices, layer_zooms)
    low, high = hilbert.LEVEL_STARTS[zoom], hilbert.LEVEL_STARTS[zoom + 1] - 1
    entries = pmtiles.read(spark, path, "entries", from_id=low, to_id=high, expect="vector")
    ids = directory.ids_at_zoom(entries, zoom).select("tile_id", hilbert.tiles_of_ids("tile_id").alias("t")).select("tile_id", "t.z", "t.x", "t.y")
    if query.extents:
        few = F.broadcast(tile_ranges(query, matrices, zoom).select(*ranges.BOUNDS))  # as many rows as extents
        ids = ids.join(few, ids["x"].between(few["minx"], few["maxx"]) & ids["y"].between(few["miny"], few["maxy"]), "left_semi")
    features = mvt.decode(pmtiles.fetch(ids, path), layers=query.layers)
    return plan(replace(query, extents=(), zoom=zoom, all_zooms=False), features, None, matrices)
