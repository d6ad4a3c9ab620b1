"""Distinct features per tile, and the tiles that hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tiles
from tilewright.operators.tree import distinct_per_key

TILE = ["z", "x", "y"]
FEATURE = ["tile_layer_id", "feature_id"]


def valid_features(features: DataFrame) -> DataFrame:
    """Rows with a valid tile and a whole feature key; y counted from the top."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    kept = features.where(tiles.is_valid(z, x, y) & F.col("tile_layer_id").isNotNull() & F.col("feature_id").isNotNull())
    return kept.select("z", "x", tiles.top_left_row(z, y, F.col("origin")).alias("y"), *FEATURE)


def features_per_tile(features: DataFrame, fan_in: int = 16) -> DataFrame:
    """z, x, y, n_features: distinct features of every valid tile. Rows with a null key or invalid tile don't count."""
    # the count reads no column: it bounds the number of chunks
    return distinct_per_key(valid_features(features), TILE, FEATURE, "n_features", fan_in, features.count())


def heavy_tiles(features: DataFrame, share: float = 0.02, fan_in: int = 16) -> DataFrame:
    """z, x, y of tiles with more than ``share`` of all distinct features that have a valid tile. Empty in, empty out."""
    total = valid_features(features).select(*FEATURE).distinct().agg(F.count(F.lit(1)).alias("__total"))
    counts = features_per_tile(features, fan_in)
    # One row; the parts per million keep the comparison in integers.
    parts = round(share * 1_000_000)
    return counts.join(F.broadcast(total), F.col("n_features") * 1_000_000 > F.col("__total") * parts).select(*TILE)
