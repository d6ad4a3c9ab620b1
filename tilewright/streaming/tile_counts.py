"""An extension: counts of events per tile and time window from a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.mercator import tile_of_degrees


def tile_counts(events: DataFrame, at: str, lon: str, lat: str, zoom: int, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window_start, x, y, n_events; works on streams (append or update mode) and tables alike. The state is one row per
    tile and open window."""
    x, y = tile_of_degrees(F.col(lon), F.col(lat), F.lit(zoom))
    rows = events.withWatermark(at, late).select(at, x.alias("x"), y.alias("y"))
    counted = rows.groupBy(F.window(at, window).alias("w"), "x", "y").agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(F.col("w.start").alias("window_start"), "x", "y", "n_events")
