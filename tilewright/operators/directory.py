"""Directories of tile archives: entries (tile_id, tile_offset, length_bytes, run_length), run_length 0 for a leaf pointer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import hilbert
from tilewright.operators.blocks import asof

#: Ids per block of an as-of lookup.
BLOCK_IDS = 1 << 16


#: Ids that one row is expanded to at once.
EXPANDED = 1 << 16


def _expanded(spans: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, tile_id: all ids from ``first`` to ``last``. A long run is cut into pieces before any is expanded, so that no row
    holds all ids of a run and an ocean's run is the work of many rows."""
    pieces = spans.select(*keep, "last", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(EXPANDED).cast("long"))).alias("start"))
    return pieces.select(*keep, F.explode(F.sequence("start", F.least(F.col("start") + EXPANDED - 1, F.col("last")))).alias("tile_id"))


def expand_runs(entries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, tile_id: every id that tile entries address (leaf pointers address none)."""
    own = entries.where(F.col("run_length") > 0)
    return _expanded(own.select(*keep, F.col("tile_id").alias("first"), (F.col("tile_id") + F.col("run_length") - 1).alias("last")), keep)


def ids_at_zoom(entries: DataFrame, zoom: int, keep: Sequence[str] = ()) -> DataFrame:
    """keep, tile_id of the addressed tiles of a zoom. Entries are cut to the level's ids before they are expanded, so a run
    that crosses levels keeps its part and other levels cost nothing."""
    if not 0 <= zoom <= hilbert.MAX_LEVEL:
        raise ValueError(f"no zoom {zoom}")
    low, high = hilbert.LEVEL_STARTS[zoom], hilbert.LEVEL_STARTS[zoom + 1] - 1
    start, end = F.greatest("tile_id", F.lit(low)), F.least(F.col("tile_id") + F.col("run_length") - 1, F.lit(high))
    cut = entries.where((F.col("run_length") > 0) & (F.col("tile_id") <= high) & (F.col("tile_id") + F.col("run_length") > low))
    return _expanded(cut.select(*keep, start.alias("first"), end.alias("last")), keep)


def tiles_at_zoom(entries: DataFrame, zoom: int, keep: Sequence[str] = ()) -> DataFrame:
    """keep, z, x, y of the addressed tiles of a zoom."""
    ids = ids_at_zoom(entries, zoom, keep)
    return ids.select(*keep, hilbert.tiles_of_ids("tile_id").alias("t")).select(*keep, "t.z", "t.x", "t.y")


def lookup(keys: DataFrame, entries: DataFrame, by: Sequence[str] = ("archive_id",), key: str = "tile_id") -> DataFrame:
    """Rows of ``keys`` with the entry that addresses them: the greatest tile_id <= key whose run reaches it; null else.

    An as-of in blocks of ids: a hot archive is spread over as many tasks as it has blocks.
    """
    own = entries.where(F.col("run_length") > 0).select(*by, F.col("tile_id").alias("entry_id"), "tile_offset", "length_bytes", "run_length")
    found = asof(keys, own, list(by), key, "entry_id", BLOCK_IDS)
    e = F.when(F.col(key) < F.col("entry.__at") + F.col("entry.run_length"), F.col("entry"))
    cols = {"entry_id": e["__at"], "tile_offset": e["tile_offset"], "length_bytes": e["length_bytes"], "run_length": e["run_length"]}
    return found.select(*keys.columns, *[c.alias(n) for n, c in cols.items()])


def decode_ids(rows: DataFrame, by: Sequence[str], position: str = "i", delta: str = "delta") -> DataFrame:
    """Adds tile_id, the running sum of deltas of a directory. A directory is small: one window per directory."""
    return rows.withColumn("tile_id", F.sum(delta).over(Window.partitionBy(*by).orderBy(position)))


def decode_offsets(rows: DataFrame, by: Sequence[str], position: str = "i", stored: str = "stored", length: str = "length_bytes") -> DataFrame:
    """Adds tile_offset: stored value less one, or for 0 the end of the entry before."""
    order = Window.partitionBy(*by).orderBy(position)
    explicit = (F.col(stored) > 0) | (F.row_number().over(order) == 1)
    island = rows.withColumn("__explicit", explicit.cast("int")).withColumn("__island", F.sum("__explicit").over(order))
    inner = Window.partitionBy(*by, "__island").orderBy(position)
    base = F.first(F.greatest(F.col(stored) - 1, F.lit(0))).over(inner)
    ahead = F.coalesce(F.sum(length).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return island.withColumn("tile_offset", base + ahead).drop("__explicit", "__island")


def encode(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, i, delta, run_length, length_bytes, stored: the columns of a directory as they are written, in order of id."""
    order = Window.partitionBy(*by).orderBy("tile_id")
    end = F.lag(F.col("tile_offset") + F.col("length_bytes")).over(order)
    stored = F.when(F.col("tile_offset") == end, F.lit(0)).otherwise(F.col("tile_offset") + 1)
    delta = F.col("tile_id") - F.coalesce(F.lag("tile_id").over(order), F.lit(0))
    return entries.select(*by, (F.row_number().over(order) - 1).alias("i"), delta.alias("delta"), "run_length", "length_bytes", stored.cast("long").alias("stored"))


def totals(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entries, leaf pointers, addressed tiles and distinct contents per archive."""
    leaf = F.col("run_length") == 0
    contents = F.struct("tile_offset", "length_bytes")
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if(leaf).alias("n_leaves"), F.sum("run_length").alias("n_addressed"),
        F.count_distinct(F.when(~leaf, contents)).alias("n_contents"),
    )
