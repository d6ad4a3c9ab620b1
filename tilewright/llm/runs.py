"""Runs of identical or touching consecutive events, each as one event with its count and extent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.blocks import same_keys
from tilewright.session import cut


def covering_runs(events: DataFrame, group: Sequence[str], start: str, end: str, width: int = 65_536) -> DataFrame:
    """group, first, last, n_events: runs of events of a group in which each starts no later than one after all before it end.

    ``start`` and ``end`` are whole numbers, both covered. Copies (same group, start and end) count once. Each event is
    compared with its predecessors by a lag of the running end; a gap flags a new run, and the running count of flags
    names the run. All that in blocks of ``width`` positions, so that no group, however hot, is one task: a block first
    gets the furthest end of the blocks before it, and a run that goes on over a block's edge is joined by a second
    window over at most two rows per block. Events with a null start or end or with end < start are left out.
    """
    once = events.where(F.col(start) <= F.col(end)).select(*group, F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    once = once.withColumn("block", F.floor(F.col("s") / width))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = once.groupBy(*group, "block").agg(F.max("e").alias("top")).select(*group, "block", F.max("top").over(before).alias("reach"))
    keys = [*group, "block"]
    known = once.alias("a").join(reach.alias("b"), same_keys(keys, "a", "b")).select(*[F.col(f"a.{c}") for c in (*keys, "s", "e")], "b.reach")
    inner = Window.partitionBy(*keys).orderBy("s", "e")
    lagged = F.max("e").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    flagged = known.withColumn("new", F.coalesce(F.col("s") > F.greatest(lagged, F.col("reach")) + 1, F.lit(True)).cast("int"))
    numbered = flagged.withColumn("n", F.sum("new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*keys, "n").agg(F.min("s").alias("first"), F.max("e").alias("last"), F.count(F.lit(1)).alias("n_events"))
    # A row per run and block, read three times below; kept in the shared folder instead of being made anew each time.
    parts = cut(parts)
    # Number 0 is what goes on from an earlier block: it belongs to the last run that began before.
    began = parts.where(F.col("n") > 0).groupBy(*keys).agg(F.max(F.struct("n", "first")).alias("open"))
    heads = parts.where(F.col("n") == 0).select(*keys, F.lit(None).cast("long").alias("open"), F.lit(True).alias("head"))
    edges = heads.unionByName(began.select(*keys, F.col("open.first").alias("open"), F.lit(False).alias("head")))
    order = Window.partitionBy(*group).orderBy("block", F.col("head").desc()).rowsBetween(Window.unboundedPreceding, -1)
    owners = edges.withColumn("owner", F.last("open", ignorenulls=True).over(order)).where("head").select(*keys, "owner")
    tied = parts.where(F.col("n") == 0).alias("a").join(owners.alias("b"), same_keys(keys, "a", "b"))
    cols = [F.col(f"a.{c}") for c in (*group, "last", "n_events")]
    pieces = tied.select(*cols, F.col("b.owner").alias("first")).unionByName(parts.where(F.col("n") > 0).select(*group, "first", "last", "n_events"))
    return pieces.groupBy(*group, "first").agg(F.max("last").alias("last"), F.sum("n_events").alias("n_events")).select(*group, "first", "last", "n_events")


def tile_runs(entries: DataFrame, least: int = 2) -> DataFrame:
    """archive_id, tile_offset, first_tile_id, last_tile_id, n_entries, n_tiles: runs of ``least`` or more distinct entries.

    Leaf pointers (run length 0) and entries with a null or negative part don't count.
    """
    own = entries.where((F.col("run_length") > 0) & F.col("tile_id").isNotNull() & F.col("archive_id").isNotNull() & F.col("tile_offset").isNotNull())
    spans = own.select("archive_id", "tile_offset", "tile_id", (F.col("tile_id") + F.col("run_length") - 1).alias("end_id"))
    runs = covering_runs(spans, ["archive_id", "tile_offset"], "tile_id", "end_id").where(F.col("n_events") >= least)
    return runs.select(
        "archive_id", "tile_offset", F.col("first").alias("first_tile_id"), F.col("last").alias("last_tile_id"),
        F.col("n_events").alias("n_entries"), (F.col("last") - F.col("first") + 1).alias("n_tiles"),
    )


#: Width of a block of events: a day, or as many numbers.
DAY_US, NUMBERS = 86_400_000_000, 65_536


def _block(events: DataFrame, order: str) -> Column:
    """Of a row the block of its first order column; nulls come first and are a block of their own."""
    kind = dict(events.dtypes)[order]
    c = F.col(order)
    at = F.floor(F.unix_micros(c.cast("timestamp")) / DAY_US) if kind.startswith(("timestamp", "date")) else F.floor(c / NUMBERS)
    return F.coalesce(at, F.lit(-(1 << 62)))


def collapse(events: DataFrame, group: Sequence[str], order: Sequence[str], same: Sequence[str], at: str) -> DataFrame:
    """group, same, started_at, ended_at, n_events, seconds: each run of events of a group that agree in ``same``.

    An event is compared with its predecessor in the group's order by a lag window, and the running count of changes names
    the run; all that inside blocks of the first order column (days of a time, NUMBERS of a number), so that no group,
    however hot, is one task. A block begins with the state that the block before it ends with, and a run that goes on
    over blocks is joined through one row per block. Nulls in ``same`` are equal to each other, those in the first order
    column come first. ``order`` must tell the events of a group apart; ties beyond it are settled by ``same``. Events
    without ``at`` keep their place in the order, and a run of only such events has null times.
    """
    keys = [*group, "__block"]
    state: Column = F.struct(*same)
    rows = events.withColumn("__block", _block(events, order[0]))
    place = F.struct(*order, *same)
    blocks = Window.partitionBy(*group).orderBy("__block")
    ends = rows.groupBy(*keys).agg(F.max_by(F.struct(state.alias("s")), place).alias("__end")).select(*keys, F.lag("__end").over(blocks).alias("__before"))
    known = rows.alias("a").join(ends.alias("b"), same_keys(keys, "a", "b")).select(*[F.col(f"a.{c}") for c in dict.fromkeys((*keys, *order, *same, at))], "b.__before")
    inner = Window.partitionBy(*keys).orderBy(*order, *same)
    previous = F.coalesce(F.lag(F.struct(state.alias("s"))).over(inner), F.col("__before"))  # null for the group's first event only
    flagged = known.withColumn("__new", F.coalesce((~previous["s"].eqNullSafe(state) | previous.isNull()).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("__run", F.sum("__new").over(inner))
    parts = numbered.groupBy(*keys, "__run", *same).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("n_events"))
    # Run 0 of a block goes on from the last run that began before it.
    began = numbered.groupBy(*keys).agg(F.max("__run").alias("__most")).withColumn("__open", F.when(F.col("__most") > 0, F.struct("__block", F.col("__most").alias("__run"))))
    owners = began.select(*keys, F.last("__open", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("__owner"))
    owned = parts.alias("a").join(owners.alias("b"), same_keys(keys, "a", "b"))
    own = F.when(F.col("a.__run") == 0, F.col("b.__owner")).otherwise(F.struct(F.col("a.__block").alias("__block"), F.col("a.__run").alias("__run")))
    pieces = owned.select(*[F.col(f"a.{c}") for c in (*group, *same, "started_at", "ended_at", "n_events")], own.alias("__owner"))
    out = pieces.groupBy(*group, "__owner", *same).agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("n_events").alias("n_events"))
    seconds = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000
    return out.select(*group, *same, "started_at", "ended_at", "n_events", seconds.alias("seconds"))
