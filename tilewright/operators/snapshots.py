"""What changed between consecutive full listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_etag(etag: Column) -> Column:
    """Without quotes, a leading W/ and case; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(etag), "^[Ww]/", ""), '"', "")
    return F.when(F.trim(bare) != "", F.lower(F.trim(bare)))


def consecutive(snapshots: DataFrame, number: str = "snapshot_no") -> DataFrame:
    """Each number with the one before and after it; a handful of rows, one per snapshot ever taken."""
    order = Window.orderBy(number)
    once = snapshots.where(F.col(number).isNotNull()).select(number).distinct()
    return once.select(number, F.lag(number).over(order).alias("__before"), F.lead(number).over(order).alias("__after"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """snapshot_no, object_key, change_kind (added, removed, changed), against the snapshot before by number.

    Each file row goes to two comparisons, tagged by side: as the new side of its own snapshot, as the old side of the
    next. One aggregation by (comparison, key) keeps the state that holds on each side, with hashes instead of the
    values, and classifies; map tasks combine copies before the shuffle, and no key can hold more than the map tasks'
    states. Ties in last_modified and listed_at are settled by the hashes, so a result doesn't depend on row order.
    Rows without key or number are ignored; null times sort first; null sizes are equal to each other.
    """
    second = F.date_trunc("second", F.col("last_modified"))
    rows = snapshots.where((F.col("kind") == "File") & F.col("object_key").isNotNull()).select(
        "snapshot_no", "object_key",
        F.struct(
            F.col("last_modified").alias("at"), F.col("listed_at").alias("listed"),
            F.xxhash64(plain_etag(F.col("etag"))).alias("etag"), plain_etag(F.col("etag")).isNotNull().alias("tagged"),
            F.xxhash64(F.coalesce(F.col("size_bytes").cast("string"), F.lit("-")), F.coalesce(second.cast("string"), F.lit("-"))).alias("stat"),
        ).alias("state"),
    )
    sides = F.array(
        F.struct(F.when(F.col("__before").isNotNull(), F.col("snapshot_no")).alias("snapshot_no"), F.lit(True).alias("new")),
        F.struct(F.col("__after").alias("snapshot_no"), F.lit(False).alias("new")),
    )
    tagged = rows.join(consecutive(snapshots), "snapshot_no").select("object_key", "state", F.inline(sides)).where(F.col("snapshot_no").isNotNull())
    both = tagged.groupBy("snapshot_no", "object_key").agg(
        F.max(F.when(F.col("new"), F.col("state"))).alias("n"), F.max(F.when(~F.col("new"), F.col("state"))).alias("o")
    )
    by_etag = F.col("n.tagged") & F.col("o.tagged")
    differs = F.when(by_etag, F.col("n.etag") != F.col("o.etag")).otherwise(F.col("n.stat") != F.col("o.stat"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(differs, "changed")
    return both.select("snapshot_no", "object_key", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
