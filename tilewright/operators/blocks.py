"""Neighbours inside groups that may be far too large for one task: windows over blocks, with what comes before carried in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(keys: Sequence[str], a: str, b: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def previous_number(df: DataFrame, group: Sequence[str], number: str, width: int = 4096) -> DataFrame:
    """Distinct group and number with ``previous``, the next lower number of the group (null for the first).

    A window holds at most ``width`` numbers; the window over blocks holds one row per block. Null numbers are left out.
    """
    once = df.where(F.col(number).isNotNull()).select(*group, number).distinct()
    once = once.withColumn("__block", F.floor(F.col(number) / width))
    edges = once.groupBy(*group, "__block").agg(F.max(number).alias("__last"))
    edges = edges.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*group).orderBy("__block"))).drop("__last")
    inner = once.withColumn("__own", F.lag(number).over(Window.partitionBy(*group, "__block").orderBy(number)))
    joined = inner.alias("a").join(edges.alias("b"), same_keys([*group, "__block"], "a", "b"), "left")
    return joined.select(*[F.col(f"a.{c}") for c in (*group, number)], F.coalesce("a.__own", "b.__carry").alias("previous"))


def numbered(df: DataFrame, by: Sequence[str], lead: str, then: Sequence[str], name: str, width: int = 4096) -> DataFrame:
    """The rows with ``name``: their running number from 1 in their group, by ``lead`` (whole numbers, nulls first) and ``then``.

    A window holds the rows of ``width`` values of ``lead``; what the blocks before hold is added, from one row per block.
    """
    block = F.coalesce(F.floor(F.col(lead) / width), F.lit(-(1 << 62)))
    rows = df.withColumn("__block", block)
    order = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    inner = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*by, "__block").orderBy(lead, *then)))
    joined = inner.alias("a").join(before.alias("b"), same_keys([*by, "__block"], "a", "b"))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns if c != name], (F.col("a.__own") + F.col("b.__before")).alias(name))


def beside(df: DataFrame, by: Sequence[str], lead: str, then: Sequence[str], before: Mapping[str, Column], after: Mapping[str, Column], width: int = 4096) -> DataFrame:
    """The rows with columns of the row before and the row after them in their group, by ``lead`` (whole numbers) and ``then``;
    null at the ends. Blocks as in ``numbered``; the rows at their edges are handed on."""
    rows = df.withColumn("__block", F.floor(F.col(lead) / width))
    at = F.struct(lead, *then)
    low, high = F.struct(*[c.alias(n) for n, c in after.items()]), F.struct(*[c.alias(n) for n, c in before.items()])
    order = Window.partitionBy(*by).orderBy("__block")
    edges = rows.groupBy(*by, "__block").agg(F.min_by(low, at).alias("__first"), F.max_by(high, at).alias("__last"))
    edges = edges.select(*by, "__block", F.lag("__last").over(order).alias("__before"), F.lead("__first").over(order).alias("__after"))
    inner = Window.partitionBy(*by, "__block").orderBy(lead, *then)
    own = rows.withColumns({"__low": F.lag(high).over(inner), "__high": F.lead(low).over(inner)})
    joined = own.alias("a").join(edges.alias("b"), same_keys([*by, "__block"], "a", "b"))
    made = [F.coalesce(F.col(f"a.__low.{n}"), F.when(F.col("a.__low").isNull(), F.col(f"b.__before.{n}"))).alias(n) for n in before]
    made += [F.coalesce(F.col(f"a.__high.{n}"), F.when(F.col("a.__high").isNull(), F.col(f"b.__after.{n}"))).alias(n) for n in after]
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], *made)


def asof(keys: DataFrame, entries: DataFrame, by: Sequence[str], at: str, entry_at: str, width: int) -> DataFrame:
    """Each row of ``keys`` with ``entry``: the struct of the row of ``entries`` with the greatest entry_at <= at, per ``by``.

    Rows of both sides meet in blocks of ``width`` values; each block starts with the last entry of the blocks before
    it, which a window over one row per block finds. Without an entry the struct is null. Entries that share their
    position are settled by the greatest struct, so the result doesn't depend on row order. Null positions on the left
    keep their row, with no entry; null groups match each other.
    """
    entry = F.struct(F.col(entry_at).alias("__at"), *[F.col(c) for c in entries.columns if c not in (*by, entry_at)])
    right = entries.where(F.col(entry_at).isNotNull()).groupBy(*by, F.col(entry_at).alias("__at")).agg(F.max(entry).alias("entry"))
    right = right.withColumn("__block", F.floor(F.col("__at") / width))
    left = keys.withColumn("__at", F.col(at)).withColumn("__block", F.floor(F.col(at) / width))
    blocks = left.groupBy(*by, "__block").agg(F.lit(None).cast(right.schema["entry"].dataType).alias("__last"))
    blocks = blocks.unionByName(right.groupBy(*by, "__block").agg(F.max("entry").alias("__last")))
    blocks = blocks.groupBy(*by, "__block").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*by, "__block", F.last("__last", ignorenulls=True).over(before).alias("entry"))
    row = F.struct(*[F.col(c) for c in keys.columns])
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    cols = lambda kind, r, e: [*by, "__block", "__at", F.lit(kind).alias("__kind"), r.alias("__row"), e.alias("entry")]
    low = F.lit(None).cast("long").alias("__at")
    mixed = (
        left.withColumn("__at", F.col("__at").cast("long")).select(*cols(2, row, F.lit(None).cast(right.schema["entry"].dataType)))
        .unionByName(right.withColumn("__at", F.col("__at").cast("long")).select(*cols(1, none, F.col("entry"))))
        .unionByName(carried.withColumn("__at", low).select(*cols(0, none, F.col("entry"))))
    )
    upto = Window.partitionBy(*by, "__block").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = mixed.withColumn("entry", F.last("entry", ignorenulls=True).over(upto)).where(F.col("__kind") == 2)
    known = F.when(F.col("__at").isNotNull(), F.col("entry"))
    return found.select("__row.*", known.alias("entry"))
