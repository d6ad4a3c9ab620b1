"""Per-key aggregates as a tree: local chunks, then rounds of limited fan-in.

With a key that holds a third of all rows, a plain aggregate sends one partial state per map task to a single reducer.
Here no task ever receives more than ``fan_in`` states of a key: chunks of ``chunk_rows`` rows are combined where they lie,
a round merges the states of ``fan_in`` neighbouring nodes, and the last round is only reached when ``fan_in`` nodes at
most are left. The number of rounds follows from the number of chunks, not from a setting, and is two at least.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "__tree_node"
#: Rows of a chunk; a power of two.
CHUNK_ROWS = 1 << 16
#: Bits that monotonically_increasing_id keeps for the row of a partition.
_ROW_BITS = 33


@dataclass(frozen=True)
class State:
    """A mergeable state: made from rows, merged from states, finished into the result."""

    leaf: Column
    merge: Callable[[str], Column]
    finish: Callable[[str], Column] = F.col


def counted(of: Column | None = None) -> State:
    return State(F.count(F.lit(1) if of is None else of), lambda name: F.sum(name))


def summed(of: Column) -> State:
    return State(F.sum(of), lambda name: F.sum(name))


def lowest(of: Column) -> State:
    return State(F.min(of), lambda name: F.min(name))


def highest(of: Column) -> State:
    return State(F.max(of), lambda name: F.max(name))


def sketched_distinct(of: Column, log2_size: int = 12) -> State:
    """A HyperLogLog estimate; for exact counts see distinct_per_key."""
    return State(F.hll_sketch_agg(of, log2_size), lambda name: F.hll_union_agg(name), lambda name: F.hll_sketch_estimate(name))


def partitions_of(df: DataFrame) -> int:
    """Partitions that the plan can have at most, without running any of it: adaptive execution only merges those of a shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.inputPlan()
        known = plan.outputPartitioning().numPartitions()
        return known if known > 0 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = plan.outputPartitioning().numPartitions()
    return max(1, known or df._jdf.queryExecution().toRdd().getNumPartitions())


def rounds(leaves: int, fan_in: int) -> int:
    """Rounds of merging until one node is left, the last one by key alone; two at least, so that a tree is a tree at any size."""
    n = 1
    while fan_in**n < leaves:
        n += 1
    return max(2, n)


def levels(df: DataFrame, keys: Sequence[str], states: Mapping[str, State], fan_in: int = 16, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> list[DataFrame]:
    """The frames of all rounds but the last: keys, NODE and the states. A node is its number at its level.

    A chunk is known by its partition and by the running number of its rows there. Neighbours are the chunks of the same
    place in neighbouring partitions, so each task brings one state per key to a node of the first round.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    if chunk_rows < 1 or chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    width = partitions_of(df)
    rows = df.count() if rows is None else rows
    number = F.monotonically_increasing_id()
    chunk = F.shiftright(number.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), chunk_rows.bit_length() - 1)
    node = F.shiftright(number, _ROW_BITS) + chunk * width
    # the number is fixed once per row, before anything is grouped by it
    level, merge, out = df.withColumn(NODE, node), False, []
    for _ in range(rounds(width + -(-rows // chunk_rows), fan_in) - 1):
        made = [(s.merge(n) if merge else s.leaf).alias(n) for n, s in states.items()]
        level = level.withColumn(NODE, F.floor(F.col(NODE) / fan_in)).groupBy(*keys, NODE).agg(*made)
        merge = True
        out.append(level)
    return out


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Mapping[str, State], fan_in: int = 16, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key with the finished states, in rounds of at most ``fan_in`` states per key and task.

    ``rows`` is an upper bound of the input's rows if the caller has one (only the number of rounds follows from it);
    else they are counted. If a task may see its rows in another order when it is run again, as after a shuffle, sort
    them within partitions first: chunks would differ else. Keys may be null (null is a key of its own, as in GROUP BY);
    an empty table gives no rows; columns other than the keys and those read by the states are ignored.
    """
    last = levels(df, keys, states, fan_in, rows, chunk_rows)[-1]
    merged = last.groupBy(*keys).agg(*[s.merge(n).alias(n) for n, s in states.items()])
    return merged.select(*keys, *(s.finish(n).alias(n) for n, s in states.items()))


def distinct_rows(df: DataFrame, keys: Sequence[str], of: Sequence[str]) -> DataFrame:
    """Copies vanish by a shuffle on key and value together, which no single key can skew and which the map side combines.
    The order within partitions makes chunks come out alike when a task is run again, and puts few keys into each."""
    whole = F.lit(True)
    for c in of:
        whole = whole & F.col(c).isNotNull()
    return df.select(*keys, *of).distinct().sortWithinPartitions(*keys, *of).withColumn("__whole", whole.cast("long"))


def distinct_per_key(df: DataFrame, keys: Sequence[str], of: Sequence[str], name: str = "n_distinct", fan_in: int = 16, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact distinct counts per key without a reducer that sees all of a hot key.

    What is left once copies are gone is a sum, done as a tree. Rows with a null in ``of`` don't count, but their key is kept.
    """
    rows = df.count() if rows is None else rows
    return tree_aggregate(distinct_rows(df, keys, of), keys, {name: summed(F.col("__whole"))}, fan_in, rows, chunk_rows)
