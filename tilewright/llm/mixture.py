"""A mixture of sources in target shares of all tokens, with small sources repeated a capped number of times.

Documents are counted by source and exact token length. Each source's budget is fitted as a bounded subset sum: whole
rounds of all its documents, then the same part of every length for all but the last RESERVE tokens, and these by dynamic
programming over lengths with the counts still free. A budget up to RESERVE is thus fitted as well as can be. Only counts by length reach the driver; documents of a length are then picked in a
seeded order where they lie.
"""

from __future__ import annotations

import random
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.tokens import RANKS, TOKENIZERS, with_token_counts
from tilewright.session import cut

#: Tokens of a budget left to the dynamic programme at least.
RESERVE = 1 << 17
#: Documents of one source and length ranked in one task; longer lists are cut into as many buckets as needed.
RANKED_TOGETHER = 10_000


def subset_sum(free: Mapping[int, int], target: int, seed: int) -> dict[int, int]:
    """Counts by length, at most ``free`` each, whose sum is the greatest reachable that is <= target.

    0/1 items by binary splitting of each count; a sum remembers the item that first reached it, so the way back never
    uses an item twice. Ends as soon as the target is reached.
    """
    items = []
    for length, count in free.items():
        count, k = min(count, target // length if length else 0), 1
        while count > 0:
            items.append((length, min(k, count)))
            count, k = count - k, k * 2
    random.Random(seed).shuffle(items)
    reached, by = np.zeros(target + 1, bool), np.full(target + 1, -1, np.int64)
    reached[0] = True
    for n, (length, k) in enumerate(items):
        step = length * k
        if step > target:
            continue
        new = np.zeros_like(reached)
        new[step:] = reached[:-step]
        new &= ~reached
        by[new] = n
        reached |= new
        if reached[target]:
            break
    at, out = int(np.flatnonzero(reached)[-1]), {}
    while at:
        length, k = items[by[at]]
        out[length] = out.get(length, 0) + k
        at -= length * k
    return out


def fit(counts: Mapping[int, int], budget: int, seed: int) -> tuple[int, dict[int, int]]:
    """Rounds of all documents, and for each length how many documents are taken once more, for ``budget`` tokens.

    No budget is left that a free document would still fit into. For what the rounds leave, the sum is the best that can
    be reached if it is up to RESERVE; beyond, the best for the documents that the equal part has left free.
    """
    supply = sum(l * c for l, c in counts.items())
    rounds, rest = divmod(budget, supply) if supply else (0, 0)
    part = Fraction(max(0, rest - RESERVE), supply) if supply else Fraction(0)
    taken = {l: int(c * part) for l, c in counts.items()}
    rest -= sum(l * n for l, n in taken.items())
    lengths = sorted(counts)
    random.Random(seed).shuffle(lengths)
    for l in lengths:  # what rounding left is less than one document of each length
        if taken[l] < counts[l] and rest - l >= RESERVE:
            taken[l] += 1
            rest -= l
    for l in sorted(counts, reverse=True):
        n = min(counts[l] - taken[l], max(0, rest - RESERVE) // l if l else 0)
        taken[l] += n
        rest -= l * n
    free = {l: counts[l] - taken[l] for l in counts if counts[l] > taken[l] and 0 < l <= rest}
    if rest > 2 * RESERVE:  # each free document is longer than rest - RESERVE, that is half of it: one fits at most
        best = {max(free): 1} if free else {}
    else:
        best = subset_sum(free, rest, seed)
    for l, n in best.items():
        taken[l] += n
    return rounds, taken


@dataclass(frozen=True)
class Target:
    source: str
    share: Fraction
    max_repeats: int


def source_key(c: str):
    return F.lower(F.trim(F.col(c)))


def read_targets(targets: DataFrame) -> list[Target]:
    """The stated targets (a table of a few rows, one per source). Rows alike but for case and spaces are added up, the lower cap holds."""
    rows = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    found = rows.groupBy(source_key("source").alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()
    return [Target(r["source"], Fraction(r["share"]).limit_denominator(10**9), int(r["cap"])) for r in sorted(found, key=lambda r: r["source"])]


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = f"{TOKENIZERS}/{RANKS}") -> tuple[DataFrame, DataFrame]:
    """(documents with copies, shares reached).

    The first has doc_id, source, n_tokens, copies for each document that is used, the second source, target_share,
    max_repeats, n_docs, supply_tokens, longest_tokens, mixed_tokens, actual_share, max_copies for each target.

    Sources are compared without case and outer spaces; documents of a null source, of a source without target, with a
    null or empty text aren't used. Shares of targets without any document can't be reached; the rest keep their
    proportions. Without ``total_tokens`` the mixture is the largest in which no document is repeated more than
    max_repeats times; a larger wish is lowered to it. Documents with the same id and length are told apart only by
    chance of order, so ids should be unique.
    """
    spark = docs.sparkSession
    want = read_targets(targets)
    known = docs.where(F.col("text").isNotNull() & source_key("source").isin([t.source for t in want]))
    sized = cut(with_token_counts(known.select(F.col("doc_id").cast("long").alias("doc_id"), source_key("source").alias("source"), "text"), path=tokenizer).where(F.col("n_tokens") > 0))
    counts: dict[str, dict[int, int]] = {}
    # one row per source and length: no more than the longest document's tokens per source
    for r in sized.groupBy("source", "n_tokens").count().toLocalIterator():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    supply = {s: sum(l * c for l, c in x.items()) for s, x in counts.items()}
    there = [t for t in want if supply.get(t.source)]
    whole = sum((t.share for t in there), Fraction(0))
    most = min((t.max_repeats * supply[t.source] * whole / t.share for t in there), default=Fraction(0))
    total = int(most) if total_tokens is None else min(int(most), total_tokens)
    plan = []
    for n, t in enumerate(there):
        budget = min(int(total * t.share / whole), t.max_repeats * supply[t.source])
        rounds, taken = fit(counts[t.source], budget, seed + n)
        plan += [(t.source, l, rounds, k, counts[t.source][l], -(-counts[t.source][l] // RANKED_TOGETHER)) for l, k in taken.items() if rounds or k]
    planned = spark.createDataFrame(plan, "source string, n_tokens long, rounds int, more long, n long, buckets int")
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.join(planned, ["source", "n_tokens"]).withColumn("rank", rank).withColumn("bucket", F.pmod("rank", F.col("buckets")))
    sure = rows.where((F.col("more") == 0) | (F.col("more") == F.col("n"))).withColumn("once", (F.col("more") > 0).cast("int"))
    part = rows.where((F.col("more") > 0) & (F.col("more") < F.col("n")))
    keys = ["source", "n_tokens", "bucket"]
    before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy(*keys).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    placed = part.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "doc_id"))).join(starts, keys)
    picked = placed.withColumn("once", (F.col("place") + F.col("before") <= F.col("more")).cast("int"))
    cols = ["doc_id", "source", "n_tokens", (F.col("rounds") + F.col("once")).cast("int").alias("copies")]
    mixed = sure.select(*cols).unionByName(picked.select(*cols)).where(F.col("copies") > 0)
    goals = spark.createDataFrame([(t.source, float(t.share), t.max_repeats, sum(counts.get(t.source, {}).values()), supply.get(t.source, 0), max(counts.get(t.source, {0: 0}))) for t in want], "source string, target_share double, max_repeats int, n_docs long, supply_tokens long, longest_tokens long")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("copies").alias("c"))
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())  # over the targets, a few rows
    shares = goals.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("t", F.lit(0).cast("long")))
    shares = shares.withColumn("actual_share", F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(0.0))
    return mixed, shares.select(*goals.columns, "mixed_tokens", "actual_share", F.coalesce("c", F.lit(0)).alias("max_copies"))
