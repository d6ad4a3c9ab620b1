"""How often each term occurs and in how many records, from bitmaps of record numbers.

The layout is vertical: per term, the numbers of the records that hold it, as 64-bit words of a bitmap of which only
those that aren't empty are stored, each with a counter of occurrences beside it. Words are united by bitwise or, so a
repeated record counts once; document frequency is the number of bits. Records are numbered densely inside blocks of
bounded size, so words are filled and no task ever holds all of a term; bitmaps are made and united where the block's
rows lie, and only each term's cardinalities leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.drift import current_builds
from tilewright.session import cut

WORD, COUNT, NUMBER = "word", "occurrences", "word_no"
#: Deliveries of a layer's features that are put together; a layer with more is cut into blocks by feature.
BLOCK = 4096
#: Layers that are cut, up to which they are sent to all executors; beyond, the optimizer joins them.
BROADCAST_LAYERS = 1_000_000


def record_words(df: DataFrame, keys: Sequence[str], number: str, occurrences: Column | None = None) -> DataFrame:
    """keys, word_no, word, occurrences: the bitmap of ``number`` (BIGINT) per keys. Null numbers are left out."""
    no = F.col(number).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), no.bitwiseAND(F.lit(63)).cast("int"))
    rows = df.where(F.col(number).isNotNull()).withColumn(NUMBER, F.shiftright(no, 6))
    return rows.groupBy(*keys, NUMBER).agg(F.bit_or(bit).alias(WORD), (F.count(F.lit(1)) if occurrences is None else F.sum(occurrences)).alias(COUNT))


def merge_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of bitmaps, also of several batches; counters are added."""
    return words.groupBy(*keys, NUMBER).agg(F.bit_or(WORD).alias(WORD), F.sum(COUNT).alias(COUNT))


def frequencies(words: DataFrame, terms: Sequence[str]) -> DataFrame:
    """terms, n_records (cardinality of the bitmap), n_occurrences."""
    return words.groupBy(*terms).agg(F.sum(F.bit_count(WORD)).alias("n_records"), F.sum(COUNT).alias("n_occurrences"))


def cardinality(df: DataFrame, groups: Sequence[str], number: str) -> DataFrame:
    """One row: n_total, the distinct (groups, number)."""
    return record_words(df, groups, number).agg(F.coalesce(F.sum(F.bit_count(WORD)), F.lit(0)).alias("n_total"))


def plain_value(value: Column) -> Column:
    """Lower case, trimmed, inner white space as one space; null where nothing is left."""
    out = F.trim(F.regexp_replace(F.lower(value), r"[\s\p{Z}]+", " "))
    return F.when(out != "", out)


def feature_blocks(features: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tile_layer_id, part, features: set of structs feature_id, tags), and (tile_layer_id, parts) of layers that were cut.

    Layers of more than ``block`` deliveries, which a count of one column finds, are cut by feature, so a block holds some
    ``block`` features at most, whatever a layer's share of the rows. Copies vanish before the shuffle. Rows with null ids
    don't count.
    """
    block = block or BLOCK
    rows = features.where(F.col("tile_layer_id").isNotNull() & F.col("feature_id").isNotNull()).select("tile_layer_id", "feature_id", "tags")
    large = rows.groupBy("tile_layer_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
    large = cut(large)
    if large.count() <= BROADCAST_LAYERS:
        large = F.broadcast(large)
    part = F.coalesce(F.pmod(F.xxhash64("feature_id"), F.col("parts")), F.lit(0).cast("long")).cast("int")
    rows = rows.join(large, "tile_layer_id", "left").select("tile_layer_id", part.alias("part"), F.struct("feature_id", "tags").alias("f"))
    return rows.groupBy("tile_layer_id", "part").agg(F.collect_set("f").alias("features")), large


def value_words(blocks: DataFrame, large: DataFrame, layers: DataFrame) -> DataFrame:
    """term, tile_layer_id, part, word_no, word, occurrences of the string values that tags refer to; records are features.

    A layer's dictionary goes to each of its blocks by the same shuffle that brings a block's features together, and each
    feature's terms are looked up there. Bitmaps are built per (key index, value index) and united per term without
    another shuffle. An occurrence is one distinct reference (feature, key index, value index). A pair counts if both
    indices are inside the layer's dictionaries; an odd last tag is no pair.
    """
    entries = layers.where(F.col("tile_layer_id").isNotNull()).select("tile_layer_id", F.struct(F.size("layer_keys").alias("n_keys"), F.transform("layer_values", lambda v: plain_value(v["string_value"])).alias("terms")).alias("d"))
    entries = entries.join(large, "tile_layer_id", "left").select("tile_layer_id", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "d")
    entries = entries.groupBy("tile_layer_id", "part").agg(F.collect_set("d").alias("dictionaries"))  # one, but for repeated rows

    def references(f: Column) -> Column:
        n = F.floor(F.size(f["tags"]) / 2).cast("int")
        pair = lambda i, d: F.struct(F.get(f["tags"], i * 2).alias("k"), F.get(f["tags"], i * 2 + 1).alias("v"), F.get(d["terms"], F.get(f["tags"], i * 2 + 1)).alias("term"), d["n_keys"].alias("n"))
        each = F.flatten(F.transform("dictionaries", lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: pair(i, d))))
        return F.when(n > 0, F.filter(each, lambda p: p["term"].isNotNull() & (p["k"] >= 0) & (p["k"] < p["n"]) & (p["v"] >= 0)))

    met = blocks.join(entries, ["tile_layer_id", "part"])
    rows = met.select("tile_layer_id", "part", F.explode(F.transform("features", lambda f: F.struct(f["feature_id"].alias("feature_id"), references(f).alias("refs")))).alias("f"))
    number = F.dense_rank().over(Window.partitionBy("tile_layer_id", "part").orderBy("f.feature_id")) - 1
    refs = rows.select("tile_layer_id", "part", number.alias("number"), F.inline("f.refs"))
    group = ["tile_layer_id", "part", "term"]
    by_index = record_words(refs, [*group, "k", "v"], "number", F.lit(0))
    return merge_words(by_index.withColumn(COUNT, F.bit_count(WORD)), group)


def field_words(metadata: DataFrame) -> DataFrame:
    """term, tileset, word_no, word, occurrences of the field names of layers; records are builds."""
    rows = current_builds(metadata).select("tileset", "build_no", F.explode("layers").alias("l"))
    rows = rows.select("tileset", "build_no", F.explode(F.map_keys("l.fields")).alias("name"))
    return record_words(rows.withColumn("term", F.lower("name")), ["term", "tileset"], "build_no")


def term_statistics(features: DataFrame, layers: DataFrame, metadata: DataFrame) -> DataFrame:
    """place (value, field), term, n_records, n_occurrences, n_total: all records of the place."""
    blocks, large = feature_blocks(features)
    total = blocks.agg(F.coalesce(F.sum(F.size(F.array_distinct(F.transform("features", lambda f: f["feature_id"])))), F.lit(0)).cast("long").alias("n_total"))
    values = frequencies(value_words(blocks, large, layers), ["term"]).crossJoin(F.broadcast(total))
    fields = frequencies(field_words(metadata), ["term"]).crossJoin(F.broadcast(cardinality(current_builds(metadata), ["tileset"], "build_no")))
    cols = ["term", "n_records", "n_occurrences", "n_total"]
    return values.select(F.lit("value").alias("place"), *cols).unionByName(fields.select(F.lit("field").alias("place"), *cols))


def marked(statistics: DataFrame, rare_below: int = 3, common_percent: dict[str, int] | None = None) -> DataFrame:
    """place, term, mark: rare in fewer than ``rare_below`` records, common in more than the place's percentage.

    In a very small collection a term may be both; it then has two rows.
    """
    percent = common_percent or {"value": 10, "field": 50}
    limit = F.create_map(*[F.lit(x) for kv in percent.items() for x in kv])[F.col("place")]
    marks = F.array(
        F.when(F.col("n_records") < rare_below, "rare"), F.when(F.col("n_records") * 100 > F.col("n_total") * limit, "common")
    )
    return statistics.select("place", "term", F.explode(F.array_compact(marks)).alias("mark"))
