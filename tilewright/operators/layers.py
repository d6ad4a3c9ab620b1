"""Features of vector tiles against the dictionaries of their layers, and the dictionaries from features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.blocks import numbered


def tag_pairs(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, k, v: the index pairs of each feature; an odd last tag is none."""
    n = F.floor(F.size("tags") / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("tags", i * 2).alias("k"), F.get("tags", i * 2 + 1).alias("v"))))
    return features.select(*keep, F.inline(pairs))


def value_text(v: Column) -> Column:
    """The one value that is set, as text."""
    return F.coalesce(*[v[f"{k}_value"].cast("string") for k in ("string", "float", "double", "int", "uint", "sint", "bool")])


def value_kind(v: Column) -> Column:
    kinds = ("string", "float", "double", "int", "uint", "sint", "bool")
    return F.coalesce(*[F.when(v[f"{k}_value"].isNotNull(), k) for k in kinds])


def attributes(features: DataFrame, layers: DataFrame, key: str = "tile_layer_id", typed: bool = False) -> DataFrame:
    """The features with ``attributes``, a map of their keys to values as text, or as they are, with their kinds, if ``typed``.

    Index pairs outside the dictionaries are left out; of a key given twice the last pair holds. The dictionaries join
    by layer and are looked up as arrays, without exploding features; skewed layers are split by the adaptive join.
    """
    dims = layers.dropDuplicates([key]).select(F.col(key).alias("__layer"), "layer_keys", F.transform("layer_values", lambda v: F.when(value_text(v).isNotNull(), v) if typed else value_text(v)).alias("__values"))
    n = F.floor(F.size("tags") / 2).cast("int")
    pair = lambda i: F.struct(F.get("layer_keys", F.get("tags", i * 2)).alias("k"), F.get("__values", F.get("tags", i * 2 + 1)).alias("v"))
    pairs = F.filter(F.transform(F.sequence(F.lit(0), n - 1), pair), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    held = F.coalesce(F.when(n > 0, pairs), F.filter(F.array(pair(F.lit(0))), lambda p: F.lit(False)))
    keys = F.array_distinct(F.transform(held, lambda p: p["k"]))
    last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(held, lambda p: p["k"] == k), -1)["v"]))
    joined = features.join(dims, features[key] == F.col("__layer"), "left")
    return joined.select(*[features[c] for c in features.columns], last.alias("attributes"))


def attribute_names(features: DataFrame, layers: DataFrame, key: str = "tile_layer_id", layer: str = "layer") -> DataFrame:
    """layer, name: the attributes that features of a layer have, without looking at values twice: names are made distinct
    per feature's layer before any shuffle but that of the dictionaries."""
    found = attributes(features, layers, key)
    return found.where(F.col(layer).isNotNull()).select(F.col(layer).alias("layer"), F.explode(F.map_keys("attributes")).alias("name")).distinct()


def first_seen_index(rows: DataFrame, by: Sequence[str], item: str, position: str) -> DataFrame:
    """by, item, index: dense numbers from 0 in order of first appearance; the dictionary of a layer."""
    first = rows.groupBy(*by, item).agg(F.min(position).alias("__first"))
    return first.select(*by, item, (F.row_number().over(Window.partitionBy(*by).orderBy("__first", item)) - 1).alias("index"))


def auto_ids(rows: DataFrame, by: Sequence[str], position: str, given: str) -> DataFrame:
    """Adds feature_no: the explicit id, else the running number in the tile, which also advances over explicit ids. Numbers
    go on from block to block of positions, so a tile may hold any share of the rows."""
    return numbered(rows, by, position, [], "feature_no").withColumn("feature_no", F.coalesce(F.col(given), F.col("feature_no") - 1))


def requested_layers(features: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, layer, wish: the distinct layers of each group that were asked for, with their place in the request; unknown
    names are skipped."""
    spark = features.sparkSession
    wishes = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "layer string, wish int")
    return features.select(*by, "layer").distinct().join(F.broadcast(wishes), "layer").select(*by, "layer", "wish")


def collection_members(df: DataFrame, key: str, members: str, start_id: str) -> DataFrame:
    """One row per member of an array, with the other columns and an id of its own that goes on from ``start_id``."""
    others = [c for c in df.columns if c != members]
    rows = df.select(*others, F.posexplode(members).alias("member_no", "member"))
    return rows.withColumn("member_id", F.col(start_id) + F.col("member_no"))
