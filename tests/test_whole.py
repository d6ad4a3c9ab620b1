"""Queries over whole tables: nothing of the input is left out."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilewright.functions import geometry
from tilewright.operators import matrixsets, ranges
from tilewright.plans.features import FeatureQuery, plan


def test_ranges_are_whole(spark, small):
    """Ranges reach the last zoom and the last tile of the table."""
    f = spark.read.parquet(f"{small}/tile_features.parquet").where("z >= 0 AND x >= 0 AND y >= 0 AND x < (1L << z) AND y < (1L << z)")
    most = f.agg(F.max("z"), F.count_distinct("layer", "z")).first()
    q = entry.queries()
    assert q["pyramid_levels"](spark, small).first()["max_zoom"] == most[0] == 14
    flip = q["range_flip"](spark, small)
    assert flip.count() == most[1] and flip.where("maxx - minx > 40").count() > 0
    # every row of the features lies in one range of the union, and their number is that of the tiles that were counted
    union = q["range_union"](spark, small)
    held = f.select("z", "x", "y").join(union, "z").where("x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy")
    assert held.count() == f.count()
    assert q["range_tiles"](spark, small).count() == 4 * q["tile_moves"](spark, small).count()


RANGE = "k string, z int, minx long, miny long, maxx long, maxy long"


def cells(rows):
    return {(r[-5], x, y) for r in rows for x in range(r[-4], r[-2] + 1) for y in range(r[-3], r[-1] + 1)}


def area(rows):
    return sum((r[-2] - r[-4] + 1) * (r[-1] - r[-3] + 1) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_against_sets_of_tiles(spark, seed):
    """Unions and differences hold each tile once and no other; coverage and neighbours are those of the tiles, none of which is listed."""
    rng = random.Random(seed)
    some = lambda n: [(rng.choice("ab"), rng.choice([5, 6]), x := rng.randrange(20), y := rng.randrange(20), x + rng.randrange(8), y + rng.randrange(8)) for _ in range(n)]
    one, two = some(15), some(10)
    a, b = spark.createDataFrame(one + one[:2], RANGE), spark.createDataFrame(two, RANGE)
    for made, want in ((ranges.union_ranges(a), cells(one)), (ranges.subtract_ranges(a, b), cells(one) - cells(two))):
        got = [tuple(r) for r in made.collect()]
        assert cells(got) == want and area(got) == len(want)
    covered = dict(map(tuple, ranges.covered_ranges(a, b, "k").collect()))
    assert covered == {k: cells(r for r in one if r[0] == k) <= cells(two) for k in {r[0] for r in one}}
    assert all(dict(map(tuple, ranges.covered_ranges(a, a, "k").collect())).values())
    whole = [tuple(r) for r in ranges.traversed(a).collect()]
    for z in (5, 6):
        order = sorted((y, x) for zz, x, y in cells(one) if zz == z)
        after, before = dict(zip(order, order[1:])), dict(zip(order[1:], order))
        for _, y, low, high, px, py, nx, ny in (r for r in whole if r[0] == z):
            assert before.get((y, low), (None, None)) == (py, px) and after.get((y, high), (None, None)) == (ny, nx)


def test_overlapping_ranges_become_three(spark):
    """Two squares of which one covers the other's corner."""
    two = spark.createDataFrame([("a", 4, 0, 0, 9, 9), ("b", 4, 4, 4, 14, 14)], RANGE)
    got = sorted(tuple(r) for r in ranges.union_ranges(two).collect())
    assert got == [(4, 0, 0, 9, 3), (4, 0, 4, 14, 9), (4, 4, 10, 14, 14)] and area(got) == 100 + 121 - 36
    assert ranges.union_ranges(two.limit(0)).collect() == [] and ranges.subtract_ranges(two, two).collect() == []
    assert ranges.union_ranges(spark.createDataFrame([("a", 20, 0, 0, 2**20 - 1, 2**20 - 1)] * 2, RANGE)).count() == 1  # a million million tiles


def test_ranges_of_other_zooms_and_origins(spark):
    a, b = spark.createDataFrame([("a", 3, 0, 0, 1, 1)], RANGE), spark.createDataFrame([("b", 4, 0, 0, 1, 1)], RANGE)
    assert ranges.intersect_ranges(a, b).collect() == []
    with pytest.raises(ValueError, match="different zooms"):
        ranges.require_one_zoom(a, b)
    ranges.require_one_zoom(a, a)
    top, low = a.withColumn("origin", F.lit("TOP_LEFT")), spark.createDataFrame([("c", 3, 0, 6, 1, 7, "bottom-left"), ("d", 3, 0, 0, 1, 1, "bottom-left"), ("e", 3, 1, 6, 9, 6, "BOTTOM_LEFT")], RANGE + ", origin string")
    got = ranges.range_relations(top.withColumnRenamed("k", "i"), low.withColumnRenamed("k", "j"), "i", "j").collect()
    assert {(r["j"], r["contains"], r["intersects"]) for r in got} == {("c", True, True), ("d", False, False), ("e", False, True)}


def test_all_ids_go_through_an_archive(spark, tmp_path):
    """Ids over 400,000 as well, of a run that crosses it and of a level far below."""
    e = [(1, 5, 0, 10, 2), (1, 399_999, 10, 10, 3), (1, 406_500, 20, 10, 1), (2, 90_000_000, 0, 5, 1), (2, 5, 0, 5, 1)]
    spark.createDataFrame(e, "archive_id long, tile_id long, tile_offset long, length_bytes int, run_length int").write.parquet(f"{tmp_path}/tile_entries.parquet")
    back = {r["tile_id"]: r for r in entry.queries()["archive_roundtrip"](spark, str(tmp_path)).collect()}
    assert sorted(back) == [5, 6, 399_999, 400_000, 400_001, 406_500, 90_000_000]
    assert all(r["content"] == f"tile {t // 3}" for t, r in back.items()) and back[90_000_000]["z"] == 14


def test_all_kinds_are_decoded_in_the_plan(spark):
    """Lines, polygons and features without a type have parts, at every zoom, in pixels and in meters."""
    line, ring = geometry.encode("LINESTRING", [[(0, 0), (4096, 0)], [(5, 5), (6, 9)]]), geometry.encode("POLYGON", [[(0, 0), (8, 0), (8, 8), (0, 8)]])
    rows = [(1, 0, 0, "TOP_LEFT", 1, "a", 4096, 1, "LINESTRING", [], line), (2, 0, 0, "TOP_LEFT", 1, "a", 4096, 2, None, [], ring), (9, 7, 7, "BOTTOM_LEFT", 1, "a", 4096, 3, None, [], [9, 4, 6]), (2, 0, 0, None, 1, "a", 4096, 4, "POINT", [], None)]
    f = spark.createDataFrame(rows, "z int, x long, y long, origin string, tile_layer_id long, layer string, extent int, feature_id long, geom_type string, tags array<int>, commands array<int>")
    values = "string_value string, float_value float, double_value double, int_value long, uint_value long, sint_value long, bool_value boolean"
    dictionaries = spark.createDataFrame([], f"tile_layer_id long, layer_keys array<string>, layer_values array<struct<{', '.join(v.replace(' ', ':') for v in values.split(', '))}>>")
    quad = matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")
    got = {r["feature_id"]: (r["kind"], None if r["parts"] is None else [[tuple(p) for p in part] for part in r["parts"]]) for r in plan(FeatureQuery().at_all(), f, dictionaries, quad).collect()}
    assert got == {1: ("LINESTRING", [[(0, 0), (4096, 0)], [(5, 5), (6, 9)]]), 2: ("POLYGON", [[(0, 0), (8, 0), (8, 8), (0, 8)]]), 3: ("POINT", [[(2, 3)]]), 4: (None, None)}
    meters = plan(FeatureQuery().at(1).in_meters(), f, dictionaries, quad).first()["parts"]
    assert abs(meters[0][0]["x"] + 20037508.34) < 1 and abs(meters[0][1]["x"]) < 1 and len(meters) == 2
    half = plan(FeatureQuery().at_all().within((-2e7, 1e6, -1e6, 2e7)), f, dictionaries, quad)
    assert sorted(r["feature_id"] for r in half.select("feature_id").collect()) == [1, 2, 4]


def test_all_levels_and_values(spark, small, tmp_path):
    q = entry.queries()
    assert q["bbox_tile_range"](spark, small).agg(F.max("z")).first()[0] == 17
    square = [0.0] * 16 + [1.0, 0.0, 1.0, 1.0, 0.0, 1.0] + [0.0] * 42
    spark.createDataFrame([(1, square)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert q["ring_area"](spark, str(tmp_path)).first()["area"] == 1_000_000
