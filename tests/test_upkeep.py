"""Edge cases of the general problems: nulls, ties, repeated rows, empty tables, hot keys, clashing column names."""

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tilewright.operators import blocks, compaction, drift, heavy_tiles, ledger, snapshots, tree
from tilewright.session import scratch_path

FEATURES = "z int, x long, y long, origin string, tile_layer_id long, feature_id long, node string"


def day(n, h=0):
    return datetime(2025, 1, n, h)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# tree aggregation


@pytest.mark.parametrize("fan_in,chunk", [(2, 64), (3, 256), (16, 65_536), (4, 1)])
def test_tree_gives_plain_aggregate(spark, fan_in, chunk):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), "id", F.lit(1).alias("__tree")).repartition(17)
    states = {"n": tree.counted(), "s": tree.summed(F.col("id")), "lo": tree.lowest(F.col("id")), "hi": tree.highest(F.col("id"))}
    got = rows_of(tree.tree_aggregate(df, ["k"], states, fan_in, chunk_rows=chunk))
    assert got == rows_of(df.groupBy("k").agg(F.count("id"), F.sum("id"), F.min("id"), F.max("id")))


def test_no_task_gets_more_than_fan_in_states_of_a_key(spark):
    """A key with nine tenths of all rows: each node of each round is made of fan_in states of it at most, the last merge too."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), "id").repartition(11).sortWithinPartitions("k", "id")
    width, fan_in = tree.partitions_of(df), 4
    assert width == 11
    chunks = df.withColumn("n", F.monotonically_increasing_id())
    leaf = F.shiftright("n", 33) + F.shiftright(F.col("n").bitwiseAND(F.lit((1 << 33) - 1)), 8) * width
    below = chunks.withColumn(tree.NODE, leaf).select("k", tree.NODE).distinct()
    assert below.where("k = 0").count() >= 36_000 / 256
    made = tree.levels(df, ["k"], {"n": tree.counted()}, fan_in, chunk_rows=256)
    assert len(made) == 3  # of 11 + 157 chunks: 42 nodes, 11, 3, and then the key
    for level in made:
        into = below.groupBy("k", F.floor(F.col(tree.NODE) / fan_in).alias("up")).count()
        assert into.agg(F.max("count")).first()[0] <= fan_in
        assert into.count() == level.count() and level.agg(F.sum("n")).first()[0] == 40_000
        below = level.select("k", tree.NODE)
    assert below.groupBy("k").count().agg(F.max("count")).first()[0] <= fan_in


def test_tree_has_levels_whatever_the_partitions(spark):
    df = spark.createDataFrame([(1, 0, 0, "TOP_LEFT", 1, i, "n") for i in range(9)], FEATURES)
    for n in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            plan = heavy_tiles.features_per_tile(df)
            assert tree.NODE in plan._jdf.queryExecution().executedPlan().toString() and rows_of(plan) == [(1, 0, 0, 9)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tree.rounds(n, 16) for n in (1, 16, 17, 256, 257, 10**6)] == [2, 2, 2, 2, 3, 5]


def test_tree_null_keys_empty_and_sketches(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("a", None)], "k string, v int")
    assert rows_of(tree.distinct_per_key(df, ["k"], ["v"])) == rows_of(spark.createDataFrame([(None, 1), ("a", 1)], "k string, v long"))
    assert tree.distinct_per_key(df.limit(0), ["k"], ["v"]).collect() == []
    est = tree.tree_aggregate(spark.range(1000).withColumn("k", F.lit(1)), ["k"], {"d": tree.sketched_distinct(F.col("id"))}, 2, chunk_rows=8).first()["d"]
    assert 900 < est < 1100
    with pytest.raises(ValueError):
        tree.tree_aggregate(df, ["k"], {}, 1)


def test_heavy_tiles_dirty_rows(spark):
    rows = [(1, 0, 0, "TOP_LEFT", 1, i, "n") for i in range(90)] + [(1, 0, 1, "bottom-left", 1, 0, "n")] * 50  # the same tile and feature
    rows += [(1, 1, 1, None, 2, i, "n") for i in range(10)]
    rows += [(None, 0, 0, None, 3, 1, "n"), (1, 2, 0, None, 3, 2, "n"), (1, -1, 0, None, 3, 3, "n"), (1, 0, 0, None, None, 4, "n"), (63, 1, 1, None, 3, 5, "n"), (-1, 0, 0, None, 3, 6, "n")]
    df = spark.createDataFrame(rows, FEATURES)
    assert rows_of(heavy_tiles.features_per_tile(df)) == [(1, 0, 0, 90), (1, 1, 1, 10)]
    assert rows_of(heavy_tiles.heavy_tiles(df, 0.5)) == [(1, 0, 0)]
    assert heavy_tiles.heavy_tiles(df.limit(0)).collect() == []


# snapshots

SNAPS = "snapshot_no int, listed_at timestamp, kind string, object_key string, size_bytes long, last_modified timestamp, etag string, new boolean"


def snap(no, key, etag, size=1, modified=day(1), listed=day(2), kind="File"):
    return (no, listed, kind, key, size, modified, etag, True)


def test_snapshot_changes(spark):
    rows = [snap(2, "same", 'W/"AB"'), snap(5, "same", "ab"), snap(2, "gone", "x"), snap(5, "new", "y"), snap(2, "etag", "a"), snap(5, "etag", "b")]
    rows += [snap(2, "size", None, 1), snap(5, "size", "q", 2), snap(2, "sec", '""', 1, datetime(2025, 1, 1, 0, 0, 0, 5)), snap(5, "sec", "q", 1, day(1))]
    rows += [snap(2, "twice", "old", 1, day(1)), snap(2, "twice", "z", 1, day(3)), snap(5, "twice", "z", 1, day(3)), snap(5, "twice", "z", 1, day(3))]
    rows += [snap(2, "nulls", None, None, None), snap(5, "nulls", None, None, None), snap(5, None, "k"), snap(5, "dir", None, kind="Directory"), snap(None, "same", "k")]
    got = rows_of(snapshots.snapshot_changes(spark.createDataFrame(rows, SNAPS)))
    assert got == [(5, "etag", "changed"), (5, "gone", "removed"), (5, "new", "added"), (5, "size", "changed")]
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAPS)).collect() == []
    assert snapshots.snapshot_changes(spark.createDataFrame([snap(1, "a", "b")], SNAPS)).collect() == []


# ledger

DELIVERIES = "delivery_id long, delivered_at timestamp, kind string, object_key string, last_modified timestamp, version_id string, state string"
RUNS = "run_id int, started_at timestamp, run_status string"


def test_each_version_once(spark):
    d = [(1, day(1), "File", "a", day(1), "v1", "s"), (2, day(2), "File", "a", day(1), "v1", "s"), (3, day(2), "File", "a", datetime(2025, 1, 1, 0, 0, 0, 9), "null", "s"), (4, day(1), "File", "a", day(1), None, "s")]
    d += [(5, day(9), "File", "late", day(9), "", "s"), (6, None, "File", "undated", day(1), "v", "s"), (7, day(1), "Directory", "a", day(1), "v2", "s"), (8, day(1), "File", None, day(1), "v2", "s"), (9, day(3, 1), "File", "b", None, None, "s")]
    runs = [(1, day(1), "failed"), (2, day(2), "succeeded"), (3, day(3), "killed"), (4, day(4), "succeeded"), (5, None, "succeeded")]
    items = ledger.object_versions(spark.createDataFrame(d, DELIVERIES))
    h = ledger.lease_history(items, "delivered_at", spark.createDataFrame(runs, RUNS))
    got = {r["delivery_id"]: (r["state"], r["first_run"], r["done_run"], r["n_leases"]) for r in h.collect()}
    assert got == {1: ("done", 1, 2, 2), 4: ("done", 1, 2, 2), 5: ("pending", None, None, 0), 6: ("pending", None, None, 0), 9: ("done", 4, 4, 1)}
    none = ledger.lease_history(items, "delivered_at", spark.createDataFrame([], RUNS))
    assert {r["state"] for r in none.collect()} == {"pending"}


def test_lease_history_against_loop(spark):
    rng = random.Random(3)
    runs = [(i, datetime(2025, 1, 1 + rng.randrange(20), rng.randrange(24)), rng.choice(["succeeded", "failed"])) for i in range(40)]
    items = [(i, datetime(2025, 1, 1 + rng.randrange(25), rng.randrange(24))) for i in range(500)]
    df = spark.createDataFrame(items, "id int, at timestamp").withColumn("token", F.lit("mine"))
    got = {r["id"]: r["done_run"] for r in ledger.lease_history(df, "at", spark.createDataFrame(runs, "run_id int, started_at timestamp, run_status string")).collect()}
    for i, at in items:
        assert got[i] == next((r[0] for r in sorted(runs, key=lambda r: (r[1], r[0])) if r[2] == "succeeded" and r[1] >= at), None)


def replayed(items, runs):
    """The ledger event by event, each item on its own: (done run, leases, refused commits)."""
    order = sorted(runs, key=lambda r: (r[1], r[0]))
    events = []
    for i, (run, start, status, end) in enumerate(order):
        end = max(end or start, start)
        nxt = order[i + 1][1] if i + 1 < len(order) else None
        until = end if status == "succeeded" else min(end, nxt or end)
        back = end if status == "succeeded" else max(until, nxt or until) + timedelta(microseconds=1)
        events += [(start, i, 0, run, until), (back, i, 1, run, until)]
    out = {}
    for item, at in items:
        holder, until, done, leased, refused = None, None, None, set(), 0
        for when, i, kind, run, ends in sorted(events):
            if kind == 0 and when >= at and done is None and (holder is None or until <= when):
                holder, until = run, ends
                leased.add(run)
            elif kind == 1 and run in leased:
                if done is None and holder == run and when <= until:
                    done = run
                else:
                    refused += 1
        out[item] = (done, len(leased), refused)
    return out


def test_lease_history_with_runs_that_overlap(spark):
    rng = random.Random(8)
    runs = [(i, s := datetime(2025, 1, 1 + rng.randrange(9), rng.randrange(24)), rng.choice(["succeeded", "failed", "killed", None]), rng.choice([None, s + timedelta(hours=rng.randrange(0, 60))])) for i in range(40)]
    items = [(i, datetime(2025, 1, 1 + rng.randrange(10), rng.randrange(24))) for i in range(300)]
    log = spark.createDataFrame(runs, "run_id int, started_at timestamp, run_status string, finished_at timestamp")
    h = ledger.lease_history(spark.createDataFrame(items, "id int, at timestamp"), "at", log)
    got = {r["id"]: (r["done_run"], r["n_leases"], r["n_refused"]) for r in h.collect()}
    want = replayed(items, runs)
    assert got == want and any(w[2] for w in want.values()) and any(w[0] is None for w in want.values())


def test_live_ledger(spark):
    led = ledger.Ledger(spark, scratch_path(spark, "ledger"), ["k"])
    led.add(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "first")
    led.add(spark.createDataFrame([("a",), ("b",)], "k string"), "first")  # a retry
    state = lambda now: {r["k"]: r["state"] for r in led.state(now).collect()}
    assert state(0) == {"a": "pending", "b": "pending"}
    t1 = led.lease("r1", now=0, seconds=10)
    assert state(5) == {"a": "leased", "b": "leased"} and state(11) == {"a": "pending", "b": "pending"}
    led.add(spark.createDataFrame([("c",)], "k string"), "second")
    t2 = led.lease("r2", now=20, seconds=10)
    assert t2 > t1 and led.leased(t2).count() == 3
    assert led.commit("r1", t1, now=21).collect() == []  # a stale writer
    assert {r["k"]: r["n_refused"] for r in led.state(21).collect()} == {"a": 1, "b": 1, "c": 0}
    base = led.compact()
    assert led.commit("r2", t2, now=22).count() == 3 and led.commit("r2", t2, now=23).count() == 3
    assert len(led._log()) == 2 and led._log()[0]["seq"] == base
    assert state(1e9) == {"a": "done", "b": "done", "c": "done"}
    assert led.leased(led.lease("r3", now=2e9, seconds=1)).count() == 0


def test_a_commit_after_its_lease_ran_out_does_not_count(spark):
    led = ledger.Ledger(spark, scratch_path(spark, "ledger"), ["k"])
    led.add(spark.createDataFrame([("a",)], "k string"), "first")
    t = led.lease("r", now=0, seconds=10)
    assert led.commit("r", t, now=11).count() == 0 and led.state(12).first()["state"] == "pending"
    t = led.lease("r", now=20, seconds=10)
    assert led.commit("r", t, now=30).count() == 1


def test_item_paths_are_deterministic(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "k string, v string")
    p = [r[0] for r in df.select(ledger.item_path("s3://x/", "k", "v")).collect()]
    assert p[0] == p[2] != p[1]


# compaction

FILES = "dataset string, kind string, object_key string, size_bytes long, last_modified timestamp, etag string, version_id string, payload binary, pack string"


def test_compaction(spark):
    f = lambda ds, key, size=3, at=day(1), payload=b"abc": (ds, "File", key, size, at, None, None, payload, "p")
    rows = [f("a/b", f"a/b/{i}") for i in range(12)] + [f("a/b", "a/b/1")] * 5  # copies
    rows += [f("a/b", "a/b/_tmp/1"), f("a/b", "a/b/x/.hid"), f("a/b", "a/b/big", 70000, payload=None), f("a/b", "a/b/zero", 0, payload=b""), f("a/b", "a/b/0", 99, day(2), b"new"), f("few", "few/1"), f(None, "n/1"), f("a/b", None)]
    rows += [f("a/b", "a/b/noname", None), f("a/b", "a/b/absent", 9, payload=None), ("a/b", "Directory", "a/b/dir", 3, day(1), None, None, None, "p")]
    out = scratch_path(spark, "t") + "/packs"
    got = {r["object_key"]: r for r in compaction.compact(spark.createDataFrame(rows, FILES), out, 1 << 20).collect()}
    assert set(got) == {f"a/b/{i}" for i in range(12)} | {"a/b/noname", "a/b/absent"}
    assert got["a/b/0"]["payload"] == b"new" and got["a/b/noname"]["size_bytes"] == 3 and got["a/b/absent"]["payload"] is None
    assert compaction.compact(spark.createDataFrame([], FILES), scratch_path(spark, "t") + "/packs").collect() == []


def test_packs_have_the_wanted_size(spark):
    """A dataset much larger than a pack is split, tiny ones stay one file each; a table read from files is packed by places."""
    import os

    size = F.when(F.col("id") % 10 < 8, 20_000).otherwise(100)
    rows = spark.range(400).repartition(8).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 2)).alias("dataset"), F.lit("File").alias("kind"), F.concat(F.lit("k/"), F.col("id")).alias("object_key"), F.lit(None).cast("long").alias("size_bytes"),
        F.lit(day(1)).alias("last_modified"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("version_id"), F.substring(F.concat(*[F.sha2((F.col("id") * 1000 + k).cast("string"), 512) for k in range(160)]).cast("binary"), 1, 20_000).alias("payload"), size.alias("n"),
    ).withColumn("payload", F.expr("substring(payload, 1, n)"))
    path = scratch_path(spark, "t")
    rows.unionByName(rows).write.parquet(path)  # each row twice
    listing = spark.read.parquet(path)
    assert compaction.has_places(listing) and not compaction.has_places(spark.createDataFrame([], FILES))
    out = scratch_path(spark, "t") + "/packs"
    packs = compaction.compact(listing, out, target_bytes=1 << 20)
    assert packs.count() == packs.select("object_key").distinct().count() == 400
    files = {d: [f for f in os.listdir(f"{out.removeprefix('file://')}/{d}") if f.endswith(".parquet")] for d in os.listdir(out.removeprefix("file://")) if d.startswith("pack=")}
    assert len(files["pack=big"]) >= 3 and len(files["pack=s0"]) == len(files["pack=s1"]) == 1
    assert not [n for n in os.listdir(os.path.dirname(path.removeprefix("file://"))) if n.startswith(("live-", "packs-"))]


def test_compaction_refuses_a_mismatch(spark, monkeypatch):
    rows = [("d", "File", f"d/{i}", 3, day(1), None, None, b"abc", "p") for i in range(10)]
    seen = iter([(10, 1, 1), (9, 1, 1)])
    monkeypatch.setattr(compaction, "checksum", lambda *a: next(seen))
    out = scratch_path(spark, "t") + "/packs"
    with pytest.raises(ValueError):
        compaction.compact(spark.createDataFrame(rows, FILES), out)


# drift


def test_assignment_is_optimal():
    import itertools

    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        w = [[round(rng.random(), 3) for _ in range(m)] for _ in range(n)]
        got = drift.assign(w)
        assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got) == min(n, m)
        total = sum(w[i][j] for i, j in enumerate(got) if j >= 0)
        small, large = (w, m) if n <= m else ([[w[i][j] for i in range(n)] for j in range(m)], n)
        best = max(sum(row[j] for row, j in zip(small, p)) for p in itertools.permutations(range(large), len(small)))
        assert abs(total - best) < 1e-9


def test_layer_changes():
    old = [{"id": "roads", "fields": {"maxSpeed": "int", "name": "String", "lit": "bool"}}, {"id": "old", "fields": {"a": "int"}}, None]
    new = [{"id": "Roads", "fields": {"max_speed": "Text", "name": "text", "toll": "bool"}}, {"id": "fresh"}, {"id": None}]
    got = {r[:3] for r in drift.layer_changes(old, new)}
    assert got == {("Roads", "", "layer_renamed"), ("Roads", "max_speed", "renamed"), ("Roads", "max_speed", "retyped"), ("Roads", "lit", "removed"), ("Roads", "toll", "added"), ("old", "", "layer_removed"), ("fresh", "", "layer_added")}
    assert drift.layer_changes([], []) == []


META = "tileset string, build_no int, received_at timestamp, archive_id long, vector_layers array<struct<id:string,fields:map<string,string>>>, layers string"


def test_builds(spark):
    lay = lambda **f: [{"id": "l", "fields": f}]
    rows = [("t", 1, day(1), 1, lay(a="int"), "x"), ("t", 1, day(2), 2, lay(a="int", b="int"), "x"), ("t", 2, day(3), 3, None, "x"), ("t", 4, day(4), 4, lay(a="str"), "x"), ("t", 4, day(4), 4, lay(a="str"), "x"), (None, 1, day(1), 5, lay(z="int"), "x"), ("u", 1, None, 6, [], "x")]
    df = spark.createDataFrame(rows, META)
    assert rows_of(drift.build_changes(df).select("tileset", "build_no", "field_name", "change_kind")) == [("t", 4, "a", "retyped"), ("t", 4, "b", "removed")]
    assert rows_of(drift.consistent_layers(df).select("field_key", "field_type", "n_builds")) == [("a", "string", 2), ("b", "number", 1)]
    assert drift.build_changes(df.limit(0)).collect() == []


def test_likely_renames_against_all_matchings(spark, small):
    """On the test table: of all ways to pair what went with what came in a layer, those reported weigh most."""
    import itertools

    meta = spark.read.parquet(f"{small}/archive_metadata.parquet")
    got = {(r["tileset"], r["build_no"], r["layer_id"], r["old_name"], r["field_name"]): r["similarity"] for r in drift.likely_renames(meta).where("field_name <> ''").collect()}
    gone, come = defaultdict(set), defaultdict(set)
    for r in drift.build_changes(meta).where("field_name <> ''").collect():
        side, kind = {"removed": (gone, r["old_type"]), "added": (come, r["new_type"])}.get(r["change_kind"], (None, None))
        if side is not None:
            side[r["tileset"], r["build_no"], r["layer_id"]].add(drift.Profile(r["field_name"], drift.type_class(kind)))
    assert got and sum(len(x) > 1 for x in gone.values())
    for key in gone.keys() & come.keys():
        a, b = sorted(gone[key], key=str), sorted(come[key], key=str)
        if len(a) > len(b):
            ways = [list(zip(p, b)) for p in itertools.permutations(a, len(b))]
        else:
            ways = [list(zip(a, p)) for p in itertools.permutations(b, len(a))]
        weigh = lambda way: sum(drift.similarity(x, y) for x, y in way)
        best = max(map(weigh, ways))
        mine = {(o, n): s for (*k, o, n), s in got.items() if tuple(k) == key}
        assert any(abs(weigh(w) - best) < 1e-9 and {(x.name, y.name) for x, y in w if drift.similarity(x, y) >= drift.LIKELY} == set(mine) for w in ways)


def test_schemas_of_files(spark):
    root = scratch_path(spark, "drift")
    for n, df in enumerate([spark.range(3).withColumn("a", F.lit("x")), spark.range(3).withColumn("a", F.lit("y")), spark.range(2).withColumn("b", F.lit(1))]):
        df.write.parquet(f"{root}/{n}")
    found = drift.schema_versions(spark, root)
    assert [(n, df.columns, df.count()) for n, df in found] == [("v1", ["id", "a"], 6), ("v2", ["id", "b"], 2)]


def test_unify_tables(spark):
    a = spark.createDataFrame([(i, f"n{i}", 1.5) for i in range(50)], "id int, customer_name string, price double")
    b = spark.createDataFrame([(i, f"n{i}", "x") for i in range(50)], "id long, client string, Extra string")
    out, report = drift.unify([("v1", a), ("v2", b)])
    assert ("v2", "client", "renamed", "customer_name") in report and ("v2", "id", "retyped", "int") in report and ("v2", "price", "removed", "") in report and ("v2", "Extra", "added", "") in report
    assert out.count() == 100 and out.where("client IS NULL").count() == 0 and dict(out.dtypes)["id"] == "double"
    empty, _ = drift.unify([("v1", a.limit(0)), ("v2", b)])
    assert empty.count() == 50


# blocks


def test_previous_number(spark):
    rng = random.Random(5)
    data = [(g, rng.randrange(-500, 500)) for g in ["a", None] for _ in range(200)] + [("a", None)]
    got = {(r["g"], r["n"]): r["previous"] for r in blocks.previous_number(spark.createDataFrame(data, "g string, n int"), ["g"], "n", width=16).collect()}
    per = defaultdict(set)
    for g, n in data:
        if n is not None:
            per[g].add(n)
    for g, ns in per.items():
        s = sorted(ns)
        assert [got[g, n] for n in s] == [None, *s[:-1]]


@pytest.mark.parametrize("width", [3, 4096])
def test_numbers_and_neighbours_in_blocks(spark, width):
    rng = random.Random(width)
    data = [(g, rng.randrange(-40, 40), i) for g in ["a", None] for i in range(120)]
    df = spark.createDataFrame(data + [("a", None, 999)], "g string, n int, i int")
    got = {(r["g"], r["i"]): r["no"] for r in blocks.numbered(df, ["g"], "n", ["i"], "no", width).collect()}
    assert got["a", 999] == 1
    near = {(r["g"], r["i"]): (r["p"], r["q"]) for r in blocks.beside(df.where("n IS NOT NULL"), ["g"], "n", ["i"], {"p": F.col("i")}, {"q": F.col("i")}, width).collect()}
    for g in ["a", None]:
        order = [i for h, n, i in sorted(data, key=lambda r: (str(r[0]), r[1], r[2])) if h == g]
        assert [got[g, i] for i in order] == list(range(2 if g else 1, 122 if g else 121))
        assert [near[g, i] for i in order] == list(zip([None, *order], [*order[1:], None]))


def test_asof_against_loop(spark):
    rng = random.Random(7)
    entries = [(rng.choice("ab"), rng.randrange(0, 3000), rng.randrange(9)) for _ in range(300)]
    keys = [(rng.choice("abc"), rng.randrange(-50, 3100), i) for i in range(400)] + [("a", None, 400)]
    got = blocks.asof(spark.createDataFrame(keys, "g string, at long, k int"), spark.createDataFrame(entries, "g string, pos long, v int"), ["g"], "at", "pos", 64)
    for r in got.collect():
        ok = [(p, v) for g, p, v in entries if g == r["g"] and r["at"] is not None and p <= r["at"]]
        assert (tuple(r["entry"]) if r["entry"] else None) == (max(ok) if ok else None)
    assert len(got.collect()) == 401


def test_hot_key_is_spread(spark):
    """A third of a million rows on one tile end within seconds, as their copies vanish before they meet."""
    df = spark.range(300_000).select(F.lit(3).alias("z"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(None).cast("string").alias("origin"), F.lit(1).cast("long").alias("tile_layer_id"), (F.col("id") % 1000).alias("feature_id"))
    t = time.time()
    assert sum(r["n_features"] for r in heavy_tiles.features_per_tile(df).collect()) > 1000
    assert time.time() - t < 60


def test_lease_sees_what_came_between(spark, monkeypatch):
    led = ledger.Ledger(spark, scratch_path(spark, "ledger"), ["k"])
    led.add(spark.createDataFrame([("a",)], "k string"), "first")
    real, other = ledger.create_once, []

    def late(s, path, text):
        if '"run": "slow"' in text and not other:
            other.append(ledger.Ledger(spark, led.root, ["k"]))
            monkeypatch.setattr(ledger, "create_once", real)
            other[0].lease("fast", now=0, seconds=100)
        return real(s, path, text)

    monkeypatch.setattr(ledger, "create_once", late)
    assert led.leased(led.lease("slow", now=0, seconds=100)).count() == 0
