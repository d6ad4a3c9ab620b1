"""Queries on archives, layers, features and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geometry, glob, grids, hilbert, names, tiles
from tilewright.operators import directory, layers, matrixsets
from tilewright.plans.features import FeatureQuery, plan
from tilewright.queries.grid import HW, TILES, UNHILBERT, _tiles
from tilewright.session import scratch_path, table
from tilewright.sources import pmtiles, providers, storage, tilejson


def entry_list(spark, d):
    """Tile entries and leaf pointers of the archives, told apart."""
    e = table(spark, d, "tile_entries").distinct()
    return e.groupBy("archive_id", "dir_level").agg(F.count_if(F.col("run_length") == 0).alias("n_leaves"), F.count_if(F.col("run_length") > 0).alias("n_tiles"))


def directory_totals(spark, d):
    return directory.totals(table(spark, d, "tile_entries").distinct(), ["archive_id"])


def expand_runs(spark, d):
    """All addressed ids of an archive, counted by id modulo nothing: each id with the number of entries that address it."""
    ids = directory.expand_runs(table(spark, d, "tile_entries").distinct(), ["archive_id"])
    return ids.groupBy("archive_id", "tile_id").agg(F.count(F.lit(1)).alias("n"))


def tiles_by_zoom(spark, d):
    return directory.tiles_at_zoom(table(spark, d, "tile_entries"), 9, ["archive_id"]).distinct()


def _clean(spark, d):
    """Entries whose ids are unique in their archive: the least offset and longest run of those that share an id."""
    e = table(spark, d, "tile_entries").where("run_length > 0")
    best = e.groupBy("archive_id", "tile_id").agg(F.min(F.struct("tile_offset", -F.col("run_length"), F.coalesce("length_bytes", F.lit(0)).alias("n"))).alias("s"))
    return best.select("archive_id", "tile_id", F.col("s.tile_offset").alias("tile_offset"), F.col("s.n").alias("length_bytes"), (-F.col("s.col2")).alias("run_length"))


CLEAN = """SELECT archive_id, tile_id, tile_offset, length_bytes, run_length FROM (
  SELECT archive_id, tile_id, tile_offset, coalesce(length_bytes, 0) AS length_bytes, run_length,
         row_number() OVER (PARTITION BY archive_id, tile_id ORDER BY tile_offset, run_length DESC, coalesce(length_bytes, 0)) AS rn FROM tile_entries WHERE run_length > 0) WHERE rn = 1"""


def asof_tile_lookup(spark, d):
    """Which entry addresses a tile: for ids at and between all entries of every archive."""
    e = _clean(spark, d)
    keys = e.select("archive_id", F.explode(F.array(F.col("tile_id"), F.col("tile_id") + 7)).alias("tile_id")).distinct()
    return directory.lookup(keys, e).select("archive_id", "tile_id", "entry_id", "tile_offset", "run_length")


def exact_entry_lookup(spark, d):
    e = _clean(spark, d)
    keys = e.select("archive_id", (F.col("tile_id") + 1).alias("tile_id")).distinct()
    return keys.join(e, ["archive_id", "tile_id"])


def directory_codec(spark, d):
    """The columns of each archive's directory as they are written: delta of ids, stored offsets."""
    return directory.encode(_clean(spark, d), ["archive_id"])


def directory_decode(spark, d):
    """Decoded from what was encoded: ids and offsets come back."""
    coded = directory.encode(_clean(spark, d), ["archive_id"])
    ids = directory.decode_ids(coded, ["archive_id"])
    return directory.decode_offsets(ids, ["archive_id"]).select("archive_id", "tile_id", "tile_offset", "length_bytes", "run_length")


def _archive(spark, d, **how):
    """An archive of the tiles of all archives' entries, with leaf directories."""
    ids = directory.expand_runs(_clean(spark, d)).distinct()
    made = ids.select("tile_id", F.encode(F.concat(F.lit("tile "), F.floor(F.col("tile_id") / 3).cast("string")), "UTF-8").alias("payload"))
    path = scratch_path(spark, "archive") + "/a.pmtiles"
    pmtiles.write(made, path, '{"name": "all tiles", "vector_layers": [{"id": "l", "fields": {"k": "String"}}]}', leaf_entries=2000, **how)
    return path


def archive_roundtrip(spark, d):
    """Tiles of all archives' ids, written as one archive with leaf directories and read back through the data source."""
    return pmtiles.read(spark, _archive(spark, d)).select("tile_id", "z", "x", "y", F.decode("payload", "UTF-8").alias("content"))


def archive_level(spark, d):
    """Tiles of one zoom of the archive: leaf directories of other levels stay unread."""
    return pmtiles.read(spark, _archive(spark, d)).where("z = 9").select("tile_id", "x", "y", F.decode("payload", "UTF-8").alias("content"))


def archive_metadata_read(spark, d):
    return pmtiles.metadata_of(spark, _archive(spark, d), "name string, vector_layers array<struct<id:string,fields:map<string,string>>>").select("name", F.col("vector_layers")[0]["id"].alias("layer"), F.col("vector_layers")[0]["fields"]["k"].alias("kind"))


def tile_fetch(spark, d):
    """Contents by z/x/y: of the tiles that features lie in, of each entry's first tile and of the one five ids on; tiles
    that the archive lacks are left out."""
    at = hilbert.tiles_of_ids("tile_id")
    ids = _clean(spark, d).select(F.explode(F.array("tile_id", F.col("tile_id") + 5)).alias("tile_id"))
    wanted = _tiles(spark, d).unionByName(ids.select(at.alias("t")).select("t.z", "t.x", "t.y")).distinct()
    ids = wanted.withColumn("tile_id", hilbert.checked_tile_id(*map(F.col, "zxy")))
    return pmtiles.fetch(ids, _archive(spark, d), mapper=bytes.decode, returns="string").select("z", "x", "y", F.col("payload").alias("content"))


def range_reads(spark, d):
    """Contents of the archive by byte ranges of its file, some of them cut at its end."""
    path = _archive(spark, d, compression=1)
    h = pmtiles.read(spark, path, "header").select("tile_data_offset", "tile_data_bytes")
    places = pmtiles.read(spark, path, "entries").where("run_length > 0").select("tile_offset", "length_bytes").distinct().crossJoin(F.broadcast(h))
    ends = F.col("tile_offset") + F.col("length_bytes") == F.col("tile_data_bytes")
    wanted = places.select(F.lit("a.pmtiles").alias("key"), (F.col("tile_data_offset") + F.col("tile_offset")).alias("range_offset"), F.when(ends, F.col("length_bytes") + 100).otherwise(F.col("length_bytes")).cast("long").alias("range_length"))
    return storage.read_ranges(spark, path.rpartition("/")[0], wanted).select(F.decode("bytes", "UTF-8").alias("content"))


def archive_header(spark, d):
    path = scratch_path(spark, "archive") + "/h.pmtiles"
    made = _tiles(spark, d).select(hilbert.tile_id(*map(F.col, "zxy")).alias("tile_id"), F.encode(F.concat_ws("/", "z", "x", "y"), "UTF-8").alias("payload"))
    pmtiles.write(made, path, min_lon_e7=int(1.412368 * 1e7))
    h = pmtiles.described(pmtiles.read(spark, path, "header"))
    return h.select("addressed_tiles_count", "tile_contents_count", "min_zoom", "max_zoom", "min_lon", "max_lat", "compression", "mime_type", "is_raster")


def metadata_layers(spark, d):
    """Layers of the deliveries with their zooms, and the greatest minimal zoom of each."""
    m = table(spark, d, "archive_metadata").select("archive_id", F.explode("vector_layers").alias("l"))
    rows = m.select("archive_id", "l.id", "l.minzoom", F.size("l.fields").alias("n_fields"))
    return rows.groupBy("archive_id").agg(F.max("minzoom").alias("max_minzoom"), F.count(F.lit(1)).alias("n_layers"), F.sum("n_fields").alias("n_fields"))


def metadata_json(spark, d):
    """Metadata as JSON text and parsed again by its schema, with unknown keys ignored."""
    m = table(spark, d, "archive_metadata")
    text = m.select("archive_id", F.to_json(F.struct(F.col("tileset_name").alias("name"), "description", F.col("meta_version").alias("version"), "vector_layers", F.lit("x").alias("unknown"))).alias("json"))
    kind = "struct<name:string,description:string,version:string,vector_layers:array<struct<id:string,fields:map<string,string>,minzoom:int,maxzoom:int>>>"
    return text.select("archive_id", F.from_json("json", kind).alias("m")).select("archive_id", "m.name", "m.description", "m.version", F.get("m.vector_layers", F.lit(0))["id"].alias("first_layer"))


def feature_attributes(spark, d):
    """Distinct features' attributes by key and value."""
    f = table(spark, d, "tile_features").select("tile_layer_id", "feature_id", "tags").distinct()
    a = layers.attributes(f, table(spark, d, "tile_layers"))
    return a.select("tile_layer_id", F.explode("attributes").alias("key", "value")).groupBy("tile_layer_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def attribute_lookup(spark, d):
    e = table(spark, d, "events")
    props = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.try_element_at(props, F.lit("page")).alias("page"), F.try_element_at(props, F.lit("k")).alias("k"))


def value_kinds(spark, d):
    v = table(spark, d, "tile_layers").select("layer", F.explode("layer_values").alias("v"))
    return v.groupBy("layer", layers.value_kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def layer_features(spark, d):
    """Features, names of layers and extents per level."""
    f = table(spark, d, "tile_features").where(tiles.is_valid(*map(F.col, "zxy")))
    return f.groupBy("z", "layer").agg(F.count_distinct("tile_layer_id", "feature_id").alias("n_features"), F.count_distinct("extent").alias("n_extents"))


def dictionary_index(spark, d):
    """Numbers of the distinct values of each layer's dictionary, by first appearance."""
    v = table(spark, d, "tile_layers").select("tile_layer_id", F.posexplode("layer_values").alias("at", "v"))
    text = v.select("tile_layer_id", "at", layers.value_text(F.col("v")).alias("value")).where("value IS NOT NULL")
    return layers.first_seen_index(text, ["tile_layer_id"], "value", "at")


def auto_ids(spark, d):
    """Running numbers of customers' features in their segment, where an explicit id (every seventh) overrides."""
    c = table(spark, d, "customer").withColumn("given", F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey")))
    return layers.auto_ids(c, ["c_mktsegment"], "c_custkey", "given").select("c_custkey", "feature_no")


def point_decode(spark, d):
    """Points of the features' command streams, by built-in expressions. All kinds of geometry are in geometry_decode."""
    f = table(spark, d, "tile_features").where("geom_type = 'POINT'").select("tile_layer_id", "feature_id", "commands").distinct()
    p = f.select("tile_layer_id", "feature_id", "commands", geometry.points_of(F.col("commands")).alias("p"))
    return p.groupBy("tile_layer_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("p", F.lit(0))["x"]).alias("sum_x"), F.sum(F.get("p", F.lit(0))["y"]).alias("sum_y"), F.count_if(F.col("p").isNull()).alias("n_other"))


def command_pack(spark, d):
    """Command and parameter integers of customers' offsets, packed and unpacked."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3 + 1).cast("int").alias("n"), (F.col("c_custkey") * 37 % 8192 - 4096).cast("int").alias("v"))
    return c.select("c_custkey", geometry.packed(F.lit(1), F.col("n")).alias("command"), geometry.zigzag_column(F.col("v")).alias("param"), geometry.unzigzag_column(geometry.zigzag_column(F.col("v"))).alias("back"))


def _webmercator(spark):
    return matrixsets.default_sets(spark).where("set_id = 'WebMercatorQuad'")


def feature_query(spark, d):
    """Features in two overlapping boxes of meters at zoom 9, of two layers, with a given attribute."""
    q = FeatureQuery().within((-20037508.0, -1e7, 2e6, 1e7), (-5e6, -20037508.0, 20037508.0, 5e6)).at(9).of("roads", "water", "pois").matching(F.size("attributes") >= 2)
    f = plan(q, table(spark, d, "tile_features"), table(spark, d, "tile_layers"), _webmercator(spark))
    return f.select("z", "x", "y", "layer", "tile_layer_id", "feature_id", F.size("attributes").alias("n_attributes")).distinct()


def feature_query_by_resolution(spark, d):
    q = FeatureQuery().near(400.0, "QUALITY").of("roads")
    f = plan(q, table(spark, d, "tile_features"), table(spark, d, "tile_layers"), _webmercator(spark))
    return f.groupBy("z", "layer").agg(F.count_distinct("tile_layer_id", "feature_id").alias("n"))


def glob_match(spark, d):
    """Keys of the listings by several patterns."""
    s = table(spark, d, "storage_snapshots").where("kind = 'File'").select("object_key").distinct()
    patterns = {"any_deep": "tiles/**/*.mvt", "one_level": "styles/*/*.pmtiles", "classes": "*/[a-m]*/[!0-9]*", "braces": "{fonts,styles}/**.{json,webp}", "single": "tiles/????????*/**"}
    return s.select("object_key", *[glob.matches(F.col("object_key"), p).alias(n) for n, p in patterns.items()])


def byte_blocks(spark, d):
    """Aligned blocks that the entries' bytes touch, with the entries per block."""
    e = table(spark, d, "tile_entries").where("run_length > 0 AND length_bytes > 0").select("archive_id", F.col("tile_offset").alias("range_offset"), F.col("length_bytes").alias("range_length")).distinct()
    return storage.blocks_of(e).groupBy("archive_id", "block_no", "block_offset").agg(F.count(F.lit(1)).alias("n_ranges"))


def byte_ranges(spark, d):
    """Ranges of small files' contents, clamped at their ends."""
    f = table(spark, d, "tile_files").where("kind = 'File' AND payload IS NOT NULL")
    part = F.substring("payload", 11, 40)
    return f.select("object_key", F.unix_micros("last_modified").alias("modified_us"), F.octet_length("payload").alias("size"), F.octet_length(part).alias("n"), F.hex(F.substring(part, 1, 4)).alias("head")).distinct()


def delete_outcome(spark, d):
    """A bulk delete of the first snapshot's files against the last listing, where keys under staging fail."""
    s = table(spark, d, "storage_snapshots").where("kind = 'File'")
    ends = s.agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi"))
    s = s.crossJoin(F.broadcast(ends))
    last = s.where("snapshot_no = hi").select("object_key")
    return storage.delete_outcome(s.where("snapshot_no = lo"), last, last.where("object_key LIKE 'staging/%'"))


def store_capabilities(spark, d):
    return storage.capabilities(spark)


def _nation_store(spark, d):
    """A store with a small file for each nation, in a folder of its region."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # 25 of them
    store = storage.Store(spark, scratch_path(spark, "store"))
    for r in rows:
        store.put(f"by region/{r['r_name'].lower()}/{r['n_name']}.txt", f"{r['n_name']} in {r['r_name']}")
    return store, rows


def store_providers(spark, d):
    """Which store an address of each nation belongs to, as it is, with one provider switched off, and by name."""
    forms = ["/data/{0}", "file:///data/{0}", "s3://maps/{0}", "gs://maps/{0}", "abfss://maps@acc.dfs.core.windows.net/{0}", "https://acc.blob.core.windows.net/maps/{0}", "https://tiles.example/{0}"]
    out = []
    for (name, k) in table(spark, d, "nation").select("n_name", "n_nationkey").collect():  # 25 of them
        address = forms[k % len(forms)].format(name)
        plain = providers.choose(address, flags={}, probe=lambda a: {}).id
        marked = providers.choose(address, flags={}, probe=lambda a: {"X-Amz-Id-2": "1"}).id
        off = providers.choose(address, flags={"STORAGE_S3": "false"}, probe=lambda a: {}).id if not address.startswith("s3:") else None
        out.append((name, address, plain, marked, off, providers.choose(address, "http", flags={}).id))
    return spark.createDataFrame(out, "n_name string, address string, provider string, by_header string, without_s3 string, by_name string")


def store_listing(spark, d):
    """Files by pattern: one folder deep, in any folder, by classes of letters, in two folders; only their folders are listed."""
    store, _ = _nation_store(spark, d)
    patterns = {"folder": "by region/asia/*.txt", "deep": "**/[A-J]*.txt", "braces": "by region/{africa,europe}/*", "none": "nowhere/*"}
    out = None
    for name, pattern in patterns.items():
        part = store.list(pattern).select(F.lit(name).alias("pattern"), "key", "size")
        out = part if out is None else out.unionByName(part)
    return out


def store_actions(spark, d):
    """Of each nation's file: its size by stat, a part of it, and what became of it: copied and moved in its folder, written
    only if new, and deleted; deletes of what isn't there are told apart."""
    store, nations = _nation_store(spark, d)
    out = []
    for r in nations:
        key = f"by region/{r['r_name'].lower()}/{r['n_name']}.txt"
        known, part = store.stat(key), store.read(key, 3, 10)
        again = store.put(key, "other", only_new=True)
        store.copy(key, f"copies/{r['n_name']}")
        store.move(f"copies/{r['n_name']}", f"moved/{r['n_name']}")
        gone = store.delete(key, f"copies/{r['n_name']}")
        same = store.read(f"moved/{r['n_name']}", if_match=store.stat(f"moved/{r['n_name']}")["etag"])
        out.append((r["n_name"], known["size"], part.decode(), again, gone[key], gone[f"copies/{r['n_name']}"], same.decode(), store.exists(key)))
    return spark.createDataFrame(out, "n_name string, size long, part string, written_again boolean, outcome string, other_outcome string, content string, still_there boolean")


def address_parts(spark, d):
    """Store addresses of the listed keys in three styles, and whether a key is safe."""
    k = table(spark, d, "storage_snapshots").where("kind = 'File'").select("object_key").distinct()
    key = F.col("object_key")
    urls = {"plain": F.concat(F.lit("s3://maps/"), key), "path": F.concat(F.lit("https://s3.eu-west-1.amazonaws.com/maps/"), key), "host": F.concat(F.lit("https://maps.s3.eu-west-1.amazonaws.com/"), key), "own": F.concat(F.lit("http://localhost:9000/maps/"), key), "other": F.concat(F.lit("ftp://maps/"), key)}
    out = k
    for n, u in urls.items():
        p = names.s3_parts(u)
        out = out.withColumns({f"{n}_bucket": p["bucket"], f"{n}_key": p["key"], f"{n}_region": p["region"]})
    own = names.relative_key("https://maps.example/tiles/", F.concat(F.lit("https://maps.example/tiles/"), key, F.lit("?v=1")))
    out = out.withColumns({"safe": names.is_safe_key(key), "relative": own, "climbing": names.is_safe_key(F.concat(F.lit("../"), key))})
    return out.withColumn("elsewhere", names.relative_key("https://other.example", F.concat(F.lit("https://maps.example/"), key)))


def crs_codes(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    base = "http://www.opengis.net/def/crs"
    of = lambda *parts: grids.crs_code(F.concat(*parts))
    return n.select("n_nationkey", of(F.lit(f" {base}/EPSG/0/"), k, F.lit(" ")).alias("epsg"), of(F.lit(f"{base.replace('http', 'https')}/IAU/2015/"), k).alias("other"), of(F.lit("urn:ogc:def:crs:EPSG::"), k).alias("urn"), of(F.lit(f"{base}/OGC/1.3/CRS84")).alias("plate"), of(F.lit("EPSG:"), k).alias("plain"))


def setting_keys(spark, d):
    """Settings under their present names: a former prefix and a renamed setting, in any combination; case counts."""
    n = table(spark, d, "region")
    now = lambda *parts: names.normal_key(F.concat(*parts), "maps.reader.")
    return n.select("r_name", now(F.lit("maps.reader."), "r_name").alias("moved"), now(F.lit("storage."), "r_name").alias("kept"), now(F.lit("Maps.Reader."), "r_name").alias("other_case"), now(F.lit("maps.reader.gcs.host")).alias("both"), now(F.lit("storage.gcs.host")).alias("renamed"), now(F.lit("storage.gcs_host")).alias("unlike"))


def geometry_kinds(spark, d):
    """Kinds under which geometries of several types are stored."""
    t = table(spark, d, "tile_features").select("geom_type").distinct()
    kind = geometry.plain_kind
    return t.select("geom_type", kind(F.concat(F.lit("Multi"), "geom_type")).alias("multi"), kind(F.col("geom_type")).alias("plain"), kind(F.concat(F.lit("Collection of "), "geom_type")).alias("collection"), kind(F.lit("LinearRing")).alias("ring"))


def layer_lookup(spark, d):
    """The layer of each delivery's metadata that is called water, if it has one."""
    m = table(spark, d, "archive_metadata").select("archive_id", tilejson.layer_of(F.col("vector_layers"), "water").alias("l"))
    return m.select("archive_id", "l.id", "l.minzoom", "l.maxzoom", F.size("l.fields").alias("n_fields"))


def tilejson_problems(spark, d):
    """What is wrong with documents made of the deliveries' metadata: some have no version, no layers' ids, zooms the wrong way."""
    m = table(spark, d, "archive_metadata")
    low, high = F.array_max(F.transform("vector_layers", lambda l: l["minzoom"])), F.array_min(F.transform("vector_layers", lambda l: l["maxzoom"]))
    doc = F.struct(F.when(F.col("meta_version").isNotNull(), "3.0.0").alias("tilejson"), F.array(F.col("tileset_name")).alias("tiles"), "vector_layers", low.alias("minzoom"), high.alias("maxzoom"))
    parsed = tilejson.parse(m.select("archive_id", F.to_json(doc).alias("json")))
    return parsed.select("archive_id", F.array_join(tilejson.problems(F.col("doc")), "; ").alias("problems"))


QUERIES = {f.__name__: f for f in (
    entry_list, directory_totals, expand_runs, tiles_by_zoom, asof_tile_lookup, exact_entry_lookup, directory_codec, directory_decode, archive_roundtrip, archive_level, archive_metadata_read, tile_fetch, range_reads, archive_header, metadata_layers, metadata_json,
    feature_attributes, attribute_lookup, value_kinds, layer_features, dictionary_index, auto_ids, point_decode, command_pack, feature_query,
    feature_query_by_resolution, glob_match, byte_blocks, byte_ranges, delete_outcome, store_capabilities, store_providers, store_listing, store_actions, geometry_kinds, layer_lookup, tilejson_problems, address_parts, crs_codes, setting_keys,
)}

PAIRS = """SELECT tile_layer_id, feature_id, tags, layer_keys[k + 1] AS key,
    coalesce(v.string_value, v.float_value::VARCHAR, v.double_value::VARCHAR, v.int_value::VARCHAR, v.uint_value::VARCHAR, v.sint_value::VARCHAR, v.bool_value::VARCHAR) AS value, i
  FROM (SELECT *, tags[2 * i + 1] AS k, tags[2 * i + 2] AS vi, layer_values[tags[2 * i + 2] + 1] AS v FROM (
    SELECT f.*, l.layer_keys, l.layer_values, unnest(range(len(tags) // 2)) AS i FROM ({features}) f JOIN tile_layers l USING (tile_layer_id)))
  WHERE k >= 0 AND vi >= 0 AND k < len(layer_keys) AND vi < len(layer_values)"""
F_ONCE = "SELECT DISTINCT tile_layer_id, feature_id, tags FROM tile_features"
P0 = "(CASE WHEN commands[{n}] % 2 = 0 THEN commands[{n}] // 2 ELSE -((commands[{n}] + 1) // 2) END)"
DELTA = "CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END"
VALID_ROWS = "z BETWEEN 0 AND 62 AND x >= 0 AND y >= 0 AND x < (1::BIGINT << z) AND y < (1::BIGINT << z)"
TOP = "CASE WHEN regexp_replace(lower(origin), '[^a-z]', '', 'g') = 'bottomleft' THEN (1::BIGINT << z) - 1 - y ELSE y END"
EXPANDED = "SELECT archive_id, unnest(range(tile_id, tile_id + run_length)) AS tile_id FROM (SELECT DISTINCT * FROM tile_entries WHERE run_length > 0)"
ALL_TILES = f"(SELECT unnest(range(tile_id, tile_id + run_length)) AS tile_id FROM ({CLEAN}))"
KEYS = "SELECT DISTINCT object_key FROM storage_snapshots WHERE kind = 'File'"

ORACLE = {
    "entry_list": "SELECT archive_id, dir_level, count(*) FILTER (run_length = 0) AS n_leaves, count(*) FILTER (run_length > 0) AS n_tiles FROM (SELECT DISTINCT * FROM tile_entries) GROUP BY 1, 2",
    "directory_totals": """SELECT archive_id, count(*) AS n_entries, count(*) FILTER (run_length = 0) AS n_leaves, sum(run_length)::BIGINT AS n_addressed,
  count(DISTINCT CASE WHEN run_length > 0 THEN (tile_offset, length_bytes) END) AS n_contents FROM (SELECT DISTINCT * FROM tile_entries) GROUP BY 1""",
    "expand_runs": f"SELECT archive_id, tile_id, count(*) AS n FROM ({EXPANDED}) GROUP BY 1, 2",
    "tiles_by_zoom": UNHILBERT.format(source=f"({EXPANDED}) WHERE tile_id BETWEEN 87381 AND 349524") + f"SELECT DISTINCT archive_id, z, x, y FROM h JOIN ({EXPANDED}) USING (tile_id) WHERE i = z AND z = 9",
    "asof_tile_lookup": f"""
WITH e AS ({CLEAN}), k AS (SELECT archive_id, tile_id FROM e UNION SELECT archive_id, tile_id + 7 FROM e),
m AS (SELECT k.archive_id, k.tile_id, e.tile_id AS eid, e.tile_offset, e.run_length FROM k ASOF LEFT JOIN e ON k.archive_id = e.archive_id AND k.tile_id >= e.tile_id)
SELECT archive_id, tile_id, CASE WHEN tile_id < eid + run_length THEN eid END AS entry_id, CASE WHEN tile_id < eid + run_length THEN tile_offset END AS tile_offset,
       CASE WHEN tile_id < eid + run_length THEN run_length END AS run_length FROM m""",
    "exact_entry_lookup": f"WITH e AS ({CLEAN}) SELECT e.* FROM e JOIN (SELECT DISTINCT archive_id, tile_id + 1 AS tile_id FROM e) k USING (archive_id, tile_id)",
    "directory_codec": f"""
WITH e AS ({CLEAN})
SELECT archive_id, (row_number() OVER w - 1)::INT AS i, tile_id - coalesce(lag(tile_id) OVER w, 0) AS delta, run_length, length_bytes,
       CASE WHEN tile_offset = lag(tile_offset + length_bytes) OVER w THEN 0 ELSE tile_offset + 1 END AS stored FROM e WINDOW w AS (PARTITION BY archive_id ORDER BY tile_id)""",
    "directory_decode": f"SELECT archive_id, tile_id, tile_offset, length_bytes, run_length FROM ({CLEAN})",
    "archive_roundtrip": UNHILBERT.format(source=ALL_TILES) + "SELECT tile_id, z, x, y, 'tile ' || (tile_id // 3) AS content FROM h WHERE i = z",
    "archive_level": UNHILBERT.format(source=f"{ALL_TILES} WHERE tile_id BETWEEN 87381 AND 349524") + "SELECT tile_id, x, y, 'tile ' || (tile_id // 3) AS content FROM h WHERE i = z AND z = 9",
    "archive_metadata_read": "SELECT 'all tiles' AS name, 'l' AS layer, 'String' AS kind",
    "tile_fetch": UNHILBERT.format(source=ALL_TILES) + f""", t AS ({TILES}), i AS (SELECT tile_id FROM ({CLEAN}) UNION SELECT tile_id + 5 FROM ({CLEAN}))
SELECT z, x, y, 'tile ' || (tile_id // 3) AS content FROM h WHERE i = z AND (tile_id IN (SELECT tile_id FROM i) OR (z, x, y) IN (SELECT z, x, y FROM t))""",
    "range_reads": f"SELECT DISTINCT 'tile ' || (tile_id // 3) AS content FROM {ALL_TILES}",
    "archive_header": f"""SELECT count(*) AS addressed_tiles_count, count(*) AS tile_contents_count, min(z) AS min_zoom, max(z) AS max_zoom, 1.412368::DOUBLE AS min_lon, 85.0::DOUBLE AS max_lat,
  'gzip' AS compression, 'application/vnd.mapbox-vector-tile' AS mime_type, false AS is_raster FROM ({TILES})""",
    "metadata_layers": """SELECT archive_id, max(l.minzoom) AS max_minzoom, count(*) AS n_layers, sum(cardinality(l.fields))::BIGINT AS n_fields
  FROM (SELECT archive_id, unnest(vector_layers) AS l FROM archive_metadata) GROUP BY 1""",
    "metadata_json": "SELECT archive_id, tileset_name AS name, description, meta_version AS version, vector_layers[1].id AS first_layer FROM archive_metadata",
    "feature_attributes": f"""
WITH p AS ({PAIRS.format(features=F_ONCE)}), o AS (SELECT *, row_number() OVER (PARTITION BY tile_layer_id, feature_id, tags, key ORDER BY i DESC) AS rn FROM p WHERE value IS NOT NULL)
SELECT tile_layer_id, key, count(*) AS n, min(value) AS low, max(value) AS high FROM o WHERE rn = 1 GROUP BY 1, 2""",
    "attribute_lookup": "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events",
    "value_kinds": """SELECT layer, CASE WHEN v.string_value IS NOT NULL THEN 'string' WHEN v.float_value IS NOT NULL THEN 'float' WHEN v.double_value IS NOT NULL THEN 'double' WHEN v.int_value IS NOT NULL THEN 'int'
  WHEN v.uint_value IS NOT NULL THEN 'uint' WHEN v.sint_value IS NOT NULL THEN 'sint' WHEN v.bool_value IS NOT NULL THEN 'bool' END AS kind, count(*) AS n FROM (SELECT layer, unnest(layer_values) AS v FROM tile_layers) GROUP BY 1, 2""",
    "layer_features": f"SELECT z, layer, count(DISTINCT (tile_layer_id, feature_id)) AS n_features, count(DISTINCT extent) AS n_extents FROM tile_features WHERE {VALID_ROWS} GROUP BY 1, 2",
    "dictionary_index": """
WITH t AS (SELECT tile_layer_id, pos, coalesce(v.string_value, v.float_value::VARCHAR, v.double_value::VARCHAR, v.int_value::VARCHAR, v.uint_value::VARCHAR, v.sint_value::VARCHAR, v.bool_value::VARCHAR) AS value
  FROM (SELECT tile_layer_id, unnest(layer_values) AS v, unnest(range(len(layer_values))) AS pos FROM tile_layers)),
f AS (SELECT tile_layer_id, value, min(pos) AS first FROM t WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT tile_layer_id, value, (row_number() OVER (PARTITION BY tile_layer_id ORDER BY first, value) - 1)::INT AS index FROM f""",
    "auto_ids": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_custkey ELSE row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 END AS feature_no FROM customer",
    "point_decode": f"""
WITH f AS (SELECT DISTINCT tile_layer_id, feature_id, commands FROM tile_features WHERE geom_type = 'POINT'),
g AS (SELECT *, commands[1] & 7 = 1 AND commands[1] >> 3 > 0 AND len(commands) = (commands[1] >> 3) * 2 + 1 AS ok FROM f)
SELECT tile_layer_id, count(*) AS n, sum(CASE WHEN ok THEN {P0.format(n=2)} END)::BIGINT AS sum_x, sum(CASE WHEN ok THEN {P0.format(n=3)} END)::BIGINT AS sum_y, count(*) FILTER (NOT coalesce(ok, false)) AS n_other FROM g GROUP BY 1""",
    "command_pack": f"SELECT c_custkey, ((n * 8) + 1)::INT AS command, ({DELTA})::INT AS param, v AS back FROM (SELECT c_custkey, (c_custkey % 3 + 1)::INT AS n, (c_custkey * 37 % 8192 - 4096)::INT AS v FROM customer)",
    "feature_query": f"""
WITH l AS (SELECT 2 * {HW} / 512 AS s), b AS (SELECT * FROM (VALUES (-20037508.0::DOUBLE, -1e7::DOUBLE, 2e6::DOUBLE, 1e7::DOUBLE), (-5e6, -20037508.0, 20037508.0, 5e6)) t(a, b, c, d)),
r AS (SELECT greatest(floor((a + {HW}) / s + 1e-6)::BIGINT, 0) AS x0, least(floor((c + {HW}) / s - 1e-6)::BIGINT, 511) AS x1, greatest(floor(({HW} - d) / s + 1e-6)::BIGINT, 0) AS y0, least(floor(({HW} - b) / s - 1e-6)::BIGINT, 511) AS y1 FROM b, l),
f AS (SELECT DISTINCT z, x, {TOP} AS y, layer, tile_layer_id, feature_id, tags FROM tile_features WHERE z = 9 AND {VALID_ROWS} AND layer IN ('roads', 'water', 'pois')),
p AS ({PAIRS.format(features='SELECT DISTINCT tile_layer_id, feature_id, tags FROM f')}),
a AS (SELECT tile_layer_id, feature_id, tags, count(DISTINCT key) AS n_attributes FROM p WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT DISTINCT z, x, y, layer, f.tile_layer_id, f.feature_id, n_attributes::INT AS n_attributes FROM f JOIN a USING (tile_layer_id, feature_id, tags)
WHERE n_attributes >= 2 AND EXISTS (SELECT 1 FROM r WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""",
    "feature_query_by_resolution": f"SELECT z, layer, count(DISTINCT (tile_layer_id, feature_id)) AS n FROM tile_features WHERE z = 9 AND layer = 'roads' AND {VALID_ROWS} GROUP BY 1, 2",
    "glob_match": f"""SELECT object_key, regexp_full_match(object_key, 'tiles/(.*/)?[^/]*\\.mvt') AS any_deep, regexp_full_match(object_key, 'styles/[^/]*/[^/]*\\.pmtiles') AS one_level,
  regexp_full_match(object_key, '[^/]*/[a-m][^/]*/[^/0-9][^/]*') AS classes, regexp_full_match(object_key, '(fonts|styles)/.*\\.(json|webp)') AS braces, regexp_full_match(object_key, 'tiles/[^/]{{8}}[^/]*/.*') AS single FROM ({KEYS})""",
    "byte_blocks": """
WITH e AS (SELECT DISTINCT archive_id, tile_offset AS o, length_bytes AS n FROM tile_entries WHERE run_length > 0 AND length_bytes > 0)
SELECT archive_id, b AS block_no, b * 65536 AS block_offset, count(*) AS n_ranges FROM (SELECT *, unnest(range(o // 65536, (o + n - 1) // 65536 + 1)) AS b FROM e) GROUP BY 1, 2, 3""",
    "byte_ranges": """SELECT DISTINCT object_key, epoch_us(last_modified) AS modified_us, octet_length(payload)::INT AS size, greatest(least(octet_length(payload) - 10, 40), 0)::INT AS n, substr(hex(payload), 21, 8) AS head
  FROM tile_files WHERE kind = 'File' AND payload IS NOT NULL""",
    "delete_outcome": """
WITH f AS (SELECT * FROM storage_snapshots WHERE kind = 'File'), w AS (SELECT DISTINCT object_key FROM f WHERE snapshot_no = (SELECT min(snapshot_no) FROM f)), l AS (SELECT DISTINCT object_key FROM f WHERE snapshot_no = (SELECT max(snapshot_no) FROM f))
SELECT object_key, CASE WHEN object_key NOT IN (SELECT object_key FROM l) THEN 'did_not_exist' WHEN object_key LIKE 'staging/%' THEN 'failed' ELSE 'deleted' END AS outcome FROM w""",
    "store_capabilities": """SELECT * FROM (VALUES
  ('file', true, true, true, false, true, true, true, true, false, 0::BIGINT, true, true, 2147483647, true, true, true, false, NULL::BIGINT, false, true),
  ('http', true, true, true, false, false, false, false, false, false, 0, false, false, 1, false, false, false, false, NULL, false, true),
  ('s3', true, true, true, true, true, true, false, true, true, 8388608, true, true, 1000, false, true, false, true, 604800, true, true),
  ('s3-directory', true, true, true, true, true, true, false, true, true, 8388608, true, true, 1000, false, true, false, true, 300, false, true),
  ('gcs', true, true, true, true, true, true, false, true, true, 8388608, true, true, 100, true, true, false, true, 604800, true, true),
  ('gcs-hierarchical', true, true, true, true, true, true, true, true, true, 8388608, true, true, 100, true, true, true, true, 604800, true, true),
  ('azure', true, true, true, true, true, true, false, true, true, 8388608, true, true, 256, true, true, false, true, 604800, true, true),
  ('azure-datalake', true, true, true, true, true, true, true, true, true, 8388608, true, true, 2147483647, true, true, true, false, NULL, false, true))
  t(store, range_reads, streaming_reads, stat, user_metadata, list, hierarchical_list, real_directories, writes, multipart_upload, multipart_threshold_bytes, conditional_write, bulk_delete, bulk_delete_batch_limit, delete_reports_existence,
    server_side_copy, atomic_move, presigned_urls, max_presign_seconds, versioning, strong_read_after_write)""",
    "store_providers": """
WITH f AS (SELECT n_name, n_nationkey % 7 AS k FROM nation)
SELECT n_name, CASE k WHEN 0 THEN '/data/' WHEN 1 THEN 'file:///data/' WHEN 2 THEN 's3://maps/' WHEN 3 THEN 'gs://maps/' WHEN 4 THEN 'abfss://maps@acc.dfs.core.windows.net/' WHEN 5 THEN 'https://acc.blob.core.windows.net/maps/' ELSE 'https://tiles.example/' END || n_name AS address,
       CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'file' WHEN 2 THEN 's3' WHEN 3 THEN 'gcs' WHEN 4 THEN 'azure-datalake' WHEN 5 THEN 'http' ELSE 'http' END AS provider,
       CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'file' WHEN 2 THEN 's3' WHEN 3 THEN 'gcs' WHEN 4 THEN 'azure-datalake' ELSE 's3' END AS by_header,
       CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'file' WHEN 2 THEN NULL WHEN 3 THEN 'gcs' WHEN 4 THEN 'azure-datalake' ELSE 'http' END AS without_s3, 'http' AS by_name FROM f""",
    "store_listing": """
WITH f AS (SELECT 'by region/' || lower(r_name) || '/' || n_name || '.txt' AS key, octet_length(encode(n_name || ' in ' || r_name)) AS size, lower(r_name) AS r, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'folder' AS pattern, key, size FROM f WHERE r = 'asia' UNION ALL SELECT 'deep', key, size FROM f WHERE n_name[1] BETWEEN 'A' AND 'J' UNION ALL SELECT 'braces', key, size FROM f WHERE r IN ('africa', 'europe')""",
    "store_actions": """SELECT n_name, octet_length(encode(n_name || ' in ' || r_name)) AS size, substr(n_name || ' in ' || r_name, 4, 10) AS part, false AS written_again, 'deleted' AS outcome, 'did_not_exist' AS other_outcome, n_name || ' in ' || r_name AS content, false AS still_there FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "geometry_kinds": """SELECT DISTINCT geom_type, geom_type AS multi, geom_type AS plain, CASE WHEN geom_type IS NOT NULL THEN 'UNKNOWN' END AS collection, 'LINESTRING' AS ring FROM tile_features""",
    "layer_lookup": """SELECT archive_id, l.id AS id, l.minzoom AS minzoom, l.maxzoom AS maxzoom, CASE WHEN l.fields IS NOT NULL THEN cardinality(l.fields) END::INT AS n_fields
  FROM (SELECT archive_id, [x for x in vector_layers if x.id = 'water'][1] AS l FROM archive_metadata)""",
    "tilejson_problems": """SELECT archive_id, concat_ws('; ', CASE WHEN meta_version IS NULL THEN 'tilejson is missing' END, CASE WHEN len([1 for x in vector_layers if x IS NOT NULL AND x.id IS NULL]) > 0 THEN 'a layer has no id' END,
    CASE WHEN NOT lo BETWEEN 0 AND 30 OR NOT hi BETWEEN 0 AND 30 THEN 'zooms go from 0 to 30' END, CASE WHEN lo > hi THEN 'minzoom is above maxzoom' END) AS problems
  FROM (SELECT *, coalesce(list_max([x.minzoom for x in vector_layers]), 0) AS lo, coalesce(list_min([x.maxzoom for x in vector_layers]), 30) AS hi FROM archive_metadata)""",
    "address_parts": f"""SELECT object_key, 'maps' AS plain_bucket, object_key AS plain_key, NULL::VARCHAR AS plain_region, 'maps' AS path_bucket, object_key AS path_key, 'eu-west-1' AS path_region, 'maps' AS host_bucket, object_key AS host_key,
  'eu-west-1' AS host_region, 'maps' AS own_bucket, object_key AS own_key, NULL::VARCHAR AS own_region, NULL::VARCHAR AS other_bucket, NULL::VARCHAR AS other_key, NULL::VARCHAR AS other_region, true AS safe, object_key AS relative, false AS climbing, NULL::VARCHAR AS elsewhere FROM ({KEYS})""",
    "crs_codes": "SELECT n_nationkey, 'EPSG:' || n_nationkey AS epsg, 'IAU:' || n_nationkey AS other, 'urn:ogc:def:crs:EPSG::' || n_nationkey AS urn, 'CRS:84' AS plate, 'EPSG:' || n_nationkey AS plain FROM nation",
    "setting_keys": """SELECT r_name, 'storage.' || r_name AS moved, 'storage.' || r_name AS kept, 'Maps.Reader.' || r_name AS other_case, 'storage.gcs.endpoint' AS both, 'storage.gcs.endpoint' AS renamed, 'storage.gcs_host' AS unlike FROM region""",
}
