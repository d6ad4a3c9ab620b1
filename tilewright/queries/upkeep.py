"""Queries on keeping large tile stores: the general problems, p1, p2, p4, p5 and p7."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import compaction, drift, heavy_tiles, ledger, snapshots
from tilewright.session import scratch_path, table


def p1_found(spark, d):
    return heavy_tiles.heavy_tiles(table(spark, d, "tile_features"))


def p1_features_per_tile(spark, d):
    return heavy_tiles.features_per_tile(table(spark, d, "tile_features"))


def p2_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "storage_snapshots"))


def _lease_history(spark, d):
    return ledger.lease_history(ledger.object_versions(table(spark, d, "storage_deliveries")), "delivered_at", table(spark, d, "pipeline_runs"))


def p4_found(spark, d):
    history = _lease_history(spark, d)
    return history.where(F.col("state") == "done").select(F.col("done_run").alias("run_id"), "delivery_id")


def p4_ledger(spark, d):
    return _lease_history(spark, d).groupBy("state", "first_run", "done_run", "n_leases", "n_refused").agg(F.count(F.lit(1)).alias("n_versions"))


def p4_paths(spark, d):
    """Where results go: by run, the versions it wrote, and the paths, which no two versions share and no retry adds to."""
    done = _lease_history(spark, d).where(F.col("state") == "done")
    paths = done.select("done_run", ledger.item_path("", "object_key", "version_key").alias("path"), F.col("n_leases"))
    each = paths.groupBy("path").agg(F.min("done_run").alias("run_id"), F.count(F.lit(1)).alias("n"), F.max("n_leases").alias("n_leases"))
    return each.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_paths"), F.sum("n").alias("n_versions"), F.sum("n_leases").alias("n_leases"))


def p4_live(spark, d):
    """All versions through the ledger kept in a folder: a first run leases what was delivered before the first run that
    failed, and stalls; a second one takes over once its lease has run out, with all that came since; the first comes
    back and commits in vain; the states are compacted, and the second commits."""
    items = ledger.object_versions(table(spark, d, "storage_deliveries")).select("object_key", "version_key", "delivered_at")
    bad = table(spark, d, "pipeline_runs").where("run_status <> 'succeeded'").agg(F.min("started_at").alias("bad"))  # one row
    led = ledger.Ledger(spark, scratch_path(spark, "ledger"), ["object_key", "version_key"])
    led.add(items.crossJoin(F.broadcast(bad)).where("delivered_at < bad"), "early")
    first = led.lease("first", now=0, seconds=60)
    led.add(items, "all")
    second = led.lease("second", now=100, seconds=60)
    led.commit("first", first, now=110)
    led.compact()
    led.commit("second", second, now=120)
    return led.state(1000).groupBy("state", "run", "n_refused").agg(F.count(F.lit(1)).alias("n_versions"))


def p5_found(spark, d):
    return compaction.found(spark, table(spark, d, "tile_files"))


def p7_found(spark, d):
    changes = drift.build_changes(table(spark, d, "archive_metadata"))
    return changes.select("tileset", "build_no", "layer_id", "field_name", "change_kind").distinct()


def p7_consistent_layers(spark, d):
    return drift.consistent_layers(table(spark, d, "archive_metadata"))


def p7_renames(spark, d):
    return drift.likely_renames(table(spark, d, "archive_metadata"))


def _layer_versions(spark, d):
    """Three deliveries of the layers' table, each written with another schema: first without the level; then with the
    layer under a name that only its values tell, the extent as text and no version; then with another name and the level."""
    t = table(spark, d, "tile_layers")
    root = scratch_path(spark, "drift")
    once = ["tile_layer_id", "archive_id"]
    t.select(*once, "layer", "extent", "mvt_version").write.parquet(f"{root}/1")
    t.select(*once, F.col("layer").alias("theme"), F.col("extent").cast("string").alias("extent")).write.parquet(f"{root}/2")
    t.select(*once, F.col("layer").alias("LayerTheme"), F.col("extent").cast("string").alias("extent"), "z").write.parquet(f"{root}/3")
    return drift.unify(drift.schema_versions(spark, root))


def p7_unified(spark, d):
    return _layer_versions(spark, d)[0]


def p7_unified_report(spark, d):
    return spark.createDataFrame(_layer_versions(spark, d)[1], "schema_version string, column string, change_kind string, other string")


VALID = """
  SELECT DISTINCT z, x, CASE WHEN regexp_replace(lower(origin), '[^a-z]', '', 'g') = 'bottomleft' THEN (1::BIGINT << z) - 1 - y ELSE y END AS y,
         tile_layer_id, feature_id
  FROM tile_features WHERE z BETWEEN 0 AND 62 AND x >= 0 AND y >= 0 AND x < (1::BIGINT << z) AND y < (1::BIGINT << z)
    AND tile_layer_id IS NOT NULL AND feature_id IS NOT NULL"""

BUILDS = """
  SELECT tileset, build_no, vector_layers FROM (
    SELECT *, row_number() OVER (PARTITION BY tileset, build_no ORDER BY received_at DESC, archive_id DESC) AS rn FROM archive_metadata)
  WHERE rn = 1 AND vector_layers IS NOT NULL"""

FIELDS = """
  SELECT tileset, build_no, l.id AS layer_id, regexp_replace(lower(l.id), '[^\\p{L}\\p{N}]', '', 'g') AS lk, u.k AS field_name,
         regexp_replace(lower(u.k), '[^\\p{L}\\p{N}]', '', 'g') AS fk,
         CASE WHEN lower(trim(u.v)) IN ('string', 'text', 'str') THEN 'string'
              WHEN lower(trim(u.v)) IN ('number', 'double', 'int', 'integer', 'float') THEN 'number'
              WHEN lower(trim(u.v)) IN ('boolean', 'bool') THEN 'boolean' ELSE coalesce(lower(trim(u.v)), '') END AS kind
  FROM (SELECT tileset, build_no, unnest(vector_layers) AS l FROM builds),
       LATERAL (SELECT unnest(map_keys(l.fields)) AS k, unnest(map_values(l.fields)) AS v) AS u"""

VERSIONS = """
  SELECT object_key, vk, arg_min(delivery_id, (delivered_at, delivery_id)) AS delivery_id, min(delivered_at) AS delivered_at FROM (
    SELECT *, CASE WHEN trim(coalesce(version_id, '')) = '' OR lower(trim(version_id)) = 'null'
                   THEN 't:' || coalesce(date_trunc('second', last_modified)::VARCHAR, '-') ELSE 'v:' || trim(version_id) END AS vk
    FROM storage_deliveries WHERE kind = 'File' AND object_key IS NOT NULL)
  GROUP BY 1, 2"""

REPLAY = """
log AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) AS token FROM pipeline_runs),
a AS (SELECT v.delivery_id, (SELECT min(token) FROM log WHERE log.started_at >= v.delivered_at) AS first_token,
             (SELECT min(token) FROM log WHERE log.started_at >= v.delivered_at AND run_status = 'succeeded') AS done_token FROM v)"""

LIVE = """
  SELECT * FROM (
    SELECT dataset, object_key, coalesce(size_bytes, octet_length(payload)) AS size,
           row_number() OVER (PARTITION BY dataset, object_key ORDER BY last_modified DESC NULLS LAST, coalesce(size_bytes, octet_length(payload)) DESC) AS rn
    FROM tile_files WHERE kind = 'File' AND object_key IS NOT NULL AND dataset IS NOT NULL)
  WHERE rn = 1 AND size > 0 AND size < 65536 AND NOT contains(substr(object_key, length(dataset) + 1), '/_')
    AND NOT contains(substr(object_key, length(dataset) + 1), '/.')"""

QUERIES = {f.__name__: f for f in (p1_found, p1_features_per_tile, p2_found, p4_found, p4_ledger, p4_paths, p4_live, p5_found, p7_found, p7_consistent_layers, p7_renames, p7_unified, p7_unified_report)}

ORACLE = {
    "p1_found": f"""
WITH v AS ({VALID}), t AS (SELECT z, x, y, count(*) AS n FROM v GROUP BY 1, 2, 3)
SELECT z, x, y FROM t WHERE n * 50 > (SELECT count(*) FROM (SELECT DISTINCT tile_layer_id, feature_id FROM v))""",
    "p1_features_per_tile": f"WITH v AS ({VALID}) SELECT z, x, y, count(*) AS n_features FROM v GROUP BY 1, 2, 3",
    "p2_found": """
WITH nums AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM storage_snapshots)),
s AS (SELECT * FROM (
  SELECT snapshot_no, object_key, size_bytes, date_trunc('second', last_modified) AS sec,
         nullif(lower(replace(regexp_replace(trim(etag), '^[Ww]/', ''), '"', '')), '') AS tag,
         row_number() OVER (PARTITION BY snapshot_no, object_key ORDER BY last_modified DESC NULLS LAST, listed_at DESC NULLS LAST) AS rn
  FROM storage_snapshots WHERE kind = 'File') WHERE rn = 1),
n AS (SELECT s.*, nums.prev FROM s JOIN nums USING (snapshot_no) WHERE nums.prev IS NOT NULL),
o AS (SELECT s.*, nums.snapshot_no AS cmp FROM s JOIN nums ON s.snapshot_no = nums.prev)
SELECT coalesce(n.snapshot_no, o.cmp) AS snapshot_no, coalesce(n.object_key, o.object_key) AS object_key,
       CASE WHEN o.object_key IS NULL THEN 'added' WHEN n.object_key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN o ON n.snapshot_no = o.cmp AND n.object_key = o.object_key
WHERE o.object_key IS NULL OR n.object_key IS NULL
   OR CASE WHEN n.tag IS NOT NULL AND o.tag IS NOT NULL THEN n.tag <> o.tag
           ELSE n.size_bytes IS DISTINCT FROM o.size_bytes OR n.sec IS DISTINCT FROM o.sec END""",
    "p4_found": f"""
WITH v AS ({VERSIONS}), r AS (SELECT run_id, started_at FROM pipeline_runs WHERE run_status = 'succeeded')
SELECT run_id, delivery_id FROM v ASOF JOIN r ON v.delivered_at <= r.started_at""",
    "p4_ledger": f"""
WITH v AS ({VERSIONS}), {REPLAY}
SELECT CASE WHEN done_token IS NULL THEN 'pending' ELSE 'done' END AS state, f.run_id AS first_run, g.run_id AS done_run,
       CASE WHEN first_token IS NULL THEN 0 ELSE coalesce(done_token, (SELECT count(*) FROM log)) - first_token + 1 END::INT AS n_leases,
       CASE WHEN first_token IS NULL THEN 0 ELSE coalesce(done_token, (SELECT count(*) + 1 FROM log)) - first_token END::INT AS n_refused, count(*) AS n_versions
FROM a LEFT JOIN log f ON f.token = first_token LEFT JOIN log g ON g.token = done_token GROUP BY 1, 2, 3, 4, 5""",
    "p4_paths": f"""
WITH v AS ({VERSIONS}), {REPLAY}
SELECT run_id, count(*) AS n_paths, count(*) AS n_versions, sum(done_token - first_token + 1)::BIGINT AS n_leases FROM a JOIN log ON token = done_token GROUP BY 1""",
    "p4_live": f"""
WITH v AS ({VERSIONS}), bad AS (SELECT min(started_at) AS t0 FROM pipeline_runs WHERE run_status <> 'succeeded')
SELECT 'done' AS state, 'second' AS run, (coalesce(delivered_at < t0, false))::INT AS n_refused, count(*) AS n_versions FROM v, bad GROUP BY 3""",
    "p5_found": f"""
WITH live AS ({LIVE})
SELECT dataset, object_key FROM live WHERE dataset IN (SELECT dataset FROM live GROUP BY 1 HAVING count(*) >= 10)""",
    "p7_found": f"""
WITH builds AS ({BUILDS}), f AS ({FIELDS}),
pairs AS (SELECT tileset, build_no, lag(build_no) OVER (PARTITION BY tileset ORDER BY build_no) AS prev FROM builds),
lay AS (SELECT DISTINCT tileset, build_no, l.id AS layer_id, regexp_replace(lower(l.id), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS lk
        FROM (SELECT tileset, build_no, unnest(vector_layers) AS l FROM builds)),
nl AS (SELECT lay.*, p.prev FROM lay JOIN pairs p USING (tileset, build_no) WHERE p.prev IS NOT NULL),
ol AS (SELECT lay.tileset, p.build_no, lay.layer_id, lay.lk FROM lay JOIN pairs p ON lay.tileset = p.tileset AND lay.build_no = p.prev),
bth AS (SELECT n.tileset, n.build_no, n.lk, n.layer_id, o.layer_id AS old_id, n.prev FROM nl n JOIN ol o USING (tileset, build_no, lk)),
nf AS (SELECT b.tileset, b.build_no, b.layer_id, f.lk, f.fk, f.field_name, f.kind FROM bth b JOIN f ON f.tileset = b.tileset AND f.build_no = b.build_no AND f.lk = b.lk),
fo AS (SELECT b.tileset, b.build_no, b.layer_id, f.lk, f.fk, f.field_name, f.kind FROM bth b JOIN f ON f.tileset = b.tileset AND f.build_no = b.prev AND f.lk = b.lk),
ff AS (SELECT coalesce(n.tileset, o.tileset) AS tileset, coalesce(n.build_no, o.build_no) AS build_no, coalesce(n.layer_id, o.layer_id) AS layer_id,
              n.field_name AS nn, o.field_name AS old, n.kind AS nk, o.kind AS ok
       FROM nf n FULL JOIN fo o ON n.tileset = o.tileset AND n.build_no = o.build_no AND n.lk = o.lk AND n.fk = o.fk)
SELECT tileset, build_no, layer_id, '' AS field_name, 'layer_added' AS change_kind FROM nl WHERE NOT EXISTS (SELECT 1 FROM ol WHERE (ol.tileset, ol.build_no, ol.lk) = (nl.tileset, nl.build_no, nl.lk))
UNION SELECT tileset, build_no, layer_id, '', 'layer_removed' FROM ol WHERE NOT EXISTS (SELECT 1 FROM nl WHERE (ol.tileset, ol.build_no, ol.lk) = (nl.tileset, nl.build_no, nl.lk))
UNION SELECT tileset, build_no, layer_id, '', 'layer_renamed' FROM bth WHERE layer_id <> old_id
UNION SELECT tileset, build_no, layer_id, coalesce(nn, old), CASE WHEN old IS NULL THEN 'added' ELSE 'removed' END FROM ff WHERE nn IS NULL OR old IS NULL
UNION SELECT tileset, build_no, layer_id, nn, 'renamed' FROM ff WHERE nn <> old
UNION SELECT tileset, build_no, layer_id, nn, 'retyped' FROM ff WHERE nk <> ok""",
    "p7_unified": """
SELECT 'v1' AS schema_version, tile_layer_id, archive_id, layer AS LayerTheme, extent::VARCHAR AS extent, mvt_version, NULL::INT AS z FROM tile_layers
UNION ALL SELECT 'v2', tile_layer_id, archive_id, layer, extent::VARCHAR, NULL, NULL FROM tile_layers
UNION ALL SELECT 'v3', tile_layer_id, archive_id, layer, extent::VARCHAR, NULL, z FROM tile_layers""",
    "p7_unified_report": """SELECT * FROM (VALUES ('v2', 'mvt_version', 'removed', ''), ('v2', 'theme', 'renamed', 'layer'), ('v2', 'extent', 'retyped', 'int'),
  ('v3', 'LayerTheme', 'renamed', 'theme'), ('v3', 'z', 'added', '')) r(schema_version, "column", change_kind, other)""",
    "p7_consistent_layers": f"""
WITH builds AS ({BUILDS}), f AS ({FIELDS})
SELECT tileset, lk AS layer_key, fk AS field_key, arg_max(layer_id, (build_no, layer_id, field_name)) AS layer_id, arg_max(field_name, (build_no, layer_id, field_name)) AS field_name,
       CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'string' END AS field_type, min(build_no) AS first_build, max(build_no) AS last_build,
       count(DISTINCT build_no) AS n_builds
FROM f GROUP BY 1, 2, 3""",
}
