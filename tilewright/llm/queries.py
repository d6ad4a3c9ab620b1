"""Queries of the problems on language-model data, with SQL where it can give the same rows on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.llm import leaks, mixture, redact, runs, terms
from tilewright.queries.upkeep import BUILDS
from tilewright.session import table


def _statistics(spark, d):
    return terms.term_statistics(table(spark, d, "tile_features"), table(spark, d, "tile_layers"), table(spark, d, "archive_metadata"))


def p3_found(spark, d):
    return terms.marked(_statistics(spark, d))


def p3_statistics(spark, d):
    return _statistics(spark, d)


def p6_found(spark, d):
    return runs.tile_runs(table(spark, d, "tile_entries")).select("archive_id", "first_tile_id", "last_tile_id").distinct()


def p6_tile_runs(spark, d):
    return runs.tile_runs(table(spark, d, "tile_entries"))


def p6_event_runs(spark, d):
    return runs.collapse(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], "ts")


def p8_found(spark, d):
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where(F.col("longest_words") >= 12).select("doc_id", "item_id").distinct()


def p8_leaks(spark, d):
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mixture(spark, d):
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_checks(spark, d):
    """Of each target: whether its share of all tokens is reached to within one document, no document is in the mixture
    twice, and none is repeated beyond the cap. Targets without documents must have no tokens."""
    mixed, shares = mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    own = mixed.groupBy("source").agg((F.count_distinct("doc_id") == F.count(F.lit(1))).alias("once"))
    few = shares.join(own, "source", "left")
    totals = few.agg(F.sum("mixed_tokens").alias("total"), F.sum(F.when(F.col("supply_tokens") > 0, F.col("target_share"))).alias("whole"))
    missed = F.abs(F.col("mixed_tokens") - F.col("target_share") / F.col("whole") * F.col("total"))
    fits = F.when(F.col("supply_tokens") > 0, missed <= F.col("longest_tokens") + 1).otherwise(F.col("mixed_tokens") == 0)
    return few.crossJoin(F.broadcast(totals)).select("source", fits.alias("share_ok"), F.coalesce("once", F.lit(True)).alias("once_ok"), (F.col("max_copies") <= F.col("max_repeats")).alias("cap_ok"))


#: Stands in for the secret of a real run.
KEY = b"key of the example queries"


def p10_found(spark, d):
    return redact.find_pii(table(spark, d, "documents"), table(spark, d, "name_lexicon")).distinct()


def p10_redacted(spark, d):
    return redact.redact(table(spark, d, "documents"), table(spark, d, "name_lexicon"), KEY)


STATISTICS = f"""
  WITH r AS (SELECT DISTINCT tile_layer_id, feature_id, tags[2 * i + 1] AS k, tags[2 * i + 2] AS v
             FROM (SELECT tile_layer_id, feature_id, tags, unnest(range(len(tags) // 2)) AS i FROM tile_features)
             WHERE tile_layer_id IS NOT NULL AND feature_id IS NOT NULL),
  m AS (SELECT r.tile_layer_id, feature_id, trim(regexp_replace(lower(layer_values[v + 1].string_value), '[\\s\\p{{Z}}]+', ' ', 'g')) AS term
        FROM r JOIN tile_layers l USING (tile_layer_id) WHERE k >= 0 AND v >= 0 AND k < len(layer_keys) AND v < len(layer_values)),
  builds AS ({BUILDS}),
  f AS (SELECT tileset, build_no, lower(unnest(map_keys(l.fields))) AS term FROM (SELECT tileset, build_no, unnest(vector_layers) AS l FROM builds))
  SELECT 'value' AS place, term, count(DISTINCT (tile_layer_id, feature_id)) AS n_records, count(*) AS n_occurrences,
         (SELECT count(*) FROM (SELECT DISTINCT tile_layer_id, feature_id FROM tile_features)) AS n_total FROM m WHERE term <> '' GROUP BY 2
  UNION ALL
  SELECT 'field', term, count(DISTINCT (tileset, build_no)), count(*), (SELECT count(*) FROM builds) FROM f GROUP BY 2"""

RUNS = """
  WITH e AS (SELECT DISTINCT archive_id, tile_offset, tile_id, run_length FROM tile_entries WHERE run_length > 0),
  g AS (SELECT *, CASE WHEN tile_id <= 1 + max(tile_id + run_length - 1) OVER w THEN 0 ELSE 1 END AS new FROM e
        WINDOW w AS (PARTITION BY archive_id, tile_offset ORDER BY tile_id, run_length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY archive_id, tile_offset ORDER BY tile_id, run_length ROWS UNBOUNDED PRECEDING) AS run FROM g)
  SELECT archive_id, tile_offset, min(tile_id) AS first_tile_id, max(tile_id + run_length - 1) AS last_tile_id, count(*) AS n_entries,
         max(tile_id + run_length) - min(tile_id) AS n_tiles
  FROM n GROUP BY archive_id, tile_offset, run HAVING count(*) >= 2"""

#: Runs of 12 equal words, whole texts on both sides: words are told apart after folding case, accents and characters that
#: can't be seen (soft hyphens and characters without width, also inside words).
WORDS = r"""regexp_extract_all(regexp_replace(lower(strip_accents(nfc_normalize({0}))), '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}\p{{M}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"""
LEAKED = f"""
  WITH i AS (SELECT item_id, {WORDS.format('text')} AS w FROM eval_items), d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
  iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
  dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
  SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)"""

QUERIES = {f.__name__: f for f in (p3_found, p3_statistics, p6_found, p6_tile_runs, p6_event_runs, p8_found, p8_leaks, p9_mixture, p9_shares, p9_checks, p10_found, p10_redacted)}

ORACLE = {
    "p8_found": LEAKED,
    "p9_checks": "SELECT DISTINCT lower(trim(source)) AS source, true AS share_ok, true AS once_ok, true AS cap_ok FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0",
    "p3_found": f"""
WITH s AS ({STATISTICS})
SELECT place, term, 'rare' AS mark FROM s WHERE n_records < 3
UNION ALL SELECT place, term, 'common' FROM s WHERE n_records * 100 > n_total * CASE place WHEN 'value' THEN 10 ELSE 50 END""",
    "p3_statistics": STATISTICS,
    "p6_found": f"WITH r AS ({RUNS}) SELECT DISTINCT archive_id, first_tile_id, last_tile_id FROM r",
    "p6_tile_runs": RUNS,
    "p6_event_runs": """
WITH l AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, event_type, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds
FROM n GROUP BY user_id, run, event_type""",
}
