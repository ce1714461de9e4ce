"""Response-cache queries over the request log (events).

Rows rejected before the cache step (status 429) never reach it; a miss
whose answer failed (status 400 in this log) stores nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.keys import cache_key, sql_json_string
from vigil.operators import cache
from vigil.plans.registry import query
from vigil.sources import fixtures
from vigil.sources.tables import read_table

REPLAY_TTL = 6 * 3600
TABLE_TTL = 3 * 86400
INVALIDATE_GLOB = "0*"


def keyed(spark, sf_dir):
    return fixtures.with_client_and_key(fixtures.request_log(read_table(spark, sf_dir, "events")))


def _replay(spark, sf_dir, ttl, carry=None):
    log = keyed(spark, sf_dir)
    return cache.replay(log, ttl, eligible=F.col("status") != 429, answered_ok=F.col("status") == 200,
                        carry=carry)


def replay_sql(ttl: int) -> str:
    ttl_us = ttl * 1_000_000
    live = f"f.store IS NOT NULL AND r.t < f.store + {ttl_us}"
    return f"""{fixtures.KEYED_LOG_SQL},
r AS (SELECT request_id, cache_key, ts, model, epoch_us(ts) AS t, status = 200 AS ok,
             row_number() OVER (PARTITION BY cache_key ORDER BY epoch_us(ts), request_id) AS rn
      FROM keyed_log WHERE status <> 429),
f AS (
  SELECT cache_key, rn, request_id, ts, model, false AS hit,
         CASE WHEN ok THEN t END AS store, CASE WHEN ok THEN t END AS entry
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.cache_key, r.rn, r.request_id, r.ts, r.model, {live} AS hit,
         CASE WHEN {live} THEN f.store WHEN r.ok THEN r.t ELSE f.store END AS store,
         CASE WHEN {live} THEN f.store WHEN r.ok THEN r.t END AS entry
  FROM f JOIN r ON r.cache_key = f.cache_key AND r.rn = f.rn + 1)"""


_DOC_JSON = ("'{\"max_tokens\": null, \"messages\": [{\"content\": ' || " + sql_json_string("text") +
             " || ', \"role\": \"user\"}], \"model\": \"gpt-4\", \"temperature\": 1.0, \"top_p\": 1.0}'")


@query("document_cache_keys", f"""SELECT doc_id, sha256({_DOC_JSON}) AS cache_key FROM documents""")
def document_cache_keys(spark, sf_dir):
    """P2 over whole texts in every script: each document as a one-message request."""
    none = F.lit(None).cast("double")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", cache_key(F.lit("gpt-4"), msgs, none, none.cast("int"), none).alias("cache_key"))


@query("cache_keys", f"""WITH {fixtures.KEYED_LOG_SQL}
SELECT request_id, cache_key FROM keyed_log""")
def cache_keys(spark, sf_dir):
    return keyed(spark, sf_dir).select("request_id", "cache_key")


@query("cache_replay", f"""WITH RECURSIVE {replay_sql(REPLAY_TTL)}
SELECT request_id, cache_key, ts, hit AS cache_hit, make_timestamp(entry) AS entry_stored_at FROM f""")
def cache_replay(spark, sf_dir):
    return _replay(spark, sf_dir, REPLAY_TTL)


@query("cache_table", f"""WITH RECURSIVE {replay_sql(TABLE_TTL)}
SELECT cache_key, make_timestamp(max(entry)) AS stored_at, arg_max(request_id, entry) AS request_id,
       make_timestamp(max(entry)) + INTERVAL {TABLE_TTL} SECOND AS expires_at
FROM f WHERE NOT hit AND entry IS NOT NULL GROUP BY cache_key""")
def cache_table(spark, sf_dir):
    return cache.cache_table(_replay(spark, sf_dir, TABLE_TTL), None, TABLE_TTL)


@query("cache_hit_stats", f"""WITH RECURSIVE {replay_sql(TABLE_TTL)}
SELECT CAST(ts AS DATE) AS day, model, count(*) FILTER (WHERE hit) AS hits,
       count(*) FILTER (WHERE NOT hit) AS misses
FROM f GROUP BY 1, 2""")
def cache_hit_stats(spark, sf_dir):
    return cache.hit_stats(_replay(spark, sf_dir, TABLE_TTL, carry=["model"]))


@query("cache_invalidate", f"""WITH RECURSIVE {replay_sql(TABLE_TTL)}
SELECT cache_key, make_timestamp(max(entry)) AS stored_at, arg_max(request_id, entry) AS request_id,
       make_timestamp(max(entry)) + INTERVAL {TABLE_TTL} SECOND AS expires_at
FROM f WHERE NOT hit AND entry IS NOT NULL AND NOT regexp_matches(cache_key, '^0.*$') GROUP BY cache_key""")
def cache_invalidate(spark, sf_dir):
    t = cache.cache_table(_replay(spark, sf_dir, TABLE_TTL), None, TABLE_TTL)
    return cache.invalidate(t, INVALIDATE_GLOB)


LOOKUP_SPLIT = "2024-01-16"


@query("cache_lookup", f"""WITH RECURSIVE {replay_sql(TABLE_TTL).replace("WHERE status <> 429", f"WHERE status <> 429 AND ts < TIMESTAMP '{LOOKUP_SPLIT}'")},
tbl AS (SELECT cache_key, make_timestamp(max(entry)) AS stored_at,
               make_timestamp(max(entry)) + INTERVAL {TABLE_TTL} SECOND AS expires_at
        FROM f WHERE NOT hit AND entry IS NOT NULL GROUP BY cache_key)
SELECT l.request_id, l.cache_key, l.ts, t.stored_at,
       coalesce(t.stored_at <= l.ts AND l.ts < t.expires_at, false) AS cache_hit
FROM keyed_log l LEFT JOIN tbl t ON l.cache_key = t.cache_key
WHERE l.ts >= TIMESTAMP '{LOOKUP_SPLIT}'""")
def cache_lookup(spark, sf_dir):
    """Requests of the second half of the log looked up in the cache
    table the first half built (equi-join on the key + validity range)."""
    log = keyed(spark, sf_dir)
    split = F.lit(LOOKUP_SPLIT).cast("timestamp_ntz")
    first = log.where(F.col("ts") < split)
    table = cache.cache_table(cache.replay(first, TABLE_TTL, eligible=F.col("status") != 429,
                                           answered_ok=F.col("status") == 200), None, TABLE_TTL)
    later = log.where(F.col("ts") >= split).select("request_id", "cache_key", "ts")
    return cache.lookup(later, table).select("request_id", "cache_key", "ts", "stored_at", "cache_hit")
