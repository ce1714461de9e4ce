"""The governed request path over the request log.

The oracle decides requests one after the other, in time order, with the
day's spend and the live cache entries as its state: it shares no shortcut
with the Spark side, which iterates cap and cache to their fixed point.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vigil.functions.cost import sql_cost
from vigil.functions.formatting import sql_fixed
from vigil.functions.keys import sql_json_string
from vigil.operators import govern, policy
from vigil.plans.limit_queries import LIMITS, TEST_LIMITS, dec_cte
from vigil.plans.registry import query
from vigil.sources import dims, fixtures
from vigil.sources.tables import read_table

MAX_PER_REQUEST = "0.03"
DAILY_CAP = "0.35"
CACHE_TTL = 21600

# The built-in default policy with limits tight enough to bind on this data.
TEST_POLICY = {
    **policy.BUILTIN_DEFAULT,
    "name": "Test Policy",
    "rate_limits": TEST_LIMITS,
    "cost_limits": {"max_per_request": float(MAX_PER_REQUEST), "daily_cap": float(DAILY_CAP)},
    "pii_detection": {"enabled": True, "action": "redact", "entities": ["email", "ip_address"]},
    "caching": {"enabled": True, "ttl_seconds": CACHE_TTL},
}


def test_policy_settings(spark):
    doc = spark.createDataFrame([("test", json.dumps(TEST_POLICY))], "policy_name string, json string")
    return policy.settings(doc.select("policy_name", F.parse_json("json").alias("doc")))


def flat(df):
    return df.select(
        "request_id", "client_id", "ts", "model", "cache_key",
        F.col("decision.allowed").alias("allowed"), F.col("decision.stage").alias("stage"),
        F.col("decision.status").alias("status"), F.col("decision.reason").alias("reason"),
        "estimated_cost", "cost", "tracked_cost", "cache_hit",
        F.array_join("pii.request_findings", ",").alias("pii_request_findings"),
        F.array_join("pii.response_findings", ",").alias("pii_response_findings"),
        "rate_remaining")


P_IN = "coalesce(p.input_per_1k, CAST(0.0005 AS DECIMAL(12,8)))"
P_OUT = "coalesce(p.output_per_1k, CAST(0.0015 AS DECIMAL(12,8)))"
_CAP_MICRO = int(float(DAILY_CAP) * 1_000_000)
_TTL_US = CACHE_TTL * 1_000_000
_NAMES = ", ".join(f"remaining_{n.split('_')[-1]}" for n, *_ in LIMITS)
_DOC = ("'{\"max_tokens\": ' || coalesce(CAST(max_tokens AS VARCHAR), 'null') || ', \"messages\": [{\"content\": ' || " + sql_json_string("content") +
        " || ', \"role\": \"user\"}], \"model\": ' || " + sql_json_string("model") + " || ', \"temperature\": 1.0, \"top_p\": 1.0}'")
# What redaction makes of the address, and where the findings lie (fixed forms of the fixture).
_MAIL = "'u' || user_id || '@mail.example.com'"

GOVERN_SQL = f"""WITH RECURSIVE {dec_cte(LIMITS)},
q AS (
  SELECT l.* REPLACE (CASE WHEN l.request_id % 13 <> 0 THEN l.model ELSE '{dims.DEFAULT_MODEL}' END AS model),
         split_part(user_agent, '/', 2) AS user_id,
         d.allowed AS rate_ok, d.reason AS rate_reason,
         coalesce(least({", ".join("d." + x.strip() for x in _NAMES.split(","))}), 0) AS rate_remaining
  FROM keyed_log l JOIN dec d ON l.request_id = d.request_id),
q2 AS (SELECT *, CASE WHEN pii_findings > 0 THEN prompt || ' mail to ' || left('u' || user_id, 2) || '***@***.***' ELSE prompt END AS content FROM q),
g0 AS (
  SELECT q2.* EXCLUDE (cache_key),
         CASE WHEN pii_findings > 0 THEN 'email:' || (length(prompt) + 9) || '-' || (length(prompt) + 9 + length({_MAIL})) ELSE '' END AS req_found,
         CASE WHEN request_id % 11 = 0 THEN 'ip_address:10-' || (10 + length(client_ip)) ELSE '' END AS ans_found,
         {sql_cost("4 + length('user') // 4 + length(content) // 4 + CASE WHEN request_id % 17 = 0 THEN length('answer briefly') // 4 ELSE 0 END", 'coalesce(max_tokens, 500)', P_IN, P_OUT)} AS estimated_cost,
         {sql_cost('input_tokens', 'output_tokens', P_IN, P_OUT)} AS full_cost
  FROM q2 LEFT JOIN {dims.sql_pricing_values('p', 'p_model')} ON q2.model = p_model),
g1 AS (SELECT *, sha256({_DOC}) AS cache_key, estimated_cost <= {MAX_PER_REQUEST} AS cost_ok,
              rate_ok AND estimated_cost <= {MAX_PER_REQUEST} AS reach FROM g0),
r AS (SELECT list({{'request_id': request_id, 'k': cache_key, 't': epoch_us(ts), 'day': CAST(ts AS DATE), 'ok': status = 200,
                    'est': CAST(estimated_cost * 1000000 AS BIGINT), 'act': CAST(full_cost * 1000000 AS BIGINT)}} ORDER BY ts, request_id) AS l
      FROM g1 WHERE reach),
f AS (  -- one request after the other: the spend of its day so far, and the cache entries that are still live
  SELECT unnest(list_reduce(l, lambda a, x:
    list_transform([{{'before': CASE WHEN a.day = x.day THEN a.spend ELSE 0 END, 'live': list_filter(a.live, lambda e: x.t < e.t + {_TTL_US})}}], lambda z:
      list_transform([{{'allowed': z.before + x.est <= {_CAP_MICRO}, 'from_id': list_filter(z.live, lambda e: e.k = x.k)[1].id}}], lambda y:
        {{'day': x.day,
          'spend': CASE WHEN y.allowed AND y.from_id IS NULL AND x.ok THEN z.before + x.act ELSE z.before END,
          'live': CASE WHEN y.allowed AND y.from_id IS NULL AND x.ok THEN list_append(z.live, {{'k': x.k, 't': x.t, 'id': x.request_id}}) ELSE z.live END,
          'out': list_append(a.out, {{'request_id': x.request_id, 'allowed': y.allowed, 'before': z.before,
                                      'from_id': CASE WHEN y.allowed THEN y.from_id END}})}})[1])[1],
    {{'day': CAST(NULL AS DATE), 'spend': CAST(0 AS BIGINT), 'live': []::STRUCT(k VARCHAR, t BIGINT, id BIGINT)[],
      'out': []::STRUCT(request_id BIGINT, allowed BOOLEAN, "before" BIGINT, from_id BIGINT)[]}}).out, recursive := true) FROM r),
g2 AS (SELECT g1.*, f.allowed AS cap_ok, f.before, f.from_id,
              CASE WHEN NOT rate_ok THEN 'rate_limit' WHEN NOT cost_ok OR NOT coalesce(f.allowed, true) THEN 'cost'
                   WHEN f.from_id IS NOT NULL THEN 'cache' WHEN status <> 200 THEN 'provider_error' ELSE 'provider' END AS stage
       FROM g1 LEFT JOIN f ON g1.request_id = f.request_id)
SELECT g.request_id, g.client_id, g.ts, g.model, g.cache_key,
       g.stage IN ('cache', 'provider') AS allowed, g.stage,
       CAST(CASE WHEN g.stage IN ('rate_limit', 'cost') THEN 429 WHEN g.stage = 'provider_error' THEN g.status ELSE 200 END AS INTEGER) AS status,
       coalesce(CASE WHEN NOT g.rate_ok THEN g.rate_reason END,
                CASE WHEN NOT g.cost_ok THEN 'Estimated cost $' || {sql_fixed('g.estimated_cost', 4)} ||
                     ' exceeds per-request limit ${MAX_PER_REQUEST}' END,
                CASE WHEN NOT g.cap_ok THEN 'Would exceed daily cap ${float(DAILY_CAP)} (current: $' ||
                     {sql_fixed('CAST(g.before AS DECIMAL(38,0)) * 0.000001', 2)} || ')' END) AS reason,
       g.estimated_cost,
       CASE WHEN g.stage = 'provider' THEN g.full_cost WHEN g.stage = 'cache' THEN s.full_cost END AS cost,
       CAST(CASE WHEN g.stage = 'provider' THEN g.full_cost ELSE 0 END AS DECIMAL(18,6)) AS tracked_cost,
       g.stage = 'cache' AS cache_hit,
       CASE WHEN g.stage = 'provider' THEN g.req_found WHEN g.stage = 'cache' THEN s.req_found ELSE '' END AS pii_request_findings,
       CASE WHEN g.stage = 'provider' THEN g.ans_found WHEN g.stage = 'cache' THEN s.ans_found ELSE '' END AS pii_response_findings,
       g.rate_remaining
FROM g2 g LEFT JOIN g2 s ON s.request_id = g.from_id AND g.stage = 'cache'"""


@query("governed_requests", GOVERN_SQL)
def governed_requests(spark, sf_dir):
    log = fixtures.with_client_and_key(fixtures.request_log(read_table(spark, sf_dir, "events")))
    reqs = govern.request_log_as_requests(log)
    return flat(govern.govern(reqs, test_policy_settings(spark)))
