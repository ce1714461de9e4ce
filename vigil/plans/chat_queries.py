"""Token estimates, replay reports and spans over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import cost as fc
from vigil.functions.cost import sql_cost
from vigil.functions.formatting import sql_fixed
from vigil.operators import audit, costs, policy, replay, spans
from vigil.plans.pii_queries import found_sql
from vigil.plans.registry import query
from vigil.sources import dims, fixtures
from vigil.sources.tables import read_table

# The file-default policy's per-request cost limit and cache settings.
MAX_PER_REQUEST = 0.03
CACHE_TTL = 3600

P_IN = "coalesce(p.input_per_1k, CAST(0.0005 AS DECIMAL(12,8)))"
P_OUT = "coalesce(p.output_per_1k, CAST(0.0015 AS DECIMAL(12,8)))"
PRICE_JOIN = f"LEFT JOIN {dims.sql_pricing_values('p', 'p_model')} ON model = p_model"
EST_SQL = sql_cost("input_tokens", "coalesce(max_tokens, 500)", P_IN, P_OUT)


def turns(spark, sf_dir, with_pii=False):
    return fixtures.chat_turns(read_table(spark, sf_dir, "conversations"), with_pii)


@query("request_token_estimate", f"""WITH {fixtures.CHAT_TURNS_SQL}
SELECT request_id, model, message_count, input_tokens,
       CAST(coalesce(max_tokens, 500) AS BIGINT) AS est_output_tokens, {EST_SQL} AS estimated_cost
FROM chat_turns {PRICE_JOIN}""")
def request_token_estimate(spark, sf_dir):
    d = costs.with_estimate(turns(spark, sf_dir))
    return d.select("request_id", "model", "message_count", "input_tokens", "est_output_tokens",
                    "estimated_cost")


@query("estimated_cost_check", f"""WITH {fixtures.CHAT_TURNS_SQL}
SELECT request_id, estimated_cost, estimated_cost <= {MAX_PER_REQUEST} AS allowed,
       CASE WHEN estimated_cost > {MAX_PER_REQUEST}
            THEN 'Estimated cost $' || {sql_fixed('estimated_cost', 4)} ||
                 ' exceeds per-request limit ${MAX_PER_REQUEST}' END AS reason
FROM (SELECT request_id, {EST_SQL} AS estimated_cost FROM chat_turns {PRICE_JOIN})""")
def estimated_cost_check(spark, sf_dir):
    d = costs.with_estimate(turns(spark, sf_dir))
    allowed, reason = costs.per_request_check(F.col("estimated_cost"), MAX_PER_REQUEST)
    return d.select("request_id", "estimated_cost", allowed.alias("allowed"), reason.alias("reason"))


@query("replay_report", f"""WITH {fixtures.CHAT_TURNS_SQL}
SELECT request_id, model, message_count, input_tokens,
       CAST(coalesce(max_tokens, 500) AS BIGINT) AS max_output_tokens,
       {EST_SQL} AS estimated_cost,
       '$' || {sql_fixed(EST_SQL, 4)} AS estimated_cost_text,
       CASE WHEN {EST_SQL} <= {MAX_PER_REQUEST} THEN 'PASS' ELSE 'FAIL' END AS per_request_check,
       'ENABLED' AS caching, CAST({CACHE_TTL} AS INTEGER) AS cache_ttl_seconds
FROM chat_turns {PRICE_JOIN}""")
def replay_report(spark, sf_dir):
    return replay.replay_report(turns(spark, sf_dir), MAX_PER_REQUEST, True, CACHE_TTL)


@query("replay_actuals", f"""WITH {fixtures.CHAT_TURNS_SQL},
resp AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, text AS response_text
         FROM conversations WHERE role = 'assistant')
SELECT c.request_id, model, input_tokens, CAST(coalesce(max_tokens, 500) AS BIGINT) AS est_output_tokens,
       {EST_SQL} AS estimated_cost,
       CAST(coalesce(prompt_tokens, 0) AS BIGINT) AS actual_input_tokens,
       CAST(coalesce(completion_tokens, 0) AS BIGINT) AS actual_output_tokens,
       CAST(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS BIGINT) AS actual_total_tokens,
       {sql_cost('coalesce(prompt_tokens, 0)', 'coalesce(completion_tokens, 0)', P_IN, P_OUT)} AS actual_cost,
       substring(coalesce(r.response_text, ''), 1, 100) ||
         CASE WHEN length(coalesce(r.response_text, '')) > 100 THEN '...' ELSE '' END AS response_preview
FROM chat_turns c LEFT JOIN resp r ON c.request_id = r.request_id {PRICE_JOIN}""")
def replay_actuals(spark, sf_dir):
    reqs = turns(spark, sf_dir).drop("response_text")
    conv = read_table(spark, sf_dir, "conversations")
    resp = conv.where(F.col("role") == "assistant").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("response_text"))
    return replay.replay_actuals(replay.pair_responses(reqs, resp))


@query("request_spans", f"""WITH {found_sql(src="SELECT conv_id, turn, role, text FROM conversations")},
{fixtures.chat_turns_sql("pii_found", with_pii=True)}
SELECT model AS llm_model, request_id AS llm_request_id, message_count AS llm_message_count,
       CAST(coalesce(max_tokens, 0) AS BIGINT) AS llm_max_tokens,
       coalesce(temperature, 1.0) AS llm_temperature, request_chars AS llm_request_chars,
       CAST(coalesce(prompt_tokens, 0) AS BIGINT) AS llm_prompt_tokens,
       CAST(coalesce(completion_tokens, 0) AS BIGINT) AS llm_completion_tokens,
       CAST(coalesce(prompt_tokens + completion_tokens, 0) AS BIGINT) AS llm_total_tokens,
       CASE WHEN has_usage THEN {sql_cost('prompt_tokens', 'completion_tokens', P_IN, P_OUT)} END AS llm_cost_usd,
       false AS cache_hit,
       request_findings_count AS pii_request_findings, response_findings_count AS pii_response_findings,
       request_findings_count + response_findings_count AS pii_total_findings,
       'OK' AS status
FROM chat_turns {PRICE_JOIN}""")
def request_spans(spark, sf_dir):
    d = costs.with_prices(turns(spark, sf_dir, with_pii=True))
    d = d.withColumn("cost", F.when(F.col("has_usage"), fc.calculate_cost(
        F.col("prompt_tokens"), F.col("completion_tokens"), F.col("input_per_1k"), F.col("output_per_1k"))))
    d = d.withColumn("cache_hit", F.lit(False)).withColumn("status", F.lit("OK"))
    return spans.request_spans(d)


@query("suspicious_prompts", f"""SELECT conv_id, turn, hits,
       hits > 0 AS suspicious,
       CASE WHEN hits >= 2 THEN 'high' WHEN hits = 1 THEN 'medium' ELSE 'low' END AS risk_level
FROM (SELECT conv_id, turn, CAST({audit.sql_indicator_hits('text')} AS INTEGER) AS hits
      FROM conversations WHERE role = 'user')""")
def suspicious_prompts(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return audit.suspicious_prompts(conv, "text").select("conv_id", "turn", "hits", "suspicious", "risk_level")


@query("routed_models", f"""WITH {fixtures.REQUEST_LOG_SQL}
SELECT request_id, model, {policy.sql_route(policy.FILE_DEFAULT_ROUTING)} AS routed_model
FROM request_log""")
def routed_models(spark, sf_dir):
    log = fixtures.request_log(read_table(spark, sf_dir, "events"))
    return log.select("request_id", "model",
                      policy.route_model(policy.FILE_DEFAULT_ROUTING).alias("routed_model"))



@query("response_token_counts", f"""WITH {fixtures.CHAT_TURNS_SQL}
SELECT request_id, CAST(CASE WHEN has_usage THEN coalesce(completion_tokens, 0)
                             ELSE coalesce(length(response_text), 0) // 4 END AS BIGINT) AS response_tokens
FROM chat_turns""")
def response_token_counts(spark, sf_dir):
    """Completion tokens from usage when the response has it, else the
    token count of the choices' contents."""
    t = turns(spark, sf_dir)
    usage = F.when(F.col("has_usage"), F.struct(F.col("completion_tokens").alias("completion_tokens")))
    choices = F.array(F.struct(F.struct(F.col("response_text").alias("content")).alias("message")))
    return t.select("request_id", fc.response_tokens(usage, choices).alias("response_tokens"))
