"""Policy and JSON queries: documents are JSON strings made from given rows, parsed back by the operators.

Fixed values: the forms of the derived policies (valid, without a name, with
text or fractions where numbers belong, disabled); one policy per customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import policy
from vigil.functions import cost as fc
from vigil.plans.registry import query
from vigil.sources import dims, json_io
from vigil.sources.tables import read_table

# The document text, in a form that both engines read alike.
_DOC = """'{' || CASE WHEN c_custkey % 7 = 3 THEN '' WHEN c_custkey % 7 = 4 THEN '"name": "", ' ELSE '"name": "P' || c_custkey || '", ' END ||
  CASE WHEN c_custkey % 5 = 0 THEN '"enabled": false, ' WHEN c_custkey % 5 = 1 THEN '' ELSE '"enabled": true, ' END ||
  '"cost_limits": {"max_per_request": ' || CASE WHEN c_custkey % 6 = 2 THEN '"0.5"' ELSE CAST(c_custkey % 9 AS STRING) || '.25' END ||
  ', "daily_cap": ' || CASE WHEN c_custkey % 11 = 5 THEN '[1]' ELSE CAST(10 + c_custkey % 90 AS STRING) END || '}, ' ||
  '"rate_limits": {"requests_per_minute": ' || CASE WHEN c_custkey % 8 = 1 THEN '1.5' WHEN c_custkey % 8 = 2 THEN 'true' ELSE CAST(1 + c_custkey % 60 AS STRING) END ||
  CASE WHEN c_custkey % 3 = 0 THEN ', "requests_per_day": "many"' ELSE '' END || '}}'"""

POLICIES_SQL = f"""pol AS (SELECT 'policy-' || right('000000000' || CAST(c_custkey AS VARCHAR), 9) AS policy_name, c_custkey, c_nationkey,
       CAST({_DOC.replace('STRING', 'VARCHAR')} AS JSON) AS doc FROM customer)"""


def policies(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.select(F.expr("'policy-' || right('000000000' || CAST(c_custkey AS STRING), 9)").alias("policy_name"),
                    F.parse_json(F.expr(_DOC)).alias("doc"), F.lit(None).cast("timestamp").alias("modified"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _error(path: str, kinds: str, text: str) -> str:
    return f"CASE WHEN json_type(doc, '$.{path}') IS NOT NULL AND json_type(doc, '$.{path}') NOT IN ({kinds}) THEN '{text}' END"


_NUMBERS = "'UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'BOOLEAN'"
_ERRORS = ", ".join(
    [f"CASE WHEN coalesce(doc->>'$.name', '') = '' THEN {_q(dims.POLICY_NAME_ERROR)} END"]
    + [_error(f"cost_limits.{f}", _NUMBERS, dims.POLICY_NUMBER_ERROR.format(field=f)) for f in policy.COST_FIELDS]
    + [_error(f"rate_limits.{f}", "'UBIGINT', 'BIGINT', 'HUGEINT', 'BOOLEAN'", dims.POLICY_INTEGER_ERROR.format(field=f)) for f in policy.RATE_FIELDS])


@query("policy_validation", f"""WITH {POLICIES_SQL}
SELECT policy_name, array_to_string(list_filter([{_ERRORS}], lambda e: e IS NOT NULL), '; ') AS errors FROM pol""")
def policy_validation(spark, sf_dir):
    """Every policy's errors."""
    return policy.validate(policies(spark, sf_dir)).select("policy_name", F.array_join("errors", "; ").alias("errors"))


_ENABLED = "coalesce(CAST(doc->>'$.enabled' AS BOOLEAN), true)"


@query("policy_first_enabled", f"""WITH {POLICIES_SQL}
SELECT policy_name, doc->>'$.name' AS name, {_ENABLED} AS enabled FROM pol WHERE {_ENABLED} ORDER BY policy_name LIMIT 1""")
def policy_first_enabled(spark, sf_dir):
    """Nobody asked for a policy by name (one row is the feature)."""
    return policy.active_policy(policies(spark, sf_dir)).select("policy_name", "name", "enabled")


@query("policy_by_name", f"""WITH {POLICIES_SQL}
SELECT policy_name, doc->>'$.name' AS name, {_ENABLED} AS enabled FROM pol WHERE policy_name = 'policy-000000005'""")
def policy_by_name(spark, sf_dir):
    """P10: a policy asked for by name applies even when it is disabled."""
    return policy.active_policy(policies(spark, sf_dir), "policy-000000005").select("policy_name", "name", "enabled")


@query("requests_with_policies", f"""WITH {POLICIES_SQL},
req AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 <> 3 THEN 'policy-' || right('000000000' || CAST(o_custkey AS VARCHAR), 9) ELSE 'unknown' END AS wanted FROM orders),
fb AS (SELECT policy_name FROM pol WHERE {_ENABLED} ORDER BY policy_name LIMIT 1)
SELECT request_id, wanted, coalesce(pol.policy_name, (SELECT policy_name FROM fb)) AS policy_name,
       TRY_CAST((p.doc->>'$.cost_limits.daily_cap') AS DECIMAL(18,6)) AS daily_cap
FROM req LEFT JOIN pol ON pol.policy_name = wanted LEFT JOIN pol p ON p.policy_name = coalesce(pol.policy_name, (SELECT policy_name FROM fb))""")
def requests_with_policies(spark, sf_dir):
    """J4 with several policies: each request takes the one it names, else the first enabled."""
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.expr("CASE WHEN o_orderkey % 4 <> 3 THEN 'policy-' || right('000000000' || CAST(o_custkey AS STRING), 9) ELSE 'unknown' END").alias("wanted"))
    return policy.with_policies(o, policies(spark, sf_dir), "wanted").select("request_id", "wanted", "policy_name", "daily_cap")


@query("json_requests", """
SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, 'gpt-4' AS model, role, CAST(length(text) AS BIGINT) AS chars,
       CAST(4 + length(role) // 4 + length(text) // 4 AS BIGINT) AS input_tokens FROM conversations""")
def json_requests(spark, sf_dir):
    """Each turn written as a JSON request and read back with the declared schema."""
    c = read_table(spark, sf_dir, "conversations")
    raw = c.select(F.to_json(F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("gpt-4").alias("model"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))).alias("body"))
    r = json_io.parse_requests(raw, "body").select("request.*")
    first = F.try_element_at("messages", F.lit(1))
    return r.select("id", "model", first["role"].alias("role"), F.length(first["content"]).cast("bigint").alias("chars"),
                    fc.request_tokens(F.col("messages"), F.col("system")).alias("input_tokens"))


@query("json_responses", """
SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id,
       CAST(CASE WHEN turn % 2 = 0 THEN conv_id % 50 ELSE length(text) // 4 END AS BIGINT) AS output_tokens FROM conversations""")
def json_responses(spark, sf_dir):
    """Answers written as JSON, with usage on even turns only, and read back."""
    c = read_table(spark, sf_dir, "conversations")
    usage = F.when(F.col("turn") % 2 == 0, F.struct(F.lit(0).cast("bigint").alias("prompt_tokens"), (F.col("conv_id") % 50).cast("bigint").alias("completion_tokens")))
    raw = c.select(F.to_json(F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), usage.alias("usage"))).alias("response_json"))
    r = json_io.parse_responses(raw).select("response.*")
    return r.select("id", fc.response_tokens(F.col("usage"), F.col("choices")).alias("output_tokens"))
