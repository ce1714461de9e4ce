"""Sinks written from the given tables and read back: counters, corpora, spans, audit documents; reports over
findings detected in texts; the built-in default policy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.functions import pii
from vigil.operators import audit, costs, policy, reports, spans
from vigil.plans import chat_queries
from vigil.plans.cost_queries import PRICED_SQL, log
from vigil.plans.pii_queries import found_sql
from vigil.plans.registry import ORACLES, query
from vigil.plans.report_queries import AS_OF, RETAINED, STATS_SQL
from vigil.session import ensure_checkpoint_dir, spread
from vigil.sources import fixtures, json_io
from vigil.sources.tables import read_table
from vigil.streaming import jobs


def folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def counters(spark, sf_dir: str) -> str:
    """K1 / K2: the model and day counters, written by day."""
    path = folder(spark, "counters")
    json_io.write_counters(costs.model_daily_stats(log(spark, sf_dir)), path)
    return path


@query("counters_cost_trend", ORACLES["cost_trend_7d"])
def counters_cost_trend(spark, sf_dir):
    """S8 + U2: the last week's spend from the written counters, every day of it."""
    return json_io.read_daily_costs(spark, counters(spark, sf_dir), AS_OF)


@query("counters_model_stats", f"""WITH {STATS_SQL}
SELECT day, model, requests, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
       CAST(cost AS DECIMAL(18,6)) AS cost FROM stats WHERE {RETAINED}""")
def counters_model_stats(spark, sf_dir):
    """The last week's rows of the written counters."""
    return json_io.read_model_stats(spark, counters(spark, sf_dir), AS_OF)


@query("counters_model_totals", ORACLES["model_totals"])
def counters_model_totals(spark, sf_dir):
    """A3 from the written counters instead of the raw log."""
    return reports.counter_totals(spark.read.parquet(counters(spark, sf_dir)), AS_OF)


SPLIT = "2024-01-16 12:00:00"


@query("counters_refreshed", ORACLES["model_daily_stats"])
def counters_refreshed(spark, sf_dir):
    """Two epochs of running totals, the second with the days that the later requests touch; read as of the
    last epoch, before and after compaction into a table of its own."""
    path, requests = folder(spark, "epochs"), log(spark, sf_dir)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    jobs.merge_counters(path)(costs.model_daily_stats(requests.where(F.col("ts") < split)), 0)
    touched = F.to_date("ts") >= F.to_date(split)
    jobs.merge_counters(path)(costs.model_daily_stats(requests.where(touched)), 1)
    jobs.compact_counters(spark, path, path + "-compact")
    return jobs.read_counters(spark, path + "-compact")


@query("replay_corpus_written", """
SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, 'gpt-4' AS model, CAST(1 AS INTEGER) AS messages, role, text AS content,
       CAST(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 256 END AS INTEGER) AS max_tokens FROM conversations""")
def replay_corpus_written(spark, sf_dir):
    """K4: every turn as a request, written for replay and read back."""
    c = read_table(spark, sf_dir, "conversations")
    path = folder(spark, "corpus")
    json_io.write_replay_corpus(c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("gpt-4").alias("model"),
        F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
        F.when(F.col("conv_id") % 3 != 0, F.lit(256)).alias("max_tokens")), path)
    r = json_io.read_requests(spark, path, multiline=False)
    first = F.try_element_at("messages", F.lit(1))
    return r.select("id", "model", F.size("messages").alias("messages"), first["role"].alias("role"), first["content"].alias("content"), "max_tokens")


@query("spans_written", ORACLES["request_spans"])
def spans_written(spark, sf_dir):
    """K5: the spans of all requests, exported and read back."""
    path = folder(spark, "spans")
    spans.write_spans(chat_queries.request_spans(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("session_audit_written", f"""WITH {fixtures.REQUEST_LOG_SQL}
SELECT 'user-' || lpad(CAST(hash_bucket AS VARCHAR), 2, '0') AS session_id, request_id, model, status FROM
  (SELECT *, CAST(split_part(user_agent, '/', 2) AS BIGINT) % 32 AS hash_bucket FROM request_log)""")
def session_audit_written(spark, sf_dir):
    """K6: one JSON document per request, a folder per session (users in 32 groups), read back from the folders."""
    path = folder(spark, "audit")
    user = F.split_part(F.col("user_agent"), F.lit("/"), F.lit(2)).cast("bigint") % 32
    records = log(spark, sf_dir).select(F.concat(F.lit("user-"), F.lpad(user.cast("string"), 2, "0")).alias("session_id"), "request_id", "model", "status")
    audit.export_session_audit(records, path)
    d = spark.read.schema("value string, session_id string").text(path)
    return d.select("session_id", F.from_json("value", "request_id bigint, model string, status int").alias("d")).select("session_id", "d.*")


# Requests made of whole documents, with the findings that detection gives (no flag of the fixture).
_DOC_LOG = f"""WITH {found_sql()},
doc_log AS (SELECT doc_id AS request_id, ({fixtures._sql_list(fixtures.LOG_MODELS)})[doc_id % 5 + 1] AS model, CAST(len(f) AS BIGINT) AS pii_findings FROM pii_found)"""


def detected_log(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("request_id"), fixtures._pick(fixtures.LOG_MODELS, F.col("doc_id") % 5 + 1).alias("model"),
                    F.size(pii.detect(F.col("text"))).cast("bigint").alias("pii_findings"))


@query("pii_rate_detected", f"""{_DOC_LOG}
SELECT pii_requests, total_requests, round(pii_requests * 100.0 / total_requests, 6) AS pii_percent,
       CASE WHEN total_requests > 0 THEN printf('%.1f', round(pii_requests * 100.0 / total_requests, 1)) || '% of requests'
            ELSE '0%' END AS pii_text
FROM (SELECT count(*) FILTER (WHERE pii_findings > 0) AS pii_requests, count(*) AS total_requests FROM doc_log)""")
def pii_rate_detected(spark, sf_dir):
    """A5 over what detection finds in the texts."""
    return reports.pii_rate(detected_log(spark, sf_dir))


@query("pii_by_model_detected", f"""{_DOC_LOG}
SELECT model, count(*) AS pii_requests FROM doc_log WHERE pii_findings > 0 GROUP BY model""")
def pii_by_model_detected(spark, sf_dir):
    """A6 + P20 over what detection finds in the texts."""
    return reports.pii_by_model(detected_log(spark, sf_dir))


@query("requests_under_default_policy", f"""
SELECT o_orderkey AS request_id, 'default' AS policy_name, CAST({policy.BUILTIN_DEFAULT['cost_limits']['max_per_request']} AS DECIMAL(18,6)) AS max_per_request,
       CAST(o_totalprice / 1000000 AS DECIMAL(18,6)) <= {policy.BUILTIN_DEFAULT['cost_limits']['max_per_request']} AS cost_ok FROM orders""")
def requests_under_default_policy(spark, sf_dir):
    """Without any policy the built-in default decides."""
    none = policy.default_policies(spark).where("false")
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("policy-"), F.col("o_custkey").cast("string")).alias("wanted"), (F.col("o_totalprice") / 1000000).cast("decimal(18,6)").alias("estimated_cost"))
    d = policy.with_policies(o, policy.with_fallback(none, spark), "wanted")
    ok, _ = costs.per_request_check(F.col("estimated_cost"), F.col("max_per_request"))
    return d.select("request_id", "policy_name", "max_per_request", ok.alias("cost_ok"))
