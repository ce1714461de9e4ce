"""Usage-report queries over the request log (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import costs, policy, reports
from vigil.plans.cost_queries import PRICED_SQL, log
from vigil.plans.registry import query
from vigil.sources import dims, fixtures
from vigil.functions.cost import sql_cost

AS_OF = fixtures.AS_OF
RETAINED = f"day > DATE '{AS_OF}' - 7 AND day <= DATE '{AS_OF}'"
STATS_SQL = f"""{PRICED_SQL},
stats AS (SELECT day, model, count(*) AS requests, sum(input_tokens) AS input_tokens,
                 sum(output_tokens) AS output_tokens, sum(cost) AS cost
          FROM tracked GROUP BY day, model)"""


@query("cost_trend_7d", f"""WITH {PRICED_SQL},
spine AS (SELECT CAST(unnest(generate_series(DATE '{AS_OF}' - 6, DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT day, sum(cost) AS cost FROM tracked GROUP BY day)
SELECT s.day, CAST(coalesce(d.cost, 0) AS DECIMAL(28,6)) AS cost FROM spine s LEFT JOIN daily d ON s.day = d.day""")
def cost_trend_7d(spark, sf_dir):
    return reports.cost_trend(log(spark, sf_dir), AS_OF)


@query("model_totals", f"""WITH {STATS_SQL}
SELECT model, sum(requests) AS requests, CAST(sum(cost) AS DECIMAL(28,6)) AS cost,
       CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS tokens
FROM stats WHERE {RETAINED} GROUP BY model""")
def model_totals(spark, sf_dir):
    return reports.model_totals(log(spark, sf_dir), AS_OF)


@query("overview_metrics", f"""WITH {STATS_SQL},
l AS (SELECT CAST(coalesce(sum(cost), 0) AS DECIMAL(28,6)) AS total_cost_7d,
             CAST(coalesce(sum(cost) FILTER (WHERE day = DATE '{AS_OF}'), 0) AS DECIMAL(28,6)) AS today_cost,
             CAST(coalesce(sum(requests), 0) AS BIGINT) AS total_requests
      FROM stats WHERE {RETAINED}),
r AS (SELECT count(*) FILTER (WHERE pii_findings > 0) AS pii_requests FROM request_log)
SELECT total_cost_7d, today_cost, total_requests, pii_requests,
       '$' || printf('%.2f', CAST(round(total_cost_7d, 2) AS DOUBLE)) AS total_cost_text,
       format('{{:,}}', total_requests) AS total_requests_text
FROM l, r""")
def overview_metrics(spark, sf_dir):
    return reports.overview(log(spark, sf_dir), AS_OF)


@query("pii_rate", f"""WITH {fixtures.REQUEST_LOG_SQL}
SELECT pii_requests, total_requests, round(pii_requests * 100.0 / total_requests, 6) AS pii_percent,
       CASE WHEN total_requests > 0 THEN printf('%.1f', round(pii_requests * 100.0 / total_requests, 1)) || '% of requests'
            ELSE '0%' END AS pii_text
FROM (SELECT count(*) FILTER (WHERE pii_findings > 0) AS pii_requests, count(*) AS total_requests FROM request_log)""")
def pii_rate(spark, sf_dir):
    return reports.pii_rate(log(spark, sf_dir))


@query("pii_by_model", f"""WITH {fixtures.REQUEST_LOG_SQL}
SELECT model, count(*) AS pii_requests FROM request_log WHERE pii_findings > 0 GROUP BY model""")
def pii_by_model(spark, sf_dir):
    return reports.pii_by_model(log(spark, sf_dir))


@query("recent_requests", f"""WITH {fixtures.REQUEST_LOG_SQL}
SELECT request_id, ts, strftime(ts, '%H:%M:%S') AS time, model,
       CASE WHEN status = 200 THEN 'ok' WHEN status = 429 THEN 'warning' ELSE 'error' END || ' ' || status AS status,
       '$' || printf('%.4f', CAST(round({sql_cost('input_tokens', 'output_tokens',
           "coalesce(p.input_per_1k, CAST(0.0005 AS DECIMAL(12,8)))",
           "coalesce(p.output_per_1k, CAST(0.0015 AS DECIMAL(12,8)))")}, 4) AS DOUBLE)) AS cost,
       input_tokens + output_tokens AS tokens, pii_findings > 0 AS pii, cached AS cache
FROM request_log LEFT JOIN {dims.sql_pricing_values('p', 'p_model')} ON model = p_model
ORDER BY ts DESC, request_id LIMIT 20""")
def recent_requests(spark, sf_dir):
    return reports.recent_requests(log(spark, sf_dir))


RETENTION_DAYS = 7


@query("masked_request_log", f"""WITH {PRICED_SQL.replace("WHERE l.status = 200 AND NOT l.cached", "")}
SELECT request_id, ts, model, status, prompt, CAST(NULL AS VARCHAR) AS response_text, cost, pii_findings
FROM tracked WHERE CAST(ts AS DATE) > DATE '{AS_OF}' - {RETENTION_DAYS}""")
def masked_request_log(spark, sf_dir):
    """P23 with the file-default logging flags (requests and costs kept,
    responses dropped) and a 7-day retention ending at as_of."""
    d = costs.price_requests(log(spark, sf_dir)).withColumn("response_text", F.lit(None).cast("string"))
    m = policy.log_policy_mask(d, log_requests=True, log_responses=False, log_costs=True, log_pii=True,
                               retention_days=RETENTION_DAYS, as_of=AS_OF)
    return m.select("request_id", "ts", "model", "status", "prompt", "response_text", "cost", "pii_findings")
