"""Spend and budget queries over the request log (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.cost import sql_cost
from vigil.functions.formatting import sql_fixed
from vigil.operators import budget, costs
from vigil.plans.cost_queries import PRICED_SQL
from vigil.plans.registry import query
from vigil.sources import dims, fixtures
from vigil.sources.tables import read_table

# Test cap: some days of the sf0.01 log cross it and some do not.
DAILY_CAP = "0.35"
MAX_PER_MINUTE = "1.0"

P_IN = "coalesce(p.input_per_1k, CAST(0.0005 AS DECIMAL(12,8)))"
P_OUT = "coalesce(p.output_per_1k, CAST(0.0015 AS DECIMAL(12,8)))"


def tracked(spark, sf_dir):
    return costs.tracked_requests(fixtures.request_log(read_table(spark, sf_dir, "events")))


@query("daily_running_spend", f"""WITH {PRICED_SQL}
SELECT request_id, day, cost,
       CAST(coalesce(sum(cost) OVER (PARTITION BY day ORDER BY ts, request_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(28,6)) AS spend_before
FROM tracked""")
def daily_running_spend(spark, sf_dir):
    return budget.daily_running_spend(tracked(spark, sf_dir)).select("request_id", "day", "cost", "spend_before")


CANDIDATES_SQL = fixtures.REQUEST_LOG_SQL + f""",
cand AS (
  SELECT request_id, ts, CAST(ts AS DATE) AS day,
         CAST({sql_cost('input_tokens', 'coalesce(max_tokens, 500)', P_IN, P_OUT)} * 1000000 AS BIGINT) AS est_micro,
         CASE WHEN cached OR status <> 200 THEN 0 ELSE
           CAST({sql_cost('input_tokens', 'output_tokens', P_IN, P_OUT)} * 1000000 AS BIGINT) END AS act_micro
  FROM request_log LEFT JOIN {dims.sql_pricing_values('p', 'p_model')} ON model = p_model
  WHERE status <> 429),
c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, request_id) AS rn FROM cand)"""

_CAP_MICRO = int(float(DAILY_CAP) * 1_000_000)


@query("daily_budget_admission", f"""WITH RECURSIVE {CANDIDATES_SQL},
f AS (
  SELECT day, rn, request_id, est_micro <= {_CAP_MICRO} AS allowed, CAST(0 AS BIGINT) AS before,
         CAST(CASE WHEN est_micro <= {_CAP_MICRO} THEN act_micro ELSE 0 END AS BIGINT) AS spend
  FROM c WHERE rn = 1
  UNION ALL
  SELECT c.day, c.rn, c.request_id, f.spend + c.est_micro <= {_CAP_MICRO}, f.spend,
         f.spend + CASE WHEN f.spend + c.est_micro <= {_CAP_MICRO} THEN c.act_micro ELSE 0 END
  FROM f JOIN c ON c.day = f.day AND c.rn = f.rn + 1)
SELECT request_id, allowed, CAST(CAST(before AS DECIMAL(38,0)) * 0.000001 AS DECIMAL(18,6)) AS spend_before,
       CASE WHEN NOT allowed THEN 'Would exceed daily cap ${float(DAILY_CAP)} (current: $' ||
         {sql_fixed('CAST(before AS DECIMAL(38,0)) * 0.000001', 2)} || ')' END AS reason
FROM f""")
def daily_budget_admission(spark, sf_dir):
    # all that the rate limiter let through: a request that fails later is decided too, and adds no cost
    log = fixtures.request_log(read_table(spark, sf_dir, "events")).where(F.col("status") != 429)
    d = costs.price_requests(costs.with_estimate(log))
    d = d.withColumn("actual_cost", F.when(F.col("cached") | (F.col("status") != 200), F.lit(0)).otherwise(F.col("cost")))
    return budget.admission(d, DAILY_CAP)


@query("minute_spend", f"""WITH {PRICED_SQL},
ps AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(sum(cost) AS DECIMAL(28,6)) AS spend
       FROM tracked GROUP BY 1)
SELECT sec, spend, CAST(sum(spend) OVER (ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS DECIMAL(28,6))
         AS spend_last_minute,
       sum(spend) OVER (ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) > {MAX_PER_MINUTE} AS over_limit
FROM ps""")
def minute_spend(spark, sf_dir):
    return budget.minute_spend(tracked(spark, sf_dir), MAX_PER_MINUTE)


@query("running_total_cost", f"""WITH {PRICED_SQL}
SELECT request_id, ts, cost,
       CAST(sum(cost) OVER (ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DECIMAL(28,6)) AS running_total
FROM tracked""")
def running_total_cost(spark, sf_dir):
    return budget.running_total_cost(tracked(spark, sf_dir)).select("request_id", "ts", "cost", "running_total")


def _util_sql() -> str:
    parts = []
    for period, b in budget.BUDGETS:
        ratio = f"round(CAST(sum(cost) AS DECIMAL(28,6)) / CAST({b} AS DECIMAL(18,6)), 6)"
        parts.append(
            f"SELECT '{period}' AS period, CAST(date_trunc('{period}', ts) AS DATE) AS period_start, "
            f"CAST(sum(cost) AS DECIMAL(28,6)) AS spend, CAST({b} AS DECIMAL(18,6)) AS budget, "
            f"CAST({ratio} AS DECIMAL(18,6)) AS utilisation, "
            f"CASE WHEN {ratio} >= {budget.ALERT_BLOCK} THEN 'block' WHEN {ratio} >= {budget.ALERT_NOTIFY} "
            f"THEN 'notify' ELSE 'ok' END AS action FROM tracked GROUP BY 2")
    return " UNION ALL ".join(parts)


@query("budget_utilisation", f"""WITH {PRICED_SQL}
{_util_sql()}""")
def budget_utilisation(spark, sf_dir):
    return budget.utilisation(tracked(spark, sf_dir))
