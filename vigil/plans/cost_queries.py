"""Cost accounting queries over the request log (events)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vigil.functions.cost import sql_cost
from vigil.operators import costs
from vigil.plans.registry import query
from vigil.sources import dims, fixtures
from vigil.sources.tables import read_table

PRICED_SQL = fixtures.REQUEST_LOG_SQL + f""",
tracked AS (
  SELECT l.*, CAST(l.ts AS DATE) AS day,
         {sql_cost('l.input_tokens', 'l.output_tokens',
                   "coalesce(p.input_per_1k, CAST(0.0005 AS DECIMAL(12,8)))",
                   "coalesce(p.output_per_1k, CAST(0.0015 AS DECIMAL(12,8)))")} AS cost
  FROM request_log l LEFT JOIN {dims.sql_pricing_values("p", "p_model")} ON l.model = p_model
  WHERE l.status = 200 AND NOT l.cached)"""


def log(spark: SparkSession, sf_dir: str):
    return fixtures.request_log(read_table(spark, sf_dir, "events"))


@query("model_daily_stats", f"""WITH {PRICED_SQL}
SELECT day, model, count(*) AS requests,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(cost) AS DECIMAL(28,6)) AS cost
FROM tracked GROUP BY day, model""")
def model_daily_stats(spark, sf_dir):
    return costs.model_daily_stats(log(spark, sf_dir))


@query("daily_cost", f"""WITH {PRICED_SQL}
SELECT day, CAST(sum(cost) AS DECIMAL(28,6)) AS cost FROM tracked GROUP BY day""")
def daily_cost(spark, sf_dir):
    return costs.daily_cost(log(spark, sf_dir))
