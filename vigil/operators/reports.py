"""Usage reports (C8): A1, A3-A6, J2, O2, O3, P13, P15, P20, T8.

All are partial+final hash aggregates over the request log; results are a
handful of rows. "Now" is always the ``as_of`` parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.formatting import money, status_class_dashboard
from vigil.operators import costs
from vigil.sources.dims import COUNTER_RETENTION_DAYS, MONEY_SUM

RECENT_ROWS = 20


def retained(stats: DataFrame, as_of: str, days: int = COUNTER_RETENTION_DAYS) -> DataFrame:
    """T8 in batch: counters live 7 days; keep days in (as_of - 7, as_of]."""
    a = F.to_date(F.lit(as_of))
    return stats.where((F.col("day") > F.date_sub(a, days)) & (F.col("day") <= a))


def cost_trend(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """J2 + O2: dense day spine ending at as_of, zero-filled, ascending."""
    a = F.to_date(F.lit(as_of))
    # at most ``days`` rows after the day filter (pushed to the scan): a
    # proven bound, so the daily totals are the broadcast side
    daily = costs.daily_cost(log).where((F.col("day") > F.date_sub(a, days)) & (F.col("day") <= a))
    spine = log.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(a, days - 1), a)).alias("day"))
    return (spine.join(F.broadcast(daily), "day", "left")
            .select("day", F.coalesce(F.col("cost"), F.lit(0).cast(MONEY_SUM)).alias("cost"))
            .orderBy("day"))


def model_totals(log: DataFrame, as_of: str) -> DataFrame:
    """A3 over the retained model/day counters of a log."""
    return counter_totals(costs.model_daily_stats(log), as_of)


def counter_totals(stats: DataFrame, as_of: str) -> DataFrame:
    """A3 over model/day counters (a table of them, or ``jobs.read_counters``): nothing of the raw log is read."""
    s = retained(stats, as_of)
    return s.groupBy("model").agg(
        F.sum("requests").alias("requests"), F.sum("cost").cast(MONEY_SUM).alias("cost"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("tokens"))


def overview(log: DataFrame, as_of: str) -> DataFrame:
    """A4: 7-day cost, today's cost, total requests (retained counters) and
    requests with PII, in one aggregate pass each side."""
    s = retained(costs.model_daily_stats(log), as_of)
    a = F.to_date(F.lit(as_of))
    left = s.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY_SUM).alias("total_cost_7d"),
                 F.coalesce(F.sum(F.when(F.col("day") == a, F.col("cost"))), F.lit(0)).cast(MONEY_SUM).alias("today_cost"),
                 F.coalesce(F.sum("requests"), F.lit(0)).cast("bigint").alias("total_requests"))
    right = log.agg(F.count_if(F.col("pii_findings") > 0).alias("pii_requests"))
    # two single-row aggregates combined by a union and one more aggregate
    # (no join, so no nested-loop plan)
    both = left.select("*", F.lit(None).cast("bigint").alias("pii_requests")).unionByName(
        right.select(F.lit(None).cast(MONEY_SUM).alias("total_cost_7d"), F.lit(None).cast(MONEY_SUM).alias("today_cost"),
                     F.lit(None).cast("bigint").alias("total_requests"), "pii_requests"))
    one = both.agg(*[F.max(c).alias(c) for c in ["total_cost_7d", "today_cost", "total_requests", "pii_requests"]])
    return one.select(
        "total_cost_7d", "today_cost", "total_requests", "pii_requests",
        F.concat(F.lit("$"), F.format_string("%.2f", F.round("total_cost_7d", 2).cast("double"))).alias("total_cost_text"),
        F.format_number(F.col("total_requests"), 0).alias("total_requests_text"))


def pii_rate(log: DataFrame) -> DataFrame:
    """A5: requests with PII and their share, '0%' for an empty log."""
    g = log.agg(F.count_if(F.col("pii_findings") > 0).alias("pii_requests"),
                F.count(F.lit(1)).alias("total_requests"))
    pct = F.try_divide(F.col("pii_requests") * 100.0, F.col("total_requests"))
    return g.select("pii_requests", "total_requests",
                    F.round(pct, 6).alias("pii_percent"),
                    F.when(F.col("total_requests") > 0,
                           F.format_string("%.1f%% of requests", F.round(pct, 1)))
                     .otherwise(F.lit("0%")).alias("pii_text"))


def pii_by_model(log: DataFrame) -> DataFrame:
    """A6 + P20."""
    return log.where(F.col("pii_findings") > 0).groupBy("model").agg(F.count(F.lit(1)).alias("pii_requests"))


def recent_requests(log: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """O3 + P13 + P15: newest n requests (total order ts desc, request_id),
    formatted for display. The limit is the feature (a top-n view); Spark
    plans it as TakeOrderedAndProject, a per-task top-n then a merge."""
    priced = costs.price_requests(log)
    top = priced.orderBy(F.col("ts").desc(), F.col("request_id")).limit(n)
    return top.select(
        "request_id", "ts",
        F.date_format("ts", "HH:mm:ss").alias("time"), "model",
        F.concat(status_class_dashboard(F.col("status")), F.lit(" "), F.col("status").cast("string")).alias("status"),
        money(F.col("cost"), 4).alias("cost"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        (F.col("pii_findings") > 0).alias("pii"),
        F.col("cached").alias("cache"))

