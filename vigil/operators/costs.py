"""Pricing and cost accounting: J1, X13, P8, P9, A1, A2, C3, C4, K1, K2."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import cost as fc
from vigil.functions.formatting import fixed
from vigil.sources import dims

PRICE_COLS = ["input_per_1k", "output_per_1k"]


def with_prices(df: DataFrame, pricing: DataFrame | None = None, model_col: str = "model") -> DataFrame:
    """Left lookup of per-1K prices by exact model name; a missing model
    takes the fallback model's prices.

    The built-in pricing dimension is a fixed handful of rows, so it is
    broadcast. A user's table gets no hint (AQE broadcasts it by its measured
    size), and one row per model, so that it cannot multiply requests.
    """
    if pricing is None:
        p = F.broadcast(dims.pricing_table(df.sparkSession).select(F.col("model").alias("_price_model"), *PRICE_COLS))
    else:
        p = pricing.groupBy(F.col("model").alias("_price_model")).agg(
            F.min(F.struct(*PRICE_COLS)).alias("_p")).select("_price_model", "_p.*")
    fin, fout = dims.fallback_prices()
    out = df.join(p, df[model_col] == p["_price_model"], "left").drop("_price_model")
    return (out.withColumn("input_per_1k", F.coalesce(F.col("input_per_1k"), fin))
               .withColumn("output_per_1k", F.coalesce(F.col("output_per_1k"), fout)))


def price_requests(df: DataFrame, in_col: str = "input_tokens", out_col: str = "output_tokens",
                   pricing: DataFrame | None = None) -> DataFrame:
    """X13 per row: exact decimal cost rounded to 6 places."""
    return with_prices(df, pricing).withColumn(
        "cost", fc.calculate_cost(F.col(in_col), F.col(out_col),
                                  F.col("input_per_1k"), F.col("output_per_1k"))
    ).drop(*PRICE_COLS)


def trackable(log: DataFrame) -> Column:
    """P9 on the request log: only completed (200) and uncached requests are
    costed; rate-limited, blocked and cache-hit requests never are."""
    return (F.col("status") == 200) & ~F.col("cached")


def tracked_requests(log: DataFrame) -> DataFrame:
    """Costed rows of the request log with their UTC day."""
    return price_requests(log.where(trackable(log))).withColumn("day", F.to_date("ts"))


def model_daily_stats(log: DataFrame) -> DataFrame:
    """A2 / K2: requests, tokens and cost per (day, model).

    Partial aggregation runs before the shuffle, so a hot model or day only
    sends one partial row per task.
    """
    return (tracked_requests(log)
            .groupBy("day", "model")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"),
                 F.sum("cost").cast(dims.MONEY_SUM).alias("cost")))


def daily_cost(log: DataFrame) -> DataFrame:
    """A1 / K1: sum of rounded per-request costs per day (round, then sum)."""
    return (tracked_requests(log).groupBy("day")
            .agg(F.sum("cost").cast(dims.MONEY_SUM).alias("cost")))


def with_estimate(df: DataFrame, input_col: str = "input_tokens", max_col: str = "max_tokens",
                  pricing: DataFrame | None = None) -> DataFrame:
    """Estimated cost from the request's input tokens and max_tokens."""
    d = df.withColumn("est_output_tokens",
                      F.coalesce(F.col(max_col).cast("bigint"),
                                 F.lit(dims.DEFAULT_MAX_TOKENS_FOR_COST).cast("bigint")))
    d = with_prices(d, pricing)
    return d.withColumn("estimated_cost", fc.calculate_cost(
        F.col(input_col), F.col("est_output_tokens"), F.col("input_per_1k"), F.col("output_per_1k"))
    ).drop(*PRICE_COLS)


def per_request_check(estimate: Column, max_per_request: float | Column) -> tuple[Column, Column]:
    """(allowed, reason). Rejected when the estimate is strictly above the
    limit; the reason carries the estimate to 4 places."""
    limit = max_per_request if isinstance(max_per_request, Column) else F.lit(Decimal(str(max_per_request)))
    over = estimate > limit
    a, b, c = re.split(r"\{estimate\}|\{limit\}", dims.PER_REQUEST_REASON)
    reason = F.when(over, F.concat(F.lit(a), fixed(estimate, 4), F.lit(b), _py_number(limit), F.lit(c)))
    return ~over, reason


def _py_number(c: Column) -> Column:
    """Renders a limit the way the policy file spells it (0.03, 1.0, 100.0)."""
    d = c.cast("double")
    return F.when(d == F.floor(d), F.concat(F.floor(d).cast("bigint").cast("string"), F.lit(".0"))) \
            .otherwise(d.cast("string"))
