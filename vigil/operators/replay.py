"""Offline replay reports (C6, C7, O6) and request/response pairing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import cost as fc
from vigil.functions.formatting import money
from vigil.operators import costs

PREVIEW_CHARS = 100


def response_preview(content: Column, n: int = PREVIEW_CHARS) -> Column:
    """First n characters, plus '...' when longer."""
    c = F.coalesce(content, F.lit(""))
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def replay_report(requests: DataFrame, max_per_request: float | None, caching_enabled: bool | None,
                  ttl_seconds: int | None) -> DataFrame:
    """One report row per request. Expects request_id, model,
    message_count, input_tokens, max_tokens. A missing ``caching`` section
    reports DISABLED here (unlike the live path, where it defaults on)."""
    d = costs.with_estimate(requests)
    if max_per_request is not None:
        check = F.when(F.col("estimated_cost") <= F.lit(Decimal(str(max_per_request))), "PASS").otherwise("FAIL")
    else:
        check = F.lit(None).cast("string")
    return d.select(
        "request_id", "model", "message_count", "input_tokens",
        F.col("est_output_tokens").alias("max_output_tokens"),
        "estimated_cost",
        money(F.col("estimated_cost"), 4).alias("estimated_cost_text"),
        check.alias("per_request_check"),
        F.lit("ENABLED" if caching_enabled else "DISABLED").alias("caching"),
        (F.lit(ttl_seconds if ttl_seconds is not None else 3600) if caching_enabled
         else F.lit(None)).cast("int").alias("cache_ttl_seconds"),
    )


def pair_responses(requests: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Request with its logged response (left join: a request may have
    none). Both sides are large and keyed by a unique id, so this is a plain
    shuffle join on the key; AQE splits skewed partitions if any."""
    return requests.join(responses, on=key, how="left")


def replay_actuals(pairs: DataFrame) -> DataFrame:
    """Estimated versus actual tokens and cost; usage absent counts 0."""
    d = costs.with_estimate(pairs)
    act_in = F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("bigint")
    act_out = F.coalesce(F.col("completion_tokens"), F.lit(0)).cast("bigint")
    d = d.withColumn("actual_input_tokens", act_in).withColumn("actual_output_tokens", act_out)
    d = costs.with_prices(d)
    return d.select(
        "request_id", "model", "input_tokens", "est_output_tokens", "estimated_cost",
        "actual_input_tokens", "actual_output_tokens",
        (F.col("actual_input_tokens") + F.col("actual_output_tokens")).alias("actual_total_tokens"),
        fc.calculate_cost(F.col("actual_input_tokens"), F.col("actual_output_tokens"),
                          F.col("input_per_1k"), F.col("output_per_1k")).alias("actual_cost"),
        response_preview(F.col("response_text")).alias("response_preview"),
    )
