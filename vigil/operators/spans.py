"""Per-request trace rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_spans(df: DataFrame) -> DataFrame:
    """One span row per forwarded request with the original's defaults:
    request id 'unknown', max_tokens 0, temperature 1.0, token counts 0.

    Expects model, request_id, message_count, max_tokens, temperature,
    request_chars, prompt_tokens, completion_tokens, cost, cache_hit,
    request_findings_count, response_findings_count, status."""
    z = F.lit(0).cast("bigint")
    req_f = F.coalesce(F.col("request_findings_count"), z)
    resp_f = F.coalesce(F.col("response_findings_count"), z)
    return df.select(
        F.col("model").alias("llm_model"),
        F.coalesce(F.col("request_id").cast("string"), F.lit("unknown")).alias("llm_request_id"),
        F.col("message_count").cast("bigint").alias("llm_message_count"),
        F.coalesce(F.col("max_tokens").cast("bigint"), z).alias("llm_max_tokens"),
        F.coalesce(F.col("temperature").cast("double"), F.lit(1.0)).alias("llm_temperature"),
        F.col("request_chars").cast("bigint").alias("llm_request_chars"),
        F.coalesce(F.col("prompt_tokens"), z).alias("llm_prompt_tokens"),
        F.coalesce(F.col("completion_tokens"), z).alias("llm_completion_tokens"),
        F.coalesce(F.col("prompt_tokens") + F.col("completion_tokens"), z).alias("llm_total_tokens"),
        F.col("cost").alias("llm_cost_usd"),
        F.coalesce(F.col("cache_hit"), F.lit(False)).alias("cache_hit"),
        req_f.alias("pii_request_findings"),
        resp_f.alias("pii_response_findings"),
        (req_f + resp_f).alias("pii_total_findings"),
        F.col("status").alias("status"),
    )


def write_spans(spans: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K5: export (network exporters are out of scope)."""
    spans.write.mode("overwrite").format(fmt).save(path)
