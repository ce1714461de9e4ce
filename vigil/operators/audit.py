"""Declared audit features: suspicious prompt flags (P22) and per-session
JSON export (K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Indicator phrases of the declared prompt analyser.
# ---------------------------------------------------------------------------
SUSPICIOUS_INDICATORS = ["how to hack", "exploit tutorial", "bypass security", "injection payload"]
# ---------------------------------------------------------------------------


def suspicious_prompts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Number of indicator phrases contained in the lower-cased prompt,
    a flag, and a risk level (0 low, 1 medium, 2+ high)."""
    low = F.lower(F.col(text_col))
    hits = sum(F.when(F.coalesce(low.contains(k), F.lit(False)), 1).otherwise(0)
               for k in SUSPICIOUS_INDICATORS)
    return (df.withColumn("hits", hits.cast("int"))
              .withColumn("suspicious", F.col("hits") > 0)
              .withColumn("risk_level", F.when(F.col("hits") >= 2, "high")
                          .when(F.col("hits") == 1, "medium").otherwise("low")))


def sql_indicator_hits(col: str) -> str:
    return " + ".join(f"CASE WHEN coalesce(contains(lower({col}), '{k}'), false) THEN 1 ELSE 0 END"
                      for k in SUSPICIOUS_INDICATORS)


def export_session_audit(records: DataFrame, path: str, session_col: str = "session_id") -> None:
    """K6: one JSON document per governed request, folders per session."""
    body = [c for c in records.columns if c != session_col]
    (records.select(session_col, F.to_json(F.struct(*body)).alias("value"))
            .write.mode("overwrite").partitionBy(session_col).text(path))
