"""Request/response PII scanning (C1, C2, P3, P6, P7) over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import pii
from vigil.sources import dims

BLOCK_REASON = dims.PII_BLOCK_REASON


def scan_texts(df: DataFrame, text_col: str = "text", entities: list[str] | None = None) -> DataFrame:
    """Adds ``findings`` (sorted; only the listed types are searched) for a
    text column. A narrow map over the scan: size the splits of CPU-heavy
    text with ``spark.sql.files.maxPartitionBytes``."""
    return df.withColumn("findings", pii.detect(F.col(text_col), entities or None))


def findings_rows(df: DataFrame, id_col: str) -> DataFrame:
    """One row per finding: id, ord, pii_type, pii_text, pii_start, pii_end.

    ``posexplode_outer`` + a filter on its output: the inner form makes
    Catalyst infer ``size(findings) > 0`` and push it below the scan's
    repartition, which would run the whole detection twice."""
    return (df.select(id_col, F.posexplode_outer("findings").alias("ord", "f"))
              .where(F.col("f").isNotNull())
              .select(id_col, F.col("ord").cast("int").alias("ord"),
                      F.col("f.type").alias("pii_type"), F.col("f.text").alias("pii_text"),
                      F.col("f.start").alias("pii_start"), F.col("f.end").alias("pii_end")))


def searched(text: Column, entities: list[str] | Column | None) -> Column:
    """A literal entity list limits the search itself; a column filters afterwards."""
    if entities is None or isinstance(entities, list):
        return pii.detect(text, entities or None)
    return pii.filter_entities(pii.detect(text), entities)


@pii._memo
def message_scan(messages: Column, entities: list[str] | None = None) -> Column:
    """Per message of a messages array: role, content, index and its
    sorted, entity-filtered findings (one row per request, P3)."""
    return F.transform(messages, lambda m, i: F.struct(
        m["role"].alias("role"), m["content"].alias("content"), i.alias("idx"),
        searched(m["content"], entities).alias("findings")))


def scan_request(requests: DataFrame, action: str | Column = "warn",
                 entities: list[str] | Column | None = None, overlap: str = "merge") -> DataFrame:
    """C1 on chat requests with a ``messages`` ARRAY<STRUCT<role, content>>.

    Adds per-message findings (P3 keeps one row per request via transform),
    the report (M5), rewritten messages, and the block decision (P6: the
    reason counts the first offending message only)."""
    act = F.lit(action) if isinstance(action, str) else action
    d = requests.withColumn("_scan", message_scan(F.col("messages"), entities))
    report = F.flatten(F.transform(F.col("_scan"), lambda s: pii.report(
        s["findings"], F.format_string("messages[%d].content", s["idx"]), act)))
    first_bad = F.try_element_at(F.filter(F.col("_scan"), lambda s: F.size(s["findings"]) > 0), F.lit(1))
    blocked = (act == "block") & first_bad.isNotNull()
    new_msgs = F.transform(F.col("_scan"), lambda s: F.struct(
        s["role"].alias("role"),
        pii.apply_action(s["content"], s["findings"], act, overlap).alias("content")))
    return (d.withColumn("request_findings", report)
             .withColumn("pii_blocked", F.coalesce(blocked, F.lit(False)))
             .withColumn("pii_reason", F.when(blocked, F.format_string(BLOCK_REASON, F.size(first_bad["findings"]))))
             .withColumn("messages", new_msgs)
             .drop("_scan"))


def scan_response(responses: DataFrame, action: str | Column = "warn",
                  entities: list[str] | Column | None = None, overlap: str = "merge") -> DataFrame:
    """C2 on ``choices`` ARRAY<STRUCT<message STRUCT<content>>>: block
    replaces the content with the fixed sentence (P7); the request still
    succeeds."""
    act = F.lit(action) if isinstance(action, str) else action
    per = F.transform(F.col("choices"), lambda c, i: F.struct(
        c["message"]["content"].alias("content"), i.alias("idx"),
        searched(c["message"]["content"], entities).alias("findings")))
    d = responses.withColumn("_scan", per)
    report = F.flatten(F.transform(F.col("_scan"), lambda s: pii.report(
        s["findings"], F.format_string("choices[%d].message.content", s["idx"]), act)))
    new_choices = F.transform(F.col("_scan"), lambda s: F.struct(F.struct(
        F.when((act == "block") & (F.size(s["findings"]) > 0), F.lit(dims.RESPONSE_BLOCKED_TEXT))
         .otherwise(pii.apply_action(s["content"], s["findings"], act, overlap)).alias("content")
    ).alias("message")))
    return (d.withColumn("response_findings", report)
             .withColumn("choices", new_choices)
             .drop("_scan"))
