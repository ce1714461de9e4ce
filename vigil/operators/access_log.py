"""Access-log ETL (C9): S5, X15, X16, J6, W5, O4, P14, P17, P18.

Server log lines arrive as text; an HTTP line opens an entry and later cost
/ PII lines of the same file attach to the latest preceding entry
(a backward as-of with no key). The entry id is a running count of HTTP
lines per file, computed with the skew-safe two-level prefix sum, and the
entry is then one ``groupBy(file, entry_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.formatting import fixed, status_class_log
from vigil.operators.windows import running_sum

# ---------------------------------------------------------------------------
# Line patterns of the log watcher.
# ---------------------------------------------------------------------------
HTTP_LINE = r'INFO:.*"(GET|POST|PUT|DELETE|PATCH) ([^"]+)" (\d+)'
COST_NUMBER = r"cost.*?(\d+\.\d+)"
CHAT_PATH = "/v1/chat/completions"
CHAT_DEFAULT_MODEL = "gpt-3.5-turbo"
KEEP_ENTRIES = 100
SHOW_ENTRIES = 20
# Metadata field names the service writes into its log; parameters, set them
# to your service's names.
COST_MARKER = "_meta_cost"
PII_MARKER = "_meta_pii"
# ---------------------------------------------------------------------------


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a stable order key. Spark packs file splits by
    size, so ``monotonically_increasing_id`` alone does not give line order
    across splits; (file, split start, id within the split) does."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"))


def parse_lines(lines: DataFrame, cost_marker: str = COST_MARKER, pii_marker: str = PII_MARKER) -> DataFrame:
    """X15 + X16 per line."""
    is_http = F.col("line").rlike(HTTP_LINE)
    keep = [c for c in ("block",) if c in lines.columns]
    return lines.select(
        "file", *keep, "line_no",
        is_http.alias("is_http"),
        F.when(is_http, F.regexp_extract("line", HTTP_LINE, 1)).alias("method"),
        F.when(is_http, F.regexp_extract("line", HTTP_LINE, 2)).alias("path"),
        F.when(is_http, F.regexp_extract("line", HTTP_LINE, 3).cast("int")).alias("status"),
        F.when(F.col("line").contains(cost_marker) & F.col("line").rlike(COST_NUMBER),
               F.regexp_extract("line", COST_NUMBER, 1).cast("decimal(18,6)")).alias("cost"),
        F.col("line").contains(pii_marker).alias("is_pii"),
    )


def entries(parsed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """J6 + W5: attach detail lines to the latest preceding HTTP line of the
    same file; lines before the first HTTP line are dropped."""
    order = order or [c for c in ("block", "line_no") if c in parsed.columns]
    # blocks must follow the order: the split start when present, else runs of lines
    block = F.col(order[0]) if len(order) > 1 else F.floor(F.col(order[0]) / 4096)
    d = parsed.withColumn("_h", F.col("is_http").cast("bigint"))
    d = running_sum(d, ["file"], order, {"_h": "entry_id"}, block=block, inclusive=True).drop("_h")
    d = d.where(F.col("entry_id") > 0)
    g = d.groupBy("file", "entry_id").agg(
        F.max_by("line_no", F.col("is_http")).alias("line_no"),
        F.max_by("method", F.col("is_http")).alias("method"),
        F.max_by("path", F.col("is_http")).alias("path"),
        F.max_by("status", F.col("is_http")).alias("status"),
        F.max_by("cost", F.when(F.col("cost").isNotNull(), F.col("line_no"))).alias("cost"),
        F.max(F.when(F.col("is_pii"), 1)).alias("pii_findings"))
    model = F.when(F.col("path").contains(CHAT_PATH), F.lit(CHAT_DEFAULT_MODEL))
    return g.withColumn("model", model)


def describe(entries_df: DataFrame) -> DataFrame:
    """P14 + P17 + P18: status class, description, detail JSON."""
    e = entries_df
    cost_ok = F.coalesce(F.col("cost") != 0, F.lit(False))
    pii_ok = F.coalesce(F.col("pii_findings") != 0, F.lit(False))
    desc = F.concat_ws(" ",
                       F.concat(status_class_log(F.col("status")), F.lit(" "), F.col("status").cast("string")),
                       F.when(cost_ok, F.concat(F.lit("$"), fixed(F.col("cost"), 4))),
                       F.when(pii_ok, F.concat(F.lit("PII "), F.col("pii_findings").cast("string"))))
    tooltip = F.concat_ws("\n",
                          F.concat(F.col("method"), F.lit(" "), F.col("path")),
                          F.concat(F.lit("Status: "), F.col("status").cast("string")),
                          F.when(F.col("model").isNotNull(), F.concat(F.lit("Model: "), F.col("model"))),
                          F.when(cost_ok, F.concat(F.lit("Cost: $"), fixed(F.col("cost"), 6))),
                          F.when(pii_ok, F.concat(F.lit("PII: "), F.col("pii_findings").cast("string"),
                                                  F.lit(" findings"))))
    detail = F.to_json(F.struct(
        F.struct(F.col("method").alias("method"), F.col("path").alias("path"),
                 F.col("status").alias("status")).alias("request"),
        F.struct(F.col("model").alias("model"),
                 F.when(cost_ok, F.concat(F.lit("$"), fixed(F.col("cost"), 6))).otherwise(F.lit("N/A")).alias("cost"),
                 F.coalesce(F.col("pii_findings"), F.lit(0)).alias("piiFindings")).alias("ai"),
        F.struct(F.concat_ws(":", F.col("file"), F.col("line_no").cast("string")).alias("id"),
                 F.lit("N/A").alias("duration")).alias("metadata")))
    return e.select("*", status_class_log(F.col("status")).alias("status_class"),
                    desc.alias("description"), tooltip.alias("tooltip"), detail.alias("detail_json"))


def recent_entries(entries_df: DataFrame, n: int = SHOW_ENTRIES) -> DataFrame:
    """The newest n entries, newest first (a top-n view: the limit is the
    feature)."""
    return entries_df.orderBy(F.col("file").desc(), F.col("entry_id").desc()).limit(n)


def generate_lines(log: DataFrame, cost_marker: str = COST_MARKER, pii_marker: str = PII_MARKER) -> DataFrame:
    """B4 fixture: the service's log for a priced request log, one file per
    day: an HTTP line per request, a cost line when it completed (200) and a
    PII line when findings were reported. Line numbers come from a per-file
    prefix sum of lines per request."""
    d = log.select(
        F.concat(F.lit("access-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")).alias("file"),
        "ts", "request_id", "client_ip", "status", "cost", "pii_findings",
        (1 + (F.col("status") == 200).cast("bigint") + (F.col("pii_findings") > 0).cast("bigint")).alias("nl"))
    d = running_sum(d, ["file"], ["ts", "request_id"], {"nl": "base"}, block=F.date_trunc("minute", F.col("ts")), inclusive=False)
    http = F.struct((F.col("base") + 1).alias("off"), F.concat(
        F.lit("INFO:     "), F.col("client_ip"), F.lit(':5000 - "POST /v1/chat/completions HTTP/1.1" '),
        F.col("status").cast("string")).alias("line"))
    cost = F.when(F.col("status") == 200, F.struct((F.col("base") + 2).alias("off"), F.concat(
        F.lit(f"INFO:     {cost_marker} cost "), F.col("cost").cast("string")).alias("line")))
    pii = F.when(F.col("pii_findings") > 0, F.struct(
        (F.col("base") + 2 + (F.col("status") == 200).cast("bigint")).alias("off"),
        F.lit(f"INFO:     {pii_marker} findings 1").alias("line")))
    return (d.select("file", F.explode(F.array_compact(F.array(http, cost, pii))).alias("l"))
             .select("file", F.col("l.off").alias("line_no"), F.col("l.line").alias("line")))
