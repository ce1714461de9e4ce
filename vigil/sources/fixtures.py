"""Views that shape the given tables into governance inputs.

Each view has a Spark builder and the same definition as SQL text, so the
oracle queries can share it. Every expression is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import cost as fc
from vigil.functions.keys import cache_key, client_id

# ---------------------------------------------------------------------------
# Fixed values of the request-log fixture.
# ---------------------------------------------------------------------------
LOG_MODELS = ["gpt-3.5-turbo", "gpt-4", "gpt-4o-mini", "claude-3-haiku", "unknown-model"]
LOG_STATUSES = [200, 200, 200, 200, 429, 400]
AS_OF = "2024-01-30"
# ---------------------------------------------------------------------------


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def request_log(events: DataFrame) -> DataFrame:
    """B1: one governed request per event."""
    e = F.col("event_id")
    return events.select(
        e.alias("request_id"),
        F.col("ts"),
        F.unix_timestamp("ts").alias("sec"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("client_ip"),
        F.concat(F.lit("agent/"), F.col("user_id").cast("string")).alias("user_agent"),
        _pick(LOG_MODELS, e % 5 + 1).alias("model"),
        _pick(LOG_STATUSES, e % 6 + 1).cast("int").alias("status"),
        (50 + e % 200).cast("bigint").alias("input_tokens"),
        (20 + e % 100).cast("bigint").alias("output_tokens"),
        F.when(e % 7 == 0, F.lit(None)).otherwise(64 * (e % 7)).cast("int").alias("max_tokens"),
        F.when(e % 15 == 0, 1).otherwise(0).cast("int").alias("pii_findings"),
        (e % 8 == 0).alias("cached"),
        F.concat(F.col("event_type"), F.lit(":"),
                 F.get_json_object("props", "$.k")).alias("prompt"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


REQUEST_LOG_SQL = f"""request_log AS (
  SELECT event_id AS request_id, ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec,
         '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS client_ip,
         'agent/' || CAST(user_id AS VARCHAR) AS user_agent,
         ({_sql_list(LOG_MODELS)})[event_id % 5 + 1] AS model,
         CAST(({_sql_list(LOG_STATUSES)})[event_id % 6 + 1] AS INTEGER) AS status,
         CAST(50 + event_id % 200 AS BIGINT) AS input_tokens,
         CAST(20 + event_id % 100 AS BIGINT) AS output_tokens,
         CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE 64 * (event_id % 7) END AS INTEGER) AS max_tokens,
         CAST(CASE WHEN event_id % 15 = 0 THEN 1 ELSE 0 END AS INTEGER) AS pii_findings,
         event_id % 8 = 0 AS cached,
         event_type || ':' || json_extract_string(props, '$.k') AS prompt
  FROM events)"""


def with_client_and_key(log: DataFrame) -> DataFrame:
    """Adds client_id (P1) and cache_key (P2) to the request log. The request
    body is one user message holding ``prompt``; temperature/top_p absent."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return log.withColumn("client_id", client_id(F.col("client_ip"), F.col("user_agent"))) \
              .withColumn("cache_key", cache_key(F.col("model"), msgs, F.lit(None), F.col("max_tokens"),
                                                 F.lit(None)))


CLIENT_ID_SQL = "substr(sha256(coalesce(client_ip, 'unknown') || ':' || coalesce(user_agent, 'unknown')), 1, 16)"


def cache_key_sql() -> str:
    from vigil.functions.keys import sql_json_string
    doc = ("'{\"max_tokens\": ' || coalesce(CAST(max_tokens AS VARCHAR), 'null') || "
           "', \"messages\": [{\"content\": ' || " + sql_json_string("prompt") +
           " || ', \"role\": \"user\"}], \"model\": ' || " + sql_json_string("model") +
           " || ', \"temperature\": 1.0, \"top_p\": 1.0}'")
    return f"sha256({doc})"


KEYED_LOG_SQL = REQUEST_LOG_SQL + f""",
keyed_log AS (
  SELECT *, {CLIENT_ID_SQL} AS client_id, {cache_key_sql()} AS cache_key FROM request_log)"""


# --- B2 chat requests --------------------------------------------------------

def chat_turns(conversations: DataFrame, with_pii: bool = False) -> DataFrame:
    """B2 in flat form: one row per assistant turn with the request's
    aggregates (message count, characters, token estimate) computed as
    running sums over the earlier turns of the conversation.

    The request's message list is the conversation prefix, so materialising
    it is quadratic in conversation length; every report needs only these
    running sums, which the skew-safe two-level prefix sum computes in linear
    work (see operators.windows.running_sum).
    """
    from vigil.functions import pii
    from vigil.operators.windows import running_sum

    extra = []
    values = {"msg_tokens": "input_tokens", "msg_chars": "request_chars", "msg_one": "message_count"}
    if with_pii:
        extra = [F.size(pii.detect(F.col("text"))).cast("bigint").alias("msg_findings")]
        values["msg_findings"] = "request_findings_count"
    turns = conversations.select(
        "conv_id", "turn", "role", "text",
        fc.message_tokens(F.col("role"), F.col("text")).alias("msg_tokens"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("msg_chars"),
        F.lit(1).cast("bigint").alias("msg_one"),
        *extra,
    )
    if with_pii:
        from vigil.session import cut_lineage

        turns = cut_lineage(turns)  # the running sums read their input twice, detection must not
    turns = running_sum(turns, keys=["conv_id"], order="turn", values=values,
                        block=F.floor(F.col("turn") / 64), inclusive=False)
    pii_cols = ([F.col("request_findings_count"), F.col("msg_findings").alias("response_findings_count")]
                if with_pii else [])
    c = F.col("conv_id")
    return turns.where(F.col("role") == "assistant").select(
        F.concat(c.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"),
        "conv_id", "turn",
        _pick(LOG_MODELS, c % 5 + 1).alias("model"),
        F.col("message_count"),
        F.col("request_chars"),
        F.col("input_tokens"),
        F.when(c % 3 == 0, F.lit(None)).otherwise(F.lit(256)).cast("int").alias("max_tokens"),
        F.when(c % 2 == 0, F.lit(None)).otherwise(F.lit(0.7)).cast("double").alias("temperature"),
        F.col("text").alias("response_text"),
        (c % 4 != 0).alias("has_usage"),
        F.when(c % 4 != 0, F.col("input_tokens")).cast("bigint").alias("prompt_tokens"),
        F.when(c % 4 != 0, fc.count_tokens(F.col("text"))).cast("bigint").alias("completion_tokens"),
        *pii_cols,
    )


def chat_turns_sql(src: str = "conversations", with_pii: bool = False) -> str:
    """CTE ``chat_turns``; with_pii expects ``src`` to carry the findings
    list ``f`` of each turn."""
    pii_sum = (",\n      CAST(coalesce(sum(len(f)) OVER w, 0) AS BIGINT) AS request_findings_count"
               if with_pii else "")
    pii_cols = (",\n         request_findings_count, CAST(len(f) AS BIGINT) AS response_findings_count"
                if with_pii else "")
    return f"""chat_turns AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, conv_id, turn,
         ({_sql_list(LOG_MODELS)})[conv_id % 5 + 1] AS model,
         message_count, request_chars, input_tokens,
         CAST(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 256 END AS INTEGER) AS max_tokens,
         CAST(CASE WHEN conv_id % 2 = 0 THEN NULL ELSE 0.7 END AS DOUBLE) AS temperature,
         text AS response_text,
         conv_id % 4 <> 0 AS has_usage,
         CASE WHEN conv_id % 4 <> 0 THEN input_tokens END AS prompt_tokens,
         CASE WHEN conv_id % 4 <> 0 THEN CAST(coalesce(length(text), 0) // 4 AS BIGINT) END AS completion_tokens{pii_cols}
  FROM (
    SELECT *,
      CAST(coalesce(sum(4 + coalesce(length(role), 0) // 4 + coalesce(length(text), 0) // 4) OVER w, 0) AS BIGINT) AS input_tokens,
      CAST(coalesce(sum(coalesce(length(text), 0)) OVER w, 0) AS BIGINT) AS request_chars,
      CAST(count(*) OVER w AS BIGINT) AS message_count{pii_sum}
    FROM {src}
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE role = 'assistant')"""


CHAT_TURNS_SQL = chat_turns_sql()


# --- B3 documents as one-message requests ------------------------------------

def pii_documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text")
