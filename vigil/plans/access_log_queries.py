"""Access-log ETL queries over log lines generated from the request log."""

from __future__ import annotations

from vigil.functions.cost import sql_cost
from vigil.operators import access_log as al
from vigil.operators import costs
from vigil.plans.registry import query
from vigil.sources import dims, fixtures
from vigil.session import cut_lineage
from vigil.sources.tables import read_table

P_IN = "coalesce(p.input_per_1k, CAST(0.0005 AS DECIMAL(12,8)))"
P_OUT = "coalesce(p.output_per_1k, CAST(0.0015 AS DECIMAL(12,8)))"


def lines(spark, sf_dir):
    """The generated log, written once to the checkpoint folder: in
    production the lines are a text scan, and the entry attachment reads
    its input twice (two-level running count)."""
    log = costs.price_requests(fixtures.request_log(read_table(spark, sf_dir, "events")))
    return cut_lineage(al.generate_lines(log))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINES_SQL = fixtures.REQUEST_LOG_SQL + f""",
ev AS (
  SELECT 'access-' || strftime(ts, '%Y-%m-%d') || '.log' AS file, ts, request_id, client_ip, status, pii_findings,
         {sql_cost('input_tokens', 'output_tokens', P_IN, P_OUT)} AS cost,
         1 + CAST(status = 200 AS BIGINT) + CAST(pii_findings > 0 AS BIGINT) AS nl
  FROM request_log LEFT JOIN {dims.sql_pricing_values('p', 'p_model')} ON model = p_model),
ev2 AS (SELECT *, coalesce(sum(nl) OVER (PARTITION BY file ORDER BY ts, request_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ev),
lines AS (
  SELECT file, CAST(base + 1 AS BIGINT) AS line_no,
         'INFO:     ' || client_ip || ':5000 - "POST /v1/chat/completions HTTP/1.1" ' || status AS line FROM ev2
  UNION ALL
  SELECT file, CAST(base + 2 AS BIGINT), 'INFO:     {al.COST_MARKER} cost ' || CAST(cost AS VARCHAR) FROM ev2 WHERE status = 200
  UNION ALL
  SELECT file, CAST(base + 2 + CAST(status = 200 AS BIGINT) AS BIGINT), 'INFO:     {al.PII_MARKER} findings 1'
  FROM ev2 WHERE pii_findings > 0),
parsed AS (
  SELECT file, line_no, regexp_matches(line, {_q(al.HTTP_LINE)}) AS is_http,
         regexp_extract(line, {_q(al.HTTP_LINE)}, 1) AS method,
         regexp_extract(line, {_q(al.HTTP_LINE)}, 2) AS path,
         TRY_CAST(regexp_extract(line, {_q(al.HTTP_LINE)}, 3) AS INTEGER) AS status,
         CASE WHEN contains(line, '{al.COST_MARKER}') AND regexp_matches(line, {_q(al.COST_NUMBER)})
              THEN CAST(regexp_extract(line, {_q(al.COST_NUMBER)}, 1) AS DECIMAL(18,6)) END AS cost,
         contains(line, '{al.PII_MARKER}') AS is_pii
  FROM lines),
ent AS (SELECT *, sum(CAST(is_http AS BIGINT)) OVER (PARTITION BY file ORDER BY line_no) AS entry_id FROM parsed),
entries AS (
  SELECT file, entry_id, max(line_no) FILTER (WHERE is_http) AS line_no,
         max(method) FILTER (WHERE is_http) AS method, max(path) FILTER (WHERE is_http) AS path,
         max(status) FILTER (WHERE is_http) AS status,
         arg_max(cost, line_no) FILTER (WHERE cost IS NOT NULL) AS cost,
         max(CASE WHEN is_pii THEN 1 END) AS pii_findings
  FROM ent WHERE entry_id > 0 GROUP BY file, entry_id)"""

_SELECT = f"""SELECT file, entry_id, line_no, method, path, status, cost, pii_findings,
       CASE WHEN contains(path, '{al.CHAT_PATH}') THEN '{al.CHAT_DEFAULT_MODEL}' END AS model
FROM entries"""


@query("access_log_entries", f"WITH {LINES_SQL}\n{_SELECT}")
def access_log_entries(spark, sf_dir):
    e = al.entries(al.parse_lines(lines(spark, sf_dir)))
    return e.select("file", "entry_id", "line_no", "method", "path", "status", "cost", "pii_findings", "model")


@query("recent_log_entries", f"""WITH {LINES_SQL},
sel AS ({_SELECT}),
d AS (SELECT *,
  CASE WHEN status >= 400 THEN 'error' WHEN status >= 300 THEN 'warning' ELSE 'ok' END AS status_class FROM sel)
SELECT file, entry_id, status, status_class,
  concat_ws(' ', status_class || ' ' || status,
            CASE WHEN coalesce(cost <> 0, false) THEN '$' || printf('%.4f', CAST(round(cost, 4) AS DOUBLE)) END,
            CASE WHEN coalesce(pii_findings <> 0, false) THEN 'PII ' || pii_findings END) AS description
FROM d ORDER BY file DESC, entry_id DESC LIMIT {al.SHOW_ENTRIES}""")
def recent_log_entries(spark, sf_dir):
    e = al.describe(al.entries(al.parse_lines(lines(spark, sf_dir))))
    return al.recent_entries(e).select("file", "entry_id", "status", "status_class", "description")


@query("access_log_details", f"""WITH {LINES_SQL},
sel AS ({_SELECT})
SELECT file, entry_id,
  '{{"request":{{"method":"' || method || '","path":"' || path || '","status":' || status || '}},"ai":{{' ||
  coalesce('"model":"' || model || '",', '') || '"cost":"' ||
  CASE WHEN coalesce(cost <> 0, false) THEN '$' || printf('%.6f', CAST(cost AS DOUBLE)) ELSE 'N/A' END ||
  '","piiFindings":' || coalesce(pii_findings, 0) || '}},"metadata":{{"id":"' || file || ':' || line_no || '","duration":"N/A"}}}}' AS detail_json
FROM sel""")
def access_log_details(spark, sf_dir):
    """The detail document of every entry."""
    return al.describe(al.entries(al.parse_lines(lines(spark, sf_dir)))).select("file", "entry_id", "detail_json")
