"""PII queries over ``documents`` (each document is a one-message request)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import pii
from vigil.operators import pii_scan
from vigil.plans.registry import query
from vigil.session import spread
from vigil.sources import dims
from vigil.sources.tables import read_table

# The file-default policy's entity list (used by the block queries).
FILE_DEFAULT_ENTITIES = ["email", "phone", "ssn", "credit_card"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_spans(kind: str, m: str, s: str) -> str:
    start = (f"CAST(coalesce(list_sum(list_transform(list_slice({s}, 1, i), lambda y: length(y))), 0) + "
             f"coalesce(list_sum(list_transform(list_slice({m}, 1, i - 1), lambda y: length(y))), 0) AS INTEGER)")
    return (f"list_transform({m}, lambda x, i: {{'type': '{kind}', 'text': x, "
            f"'start': {start}, 'end': {start} + CAST(length(x) AS INTEGER)}})")


def found_sql(entities: list[str] | None = None,
              src: str = "SELECT doc_id, text FROM documents", repeats: bool = False) -> str:
    """CTEs ``pii_arr`` and ``pii_found(<src columns>, f)`` with f the sorted
    findings list of ``text`` (RE2 dialect: no (?U); same matches on this
    data)."""
    names = "[" + ", ".join(_q(n) for n in dims.COMMON_NAMES) + "]"
    cols, spans = [], []
    kinds = [k for k, _ in pii.PATTERNS]
    for n, kind in enumerate(kinds):
        pat = pii.PATTERN_OF[kind]
        cols.append(f"regexp_extract_all(text, {_q(pat)}, 0) AS m{n}, "
                    f"regexp_split_to_array(text, {_q(pat)}) AS s{n}")
        if entities is None or kind in entities:
            spans.append(_sql_spans(kind, f"m{n}", f"s{n}"))
    if entities is None or "person_name" in entities:
        # each token that is a listed name without its punctuation, searched as a whole word, punctuation and all
        per = _sql_spans("person_name", "w.m", "w.s")
        spans.append(f"flatten(list_transform(list_transform(bare, lambda b: {{'m': regexp_extract_all(text, '(?i)\\b' || regexp_escape(b) || '\\b'), "
                     f"'s': regexp_split_to_array(text, '(?i)\\b' || regexp_escape(b) || '\\b')}}), lambda w: {per}))")
    once = "" if repeats else "list_position(ws, w) = i AND "
    return f"""pii_arr AS (
  SELECT *, {', '.join(cols)},
         list_filter(ws, lambda w, i: {once}list_contains({names}, regexp_replace(w, '[^\\pL\\pN_]', '', 'g'))) AS bare
  FROM (SELECT *, string_split_regex(lower(text), '[\\s\\pZ\\x1c-\\x1f]+') AS ws FROM ({src}))),
pii_found AS (
  SELECT * EXCLUDE ({', '.join(f'm{n}, s{n}' for n in range(len(kinds)))}, ws, bare),
         list_transform(list_sort(list_transform(list_concat({', '.join(spans)}),
             lambda f, i: {{'s': f.start, 'i': i, 'f': f}})),
             lambda k: k.f) AS f
  FROM pii_arr)"""


def _sql_redaction(x: str) -> str:
    toks = " ".join(f"WHEN {x}.type = {_q(k)} THEN {_q(v)}" for k, v in pii.REDACTION_TOKENS.items())
    return (f"CASE WHEN {x}.type = 'email' THEN left(split_part({x}.text, '@', 1), 2) || {_q(pii.EMAIL_MASK_SUFFIX)} "
            f"WHEN {x}.type = 'credit_card' THEN {_q(pii.CARD_MASK_PREFIX)} || "
            f"right(regexp_replace({x}.text, '\\D', '', 'g'), 4) {toks} "
            f"ELSE '[' || upper({x}.type) || ']' END")


def _sql_hashed(x: str) -> str:
    return f"'[' || {x}.type || ':' || left(sha256({x}.text), 8) || ']'"


def rewritten_sql(repl) -> str:
    """Overlap merge then left-to-right splice, as list_reduce folds."""
    rank = "[" + ", ".join(_q(t) for t in dims.PII_TYPES) + "]"
    merged = (f"list_reduce(list_sort(list_transform(f, lambda g: {{'s': g.start, 'ne': -g.end, "
              f"'r': list_position({rank}, g.type), 'f': g}})), "
              f"lambda a, k: CASE WHEN k.s >= a.last THEN {{'last': k.f.end, 'kept': list_append(a.kept, k.f)}} "
              f"ELSE a END, {{'last': -1, 'kept': []::STRUCT(type VARCHAR, text VARCHAR, \"start\" INTEGER, \"end\" INTEGER)[]}}).kept")
    splice = (f"list_reduce({merged}, lambda a, x: {{'out': a.out || substring(text, a.pos + 1, x.start - a.pos) "
              f"|| {repl('x')}, 'pos': x.end}}, {{'out': '', 'pos': 0}})")
    return (f"CASE WHEN len(f) = 0 THEN text ELSE "
            f"(SELECT r.out || substring(text, r.pos + 1) FROM (SELECT {splice} AS r)) END")


def docs(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("pii_scan_documents", f"""WITH {found_sql()}
SELECT doc_id, CAST(o - 1 AS INTEGER) AS ord, x.type AS pii_type, x.text AS pii_text,
       x.start AS pii_start, x."end" AS pii_end
FROM (SELECT doc_id, unnest(f) AS x, generate_subscripts(f, 1) AS o FROM pii_found)""")
def pii_scan_documents(spark, sf_dir):
    return pii_scan.findings_rows(pii_scan.scan_texts(docs(spark, sf_dir)), "doc_id")


@query("pii_counts_by_type", f"""WITH {found_sql()}
SELECT x.type AS pii_type, count(*) AS findings, count(DISTINCT doc_id) AS documents
FROM (SELECT doc_id, unnest(f) AS x FROM pii_found) GROUP BY x.type""")
def pii_counts_by_type(spark, sf_dir):
    kinds = F.transform("findings", lambda f: f["type"])
    d = pii_scan.scan_texts(docs(spark, sf_dir)).select(kinds.alias("k"))  # counted per document before the explode: one shuffle, by type
    each = F.transform(F.array_distinct("k"), lambda t: F.struct(t.alias("pii_type"), F.size(F.filter("k", lambda x: x == t)).alias("n")))
    per_doc = d.select(F.explode_outer(each).alias("x")).where("x IS NOT NULL").select("x.*")
    return per_doc.groupBy("pii_type").agg(F.sum("n").alias("findings"),
                                           F.count(F.lit(1)).alias("documents"))


@query("pii_redact_documents", f"""WITH {found_sql()}
SELECT doc_id, CAST(len(f) AS INTEGER) AS findings, {rewritten_sql(_sql_redaction)} AS redacted
FROM pii_found""")
def pii_redact_documents(spark, sf_dir):
    d = pii_scan.scan_texts(docs(spark, sf_dir))
    return d.select("doc_id", F.size("findings").cast("int").alias("findings"),
                    pii.redact_text(F.col("text"), F.col("findings")).alias("redacted"))


@query("pii_hash_documents", f"""WITH {found_sql()}
SELECT doc_id, CAST(len(f) AS INTEGER) AS findings, {rewritten_sql(_sql_hashed)} AS hashed
FROM pii_found""")
def pii_hash_documents(spark, sf_dir):
    d = pii_scan.scan_texts(docs(spark, sf_dir))
    return d.select("doc_id", F.size("findings").cast("int").alias("findings"),
                    pii.hash_text(F.col("text"), F.col("findings")).alias("hashed"))


@query("pii_request_block", f"""WITH {found_sql(FILE_DEFAULT_ENTITIES)}
SELECT doc_id, len(f) > 0 AS blocked,
       CAST(CASE WHEN len(f) > 0 THEN 400 ELSE 200 END AS INTEGER) AS status,
       CASE WHEN len(f) > 0 THEN 'PII detected in request: ' || len(f) || ' instances found' END AS reason,
       CAST(len(f) AS INTEGER) AS findings
FROM pii_found""")
def pii_request_block(spark, sf_dir):
    reqs = docs(spark, sf_dir).select(
        "doc_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    r = pii_scan.scan_request(reqs, "block", FILE_DEFAULT_ENTITIES)
    return r.select("doc_id", F.col("pii_blocked").alias("blocked"),
                    F.when(F.col("pii_blocked"), 400).otherwise(200).cast("int").alias("status"),
                    F.col("pii_reason").alias("reason"),
                    F.size("request_findings").cast("int").alias("findings"))


@query("pii_response_block", f"""WITH {found_sql(FILE_DEFAULT_ENTITIES)}
SELECT doc_id, len(f) > 0 AS blocked,
       CASE WHEN len(f) > 0 THEN {_q(dims.RESPONSE_BLOCKED_TEXT)} ELSE text END AS content,
       CAST(len(f) AS INTEGER) AS findings
FROM pii_found""")
def pii_response_block(spark, sf_dir):
    resp = docs(spark, sf_dir).select(
        "doc_id", F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    r = pii_scan.scan_response(resp, "block", FILE_DEFAULT_ENTITIES)
    return r.select("doc_id", (F.size("response_findings") > 0).alias("blocked"),
                    F.try_element_at("choices", F.lit(1))["message"]["content"].alias("content"),
                    F.size("response_findings").cast("int").alias("findings"))


def reference_splice_sql(repl) -> str:
    """The original right-to-left splice over every finding (stale offsets
    after an overlap included), as one list_reduce."""
    return (f"CASE WHEN len(f) = 0 THEN text ELSE list_reduce(list_reverse(f), "
            f"lambda acc, x: substring(acc, 1, x.start) || {repl('x')} || substring(acc, x.\"end\" + 1), text) END")


@query("pii_redact_documents_reference", f"""WITH {found_sql(repeats=True)}
SELECT doc_id, CAST(len(f) AS INTEGER) AS findings, {reference_splice_sql(_sql_redaction)} AS redacted
FROM pii_found""")
def pii_redact_documents_reference(spark, sf_dir):
    """X10 with ``overlap='reference'``: every finding, a name's once per token
    as the original records them, spliced right to left with stale offsets."""
    d = docs(spark, sf_dir).withColumn("findings", pii.detect(F.col("text"), repeats=True))
    return d.select("doc_id", F.size("findings").cast("int").alias("findings"),
                    pii.redact_text(F.col("text"), F.col("findings"), "reference").alias("redacted"))


@query("pii_findings_report", f"""WITH {found_sql(FILE_DEFAULT_ENTITIES)}
SELECT doc_id, 'messages[0].content' AS location, x.type AS pii_type, '[REDACTED]' AS reported_text,
       x.start AS pii_start, x."end" AS pii_end
FROM (SELECT doc_id, unnest(f) AS x FROM pii_found)""")
def pii_findings_report(spark, sf_dir):
    """M5 / P5: the findings report of a redact-action request scan (raw
    text is reported only for the warn action)."""
    reqs = docs(spark, sf_dir).select(
        "doc_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    r = pii_scan.scan_request(reqs, "redact", FILE_DEFAULT_ENTITIES)
    rows = r.select("doc_id", F.explode_outer("request_findings").alias("x")).where(F.col("x").isNotNull())
    return rows.select("doc_id", F.col("x.location").alias("location"), F.col("x.type").alias("pii_type"),
                       F.col("x.text").alias("reported_text"), F.col("x.position.start").alias("pii_start"),
                       F.col("x.position.end").alias("pii_end"))


# Texts that hold every family: made from customers' keys, so that they grow with the table. the
# text's parts; names with inner punctuation, repeats, and a name inside an address included.
_NAMES_AT = "([" + ", ".join(_q(n) for n in dims.COMMON_NAMES) + f"])[c_custkey % {len(dims.COMMON_NAMES)} + 1]"
_DIGITS = "right('0000000000' || CAST(c_custkey * 7919 AS VARCHAR), 10)"
CUSTOMER_TEXT_SQL = f"""SELECT c_custkey AS doc_id, CASE c_custkey % 8
  WHEN 0 THEN 'Ask ' || n || ' or ' || upper(n) || '. Write to ' || n || '.' || c_custkey || '@mail.example.com'
  WHEN 1 THEN 'ssn ' || left(d, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4) || ' of (' || n || ')'
  WHEN 2 THEN 'sk-' || repeat(left(d, 8), 6) || ' and pk_' || repeat(left(d, 8), 4)
  WHEN 3 THEN 'key AKIA' || upper(left(sha256(d), 16)) || ' from 10.' || c_custkey % 256 || '.0.7 for ' || left(n, 1) || '.' || substr(n, 2)
  WHEN 4 THEN 'call (' || left(d, 3) || ') ' || substr(d, 4, 3) || '-' || right(d, 4) || ', ' || n || '! ' || n
  WHEN 5 THEN 'card 4' || left(d, 3) || ' ' || right(d, 4) || ' ' || left(d, 4) || ' ' || right(d, 4) || ' ok'
  WHEN 6 THEN 'Authorization: Bearer ' || left(sha256(d), 20) || ' é ' || n || ', ' || n || '.x'
  ELSE c_name || ' says nothing' END AS text
FROM (SELECT *, {_NAMES_AT} AS n, {_DIGITS} AS d FROM customer)"""


def customer_texts(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c = c.withColumn("n", F.element_at(dims.names_array(), (F.col("c_custkey") % len(dims.COMMON_NAMES) + 1).cast("int")))
    c = c.withColumn("d", F.expr("right('0000000000' || CAST(c_custkey * 7919 AS STRING), 10)"))
    case = CUSTOMER_TEXT_SQL.split("doc_id, ", 1)[1].rsplit(" AS text", 1)[0].replace("sha256(d)", "sha2(d, 256)")
    return c.select(F.col("c_custkey").alias("doc_id"), F.expr(case).alias("text"))


@query("pii_scan_customer_texts", f"""WITH {found_sql(src=CUSTOMER_TEXT_SQL)}
SELECT doc_id, CAST(o - 1 AS INTEGER) AS ord, x.type AS pii_type, x.text AS pii_text,
       x.start AS pii_start, x."end" AS pii_end
FROM (SELECT doc_id, unnest(f) AS x, generate_subscripts(f, 1) AS o FROM pii_found)""")
def pii_scan_customer_texts(spark, sf_dir):
    return pii_scan.findings_rows(pii_scan.scan_texts(customer_texts(spark, sf_dir)), "doc_id")


@query("pii_redact_customer_texts_reference", f"""WITH {found_sql(src=CUSTOMER_TEXT_SQL, repeats=True)}
SELECT doc_id, CAST(len(f) AS INTEGER) AS findings, {reference_splice_sql(_sql_redaction)} AS redacted
FROM pii_found""")
def pii_redact_customer_texts_reference(spark, sf_dir):
    d = customer_texts(spark, sf_dir).withColumn("findings", pii.detect(F.col("text"), repeats=True))
    return d.select("doc_id", F.size("findings").cast("int").alias("findings"),
                    pii.redact_text(F.col("text"), F.col("findings"), "reference").alias("redacted"))
