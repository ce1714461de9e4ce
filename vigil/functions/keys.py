"""Identity keys: client id (P1) and response-cache key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def client_id(client_ip: Column, user_agent: Column) -> Column:
    """First 16 hex chars of sha256(ip + ':' + user_agent); missing parts
    read as 'unknown'."""
    raw = F.concat_ws(":", F.coalesce(client_ip, F.lit("unknown")),
                      F.coalesce(user_agent, F.lit("unknown")))
    return F.substring(F.sha2(raw, 256), 1, 16)


def _u(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code.cast("bigint"))), 4, "0"))


def json_string(s: Column) -> Column:
    """JSON string literal in ASCII: backslash, quote and control characters
    escaped, all else outside space..~ as \\uXXXX (surrogate pairs beyond the
    basic plane). NULL becomes the JSON null."""
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for a, b in [('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]:
        esc = F.replace(esc, F.lit(a), F.lit(b))

    def one(c):
        code = F.ascii(c)
        high = code - 0x10000
        return (F.when((code >= 32) & (code < 127), c).when(code < 0x10000, _u(code))
                .otherwise(F.concat(_u(F.floor(high / 1024) + 0xD800), _u(high % 1024 + 0xDC00))))

    esc = F.when(esc.rlike("[^ -~]"), F.array_join(F.transform(F.split(esc, ""), one), "")).otherwise(esc)
    return F.coalesce(F.concat(F.lit('"'), esc, F.lit('"')), F.lit("null"))


def _json_number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def canonical_request_json(model: Column, messages: Column, temperature: Column,
                           max_tokens: Column, top_p: Column) -> Column:
    """The cache-key document: sorted keys, ', ' and ': ' separators, absent
    temperature/top_p as 1.0, absent max_tokens as null."""
    msgs = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit('{"content": '), json_string(m["content"]),
        F.lit(', "role": '), json_string(m["role"]), F.lit("}"))), ", ")
    return F.concat(
        F.lit('{"max_tokens": '), _json_number(max_tokens),
        F.lit(', "messages": ['), F.coalesce(msgs, F.lit("")), F.lit("]"),
        F.lit(', "model": '), json_string(model),
        F.lit(', "temperature": '), _json_number(F.coalesce(temperature.cast("double"), F.lit(1.0))),
        F.lit(', "top_p": '), _json_number(F.coalesce(top_p.cast("double"), F.lit(1.0))),
        F.lit("}"))


def cache_key(model: Column, messages: Column, temperature: Column,
              max_tokens: Column, top_p: Column) -> Column:
    """sha256 of the canonical request document."""
    return F.sha2(canonical_request_json(model, messages, temperature, max_tokens, top_p), 256)


def sql_json_string(expr: str) -> str:
    """The same literal as DuckDB SQL."""
    esc = expr
    for a, b in [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(8)", "'\\b'"), ("chr(12)", "'\\f'")]:
        esc = f"replace({esc}, {a}, {b})"
    u = "'\\u' || lpad(lower(to_hex({})), 4, '0')"
    one = (f"CASE WHEN ord(c) BETWEEN 32 AND 126 THEN c WHEN ord(c) < 65536 THEN {u.format('ord(c)')} "
           f"ELSE {u.format('(ord(c) - 65536) // 1024 + 55296')} || {u.format('(ord(c) - 65536) % 1024 + 56320')} END")
    esc = (f"CASE WHEN regexp_matches({esc}, '[^ -~]') THEN list_aggregate(list_transform(regexp_extract_all({esc}, '(?s).'), lambda c: {one}), 'string_agg', '') "
           f"ELSE {esc} END")
    return f"coalesce('\"' || {esc} || '\"', 'null')"
