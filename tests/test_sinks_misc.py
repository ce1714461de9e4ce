"""Sinks and smaller operators: spans export, session audit export, cache
lookup against a table, policy change detection."""

import datetime as dt
import glob
import os
import tempfile

from vigil.operators import audit, cache, policy, spans


def test_spans_defaults_and_export(spark):
    df = spark.createDataFrame(
        [("gpt-4", None, 2, None, None, 30, None, None, None, None, 1, 0, "OK")],
        "model string, request_id string, message_count int, max_tokens int, temperature double, "
        "request_chars long, prompt_tokens long, completion_tokens long, cost decimal(18,6), cache_hit boolean, "
        "request_findings_count long, response_findings_count long, status string")
    s = spans.request_spans(df)
    r = s.first()
    assert r.llm_request_id == "unknown" and r.llm_max_tokens == 0 and r.llm_temperature == 1.0
    assert r.llm_prompt_tokens == 0 and r.pii_total_findings == 1 and r.cache_hit is False
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-spans-"), "s")
    spans.write_spans(s, out, "json")
    assert spark.read.json(out).count() == 1


def test_session_audit_export(spark):
    df = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s2", 3, "c")],
                               "session_id string, request_id int, model string")
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-audit-"), "a")
    audit.export_session_audit(df, out)
    assert sorted(os.path.basename(p) for p in glob.glob(os.path.join(out, "session_id=*"))) == \
        ["session_id=s1", "session_id=s2"]
    assert spark.read.text(os.path.join(out, "session_id=s1")).count() == 2


def test_cache_lookup_against_table(spark):
    t0 = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([("k", t0, t0 + dt.timedelta(hours=1))],
                                  "cache_key string, stored_at timestamp, expires_at timestamp")
    reqs = spark.createDataFrame([(1, "k", t0 + dt.timedelta(minutes=59)), (2, "k", t0 + dt.timedelta(hours=1)),
                                  (3, "j", t0)], "request_id int, cache_key string, ts timestamp")
    got = {r.request_id: r.cache_hit for r in cache.lookup(reqs, table).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert cache.glob_to_regex("ab*c?[xy]") == "^ab.*c.[xy]$"


def test_policy_changed(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(minutes=5))], "policy_name string, modified timestamp")
    assert df.agg(policy.policy_changed(df, t + dt.timedelta(minutes=1)).alias("c")).first().c is True
    assert df.agg(policy.policy_changed(df, t + dt.timedelta(minutes=10)).alias("c")).first().c is False
