"""Findings, rewriting and request/response handling, over texts made from a small grammar of cases."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import pii
from vigil.operators import pii_scan

# (text, findings as (type, matched text)); offsets are checked by slicing the text
CASES = [
    ("Rechnung an k.lang+abo@post.example.net, bitte", [("email", "k.lang+abo@post.example.net")]),
    ("two: a1@b.io;zz_9@q-r.example", [("email", "a1@b.io"), ("email", "zz_9@q-r.example")]),
    ("ring 212 555 0187 oder (646)555-0199", [("phone", "212 555 0187"), ("phone", "(646)555-0199")]),
    ("id 219-09-9999 in the file", [("ssn", "219-09-9999")]),
    ("gateway 172.16.254.1 is up", [("ip_address", "172.16.254.1")]),
    ("sk-" + "a1B2" * 12 + " leaked", [("api_key", "sk-" + "a1B2" * 12)]),
    ("pk_" + "9z" * 16, [("api_key", "pk_" + "9z" * 16)]),
    ("Authorization: Bearer eyJ.abc_def-9", [("api_key", "Bearer eyJ.abc_def-9")]),
    ("AKIA" + "Q7" * 8 + "!", [("aws_key", "AKIA" + "Q7" * 8)]),
    ("aws_access_key_id = " + "ZX" * 10, [("aws_key", "aws_access_key_id = " + "ZX" * 10)]),
    ("garcia met Garcia", [("person_name", "garcia"), ("person_name", "Garcia")]),
    ("ta.ylor then mo-ore", [("person_name", "ta.ylor"), ("person_name", "mo-ore")]),
    ("(wilson) says nothing", []),  # a bracket is no word boundary after a space
    ("Davis. davis.com", [("person_name", "davis."), ]),
    ("wilsonia and thomasville", []),
    ("日本の john さん 😀 10.1.2.3", [("person_name", "john"), ("ip_address", "10.1.2.3")]),
    ("nothing here: 12, 3.14, v1.2", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    return {r.i: r.f for r in df.select("i", pii.detect(F.col("text")).alias("f")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_findings(found, i):
    text, want = CASES[i]
    got = found[i]
    assert [(f.type, f.text) for f in got if (f.type, f.text) in want] == want
    assert all(text[f.start:f.end] == f.text for f in got)
    assert len(got) == len(want) or want  # a case without findings has none


def _rewritten(spark, texts, fn, **opt):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = df.select("i", "text", pii.detect(F.col("text"), **opt).alias("f")).select("i", fn(F.col("text"), F.col("f")).alias("r")).collect()
    return [r.r for r in sorted(out)]


def test_masks(spark):
    texts = ["to k.lang@post.example.net.", "pay 5500 0000 0000 0004 now", "é 😀 219-09-9999 ü", "x", "10.9.8.7 10.9.8.7"]
    assert _rewritten(spark, texts, pii.redact_text) == [
        "to k.***@***.***.", "pay ****-****-****-0004 now", "é 😀 [SSN] ü", "x", "[IP_ADDRESS] [IP_ADDRESS]"]
    hashed = _rewritten(spark, texts, pii.hash_text)
    assert hashed[0].startswith("to [email:") and hashed[3] == "x" and len(set(hashed[4].split())) == 1


def test_reference_mode_keeps_every_record_and_stale_offsets(spark):
    # each of two equal name tokens records both places; the later copies are spliced at offsets already moved
    ref = lambda t, f: pii.redact_text(t, f, "reference")
    assert _rewritten(spark, ["john met john"], ref, repeats=True) == ["[NAME]E] met [NAME]E]"]
    assert _rewritten(spark, ["john met john"], pii.redact_text) == ["[NAME] met [NAME]"]


def test_families_limit_the_search(spark):
    df = spark.createDataFrame([("q@r.example 10.1.2.3 martin",)], "text string")
    kinds = lambda fam: [x.type for x in df.select(pii.detect(F.col("text"), fam).alias("f")).first().f]
    assert kinds(["ip_address"]) == ["ip_address"] and kinds(["person_name", "email"]) == ["email", "person_name"]
    assert len(kinds(None)) == len(kinds([])) == 3


def test_rewriting_long_texts_is_linear(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("é u.v@w.example " * n,)], "text string").select("text", pii.detect(F.col("text"), ["email"]).alias("f"))
        t0 = time.perf_counter()
        assert df.select(pii.redact_text(F.col("text"), F.col("f")).alias("r")).first().r == "é u.***@***.*** " * n
        return time.perf_counter() - t0

    seconds(100)
    small, large = seconds(1500), seconds(6000)
    assert large < 9 * max(small, 0.4)


MESSAGES = "messages array<struct<role:string,content:string>>"
CHOICES = "choices array<struct<message:struct<content:string>>>"


def test_request_actions(spark):
    df = spark.createDataFrame([([("system", "be kind"), ("user", "I am at 192.0.2.44"), ("user", None)],)], MESSAGES)
    rows = {a: pii_scan.scan_request(df, a).first() for a in ("warn", "redact", "hash", "block")}
    assert [f.text for f in rows["warn"].request_findings] == ["192.0.2.44"] and rows["warn"].messages[1].content == "I am at 192.0.2.44"
    assert rows["redact"].messages[1].content == "I am at [IP_ADDRESS]" and rows["redact"].request_findings[0].text == "[REDACTED]"
    assert rows["hash"].messages[1].content.startswith("I am at [ip_address:")
    assert rows["block"].pii_blocked and rows["block"].pii_reason == "PII detected in request: 1 instances found"
    assert rows["block"].request_findings[0].location == "messages[1].content" and not rows["warn"].pii_blocked


def test_response_actions_and_entity_column(spark):
    df = spark.createDataFrame([([(("server 192.0.2.44, mail o@p.example",),), ((None,),)], ["email"])], CHOICES + ", ents array<string>")
    assert pii_scan.scan_response(df, "redact").first().choices[0].message.content == "server [IP_ADDRESS], mail o***@***.***"
    assert pii_scan.scan_response(df, "block").first().choices[0].message.content == "Response blocked due to PII detection."
    assert [f.type for f in pii_scan.scan_response(df, "warn", F.col("ents")).first().response_findings] == ["email"]
    assert pii_scan.scan_response(df, "warn", ["ssn"]).first().response_findings == []


def test_many_findings_in_one_text_take_linear_time(spark):
    import time

    def run(n):
        t = " ".join(f"u{i}@x.org" for i in range(n))
        df = spark.createDataFrame([(t,)], "text string").select("text", pii.detect(F.col("text"), ["email"]).alias("f"))
        df = df.select(F.size("f").alias("n"), F.col("f")[n - 1]["end"].alias("end"), F.length("text").alias("len"), pii.redact_text(F.col("text"), F.col("f")).alias("r"))
        t0 = time.perf_counter()
        r = df.first()
        assert (r.n, r.end) == (n, r.len) and r.r == " ".join(f"u{i}"[:2] + pii.EMAIL_MASK_SUFFIX for i in range(n))
        return time.perf_counter() - t0

    run(500)
    small, large = run(8_000), run(32_000)
    assert large < 20 and large < 10 * small + 2  # it was fifteen times as long, and over a minute
