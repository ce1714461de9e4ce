"""Policies: checks of every limited field, selection, files, settings, routing, masking."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.operators import policy


def _docs(spark, named):
    rows = [(n, json.dumps(d)) for n, d in named]
    return spark.createDataFrame(rows, "policy_name string, json string").select(
        "policy_name", F.parse_json("json").alias("doc"), F.lit(None).cast("timestamp").alias("modified"))


# one document per case: what is wrong with it
VALIDITY = [
    ({"name": "a"}, []),
    ({"name": "b", "cost_limits": {"daily_cap": 7, "max_per_request": 0.5}, "rate_limits": {"requests_per_day": 9}}, []),
    ({}, ["Policy must have a 'name' field"]),
    ({"name": "c", "cost_limits": {"daily_cap": [1]}}, ["cost_limits.daily_cap must be a number"]),
    ({"name": "d", "cost_limits": {"max_per_request": "0.5"}}, ["cost_limits.max_per_request must be a number"]),
    ({"name": "e", "rate_limits": {"requests_per_hour": "many"}}, ["rate_limits.requests_per_hour must be an integer"]),
    ({"name": "f", "rate_limits": {"requests_per_day": 1.5}}, ["rate_limits.requests_per_day must be an integer"]),
    ({"name": "g", "rate_limits": {"requests_per_minute": False}}, []),  # a boolean counts as a whole number
]


def test_validation(spark):
    docs = _docs(spark, [(f"p{i}", d) for i, (d, _) in enumerate(VALIDITY)])
    got = {r.policy_name: r.errors for r in policy.validate(docs).collect()}
    assert got == {f"p{i}": want for i, (_, want) in enumerate(VALIDITY)}


@pytest.mark.parametrize("named, ask, want", [
    ([("x", False), ("y", True), ("z", True)], None, "Y"),
    ([("x", False), ("y", True)], "x", "X"),  # a name asked for wins, enabled or not
    ([("x", False), ("default", False)], None, "DEFAULT"),
    ([("x", False), ("default", True), ("a", True)], "nobody", "A"),
    ([("x", False)], None, None),
])
def test_selection(spark, named, ask, want):
    docs = _docs(spark, [(n, {"name": n.upper(), "enabled": on}) for n, on in named])
    got = [r.name for r in policy.active_policy(docs, *([ask] if ask else [])).collect()]
    assert got == ([want] if want else [])


def test_files(spark):
    d = tempfile.mkdtemp(prefix="vigil-pol-")
    for name, body in (("tight.yaml", "name: Tight\nrate_limits:\n  requests_per_minute: 2\n"), ("blank.yaml", "\n"),
                       ("torn.yaml", "name: {\n"), ("notes.txt", "name: No\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    pols = policy.read_policies(spark, d)
    assert [r.policy_name for r in pols.collect()] == ["tight"]
    s = policy.settings(pols).first()
    assert s.name == "Tight" and s.rate_limits == {"requests_per_minute": 2}
    assert [r.policy_name for r in policy.with_fallback(pols, spark).collect()] == ["tight"]
    assert [r.policy_name for r in policy.with_fallback(pols.where("false"), spark).collect()] == ["default"]


def test_shipped_defaults(spark):
    got = {r.policy_name: r for r in policy.settings(policy.default_policies(spark)).collect()}
    assert len(got) == 2
    with_pii = [r for r in got.values() if r.pii_enabled]
    assert len(with_pii) == 1 and with_pii[0].pii_action == "warn"
    assert {float(r.daily_cap) for r in got.values()} == {100.0}


def test_routing_by_tokens(spark):
    df = spark.createDataFrame([(None,), (1,), (100,), (100_000,)], "max_tokens int")
    got = [r.m for r in df.select(policy.route_model(policy.FILE_DEFAULT_ROUTING).alias("m")).collect()]
    assert got[1] == "gpt-3.5-turbo" and got[0] == got[3] and set(got) == {"gpt-3.5-turbo", "gpt-4o-mini"}


def test_masked_log(spark):
    df = spark.createDataFrame([("question", "answer", 2.5)], "prompt string, response_text string, cost double")
    assert tuple(policy.log_policy_mask(df, log_responses=False).first()) == ("question", None, 2.5)
    assert policy.log_policy_mask(df, log_responses=True).first().response_text == "answer"


def test_routing_conditions(spark):
    rows = [(1, 50, "a"), (2, 150, "b"), (3, None, "b"), (4, 500, "it's")]
    df = spark.createDataFrame(rows, "id int, max_tokens int, tier string")
    hits = lambda text: [r.id for r in df.where(policy.condition(text)).orderBy("id").collect()]
    assert hits("request.max_tokens < 100") == [1] and hits("max_tokens >= 150 and tier != 'b'") == [4]
    assert hits('request.tier == "it\'s" or request.max_tokens<=50.5') == [1, 4] and hits("tier = 'b'") == [2, 3]
    for bad in ("", "max_tokens < (SELECT 1)", "sleep(10)", "max_tokens < 100; drop", "a.b.c < 1", "java_method('x', 'y') = 'z'"):
        with pytest.raises(ValueError):
            policy.condition(bad)
