"""The governed path against a sequential replay of the same requests."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vigil.operators import govern, policy

SCHEMA = ("request_id long, ts timestamp, sec long, client_id string, model string, messages array<struct<role:string,content:string>>, system string, "
          "max_tokens int, temperature double, top_p double, answer_status int, answer string, usage_prompt_tokens long, usage_completion_tokens long")
EPOCH = dt.datetime(2024, 1, 1)
PRICE = (Decimal("0.03"), Decimal("0.06"))  # gpt-4, per 1000


def _settings(spark, **doc):
    d = {"name": "t", "pii_detection": {"enabled": True, "action": "warn", "entities": ["email", "ip_address"]}, "caching": {"enabled": True, "ttl_seconds": 3600}, **doc}
    return policy.settings(spark.createDataFrame([("t", json.dumps(d))], "policy_name string, json string").select("policy_name", F.parse_json("json").alias("doc")))


def _row(i, sec, prompt, status=200, answer="ok", inp=100, out=100, system=None, model="gpt-4", max_tokens=100):
    return (i, EPOCH + dt.timedelta(seconds=sec), sec, "c", model, [("user", prompt)], system, max_tokens, None, None, status, answer, inp, out)


def _cost(i, o):
    return ((i * PRICE[0] + o * PRICE[1]) / 1000).quantize(Decimal("0.000001"))


def sequential(rows, cap, ttl):
    """One request after the other: stage, cost shown, cost tracked."""
    live, spend, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        i, sec, prompt, system = r[0], r[2], r[5][0][1], r[6]
        est = _cost(4 + 1 + len(prompt) // 4 + (len(system) // 4 if system else 0), r[7])
        day = sec // 86400
        if spend.get(day, 0) + est > cap:
            out[i] = ("cost", None, 0)
            continue
        hit = live.get(prompt)
        if hit and sec < hit[0] + ttl:
            out[i] = ("cache", hit[1], 0)
        elif r[10] != 200:
            out[i] = ("provider_error", None, 0)
        else:
            c = _cost(r[12], r[13])
            spend[day] = spend.get(day, 0) + c
            live[prompt] = (sec, c)
            out[i] = ("provider", c, c)
    return out


def _got(spark, rows, **doc):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.request_id: r for r in govern.govern(df, _settings(spark, **doc)).collect()}


def test_what_the_cap_denies_stores_nothing(spark):
    day = 86400
    rows = [_row(1, day - 600, "first", inp=1000, out=1000), _row(2, day - 300, "second"), _row(3, day + 60, "second")]
    got = _got(spark, rows, cost_limits={"daily_cap": 0.09})
    assert [got[i].decision.stage for i in (1, 2, 3)] == ["provider", "cost", "provider"]
    assert got[3].cost == _cost(100, 100) and not got[3].cache_hit and got[2].decision.status == 429


def test_failed_answers_cost_and_store_nothing(spark):
    rows = [_row(1, 10, "mail a@b.example", 500, "at 10.0.0.1"), _row(2, 20, "mail a@b.example", 200, "at 10.0.0.1"), _row(3, 30, "mail a@b.example", 200, "at 10.9.9.9")]
    got = _got(spark, rows)
    assert [got[i].decision.stage for i in (1, 2, 3)] == ["provider_error", "provider", "cache"]
    assert got[1].decision.status == 500 and got[1].cost is None and list(got[1].pii.response_findings) == [] and not got[1].decision.allowed
    assert list(got[2].pii.request_findings) == ["email:5-16"] and list(got[2].pii.response_findings) == ["ip_address:3-11"]
    assert got[3].cost == got[2].cost and got[3].tracked_cost == 0 and list(got[3].pii.response_findings) == ["ip_address:3-11"]


def test_blocked_and_default_model(spark):
    rows = [_row(1, 10, "to x@y.example"), _row(2, 20, "fine", model=None, system="be brief and kind")]
    got = _got(spark, rows, pii_detection={"enabled": True, "action": "block", "entities": ["email"]})
    assert got[1].decision.stage == "pii" and got[1].decision.status == 400 and got[1].cost is None
    assert got[2].model == "gpt-3.5-turbo" and got[2].decision.stage == "provider"
    with_system = _row(3, 30, "fine", model=None)
    plain = _got(spark, [with_system])[3].estimated_cost
    assert got[2].estimated_cost > plain


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_sequential_replay_when_cap_and_cache_interact(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        which = rng.randrange(12)
        prompt = f"prompt number {which}"  # max_tokens is part of the cache key, so it goes with the prompt
        rows.append(_row(i, rng.randrange(0, 3 * 86400), prompt, rng.choice([200, 200, 200, 500]), inp=rng.randrange(1, 900), out=rng.randrange(1, 300), max_tokens=20 + 25 * which))
    want = sequential(rows, Decimal("0.35"), 3600)
    got = _got(spark, rows, cost_limits={"daily_cap": 0.35})
    assert {i: (r.decision.stage, r.cost, r.tracked_cost) for i, r in got.items()} == want
    assert {s for s, _, _ in want.values()} == {"cost", "cache", "provider", "provider_error"}
