"""The daily cap where a day has far more requests than it pays for: what the rounds read, and blocks folded whole."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tests.test_govern import SCHEMA, _got, _row, _settings, sequential
from vigil.operators import budget, cache, govern

DAYS, CAP = 3, Decimal("0.35")


def _rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        which = rng.randrange(60)
        out.append(_row(i, rng.randrange(0, DAYS * 86400), f"prompt number {which}", rng.choice([200, 200, 200, 500]),
                        inp=rng.randrange(1, 400), out=rng.randrange(1, 300), max_tokens=20 + 5 * which))
    return out


def _stages(got):
    return {i: (r.decision.stage, r.cost, r.tracked_cost) for i, r in got.items()}


def test_rounds_read_only_what_the_cap_can_admit(spark, monkeypatch):
    rows, read = _rows(3, 1500), []
    plain = cache.replay

    def counted(requests, *a, **k):
        read.append(requests.count())
        return plain(requests, *a, **k)

    monkeypatch.setattr(cache, "replay", counted)
    monkeypatch.setattr(budget, "HEAD", 40, raising=False)
    got = _got(spark, rows, cost_limits={"daily_cap": float(CAP)})
    want = sequential(rows, CAP, 3600)
    assert _stages(got) == want
    assert {s for s, _, _ in want.values()} == {"cost", "cache", "provider", "provider_error"}
    assert read[0] == len(rows) and len(read) > 1 and max(read[1:]) < len(rows) / 2
    spend = {}  # every denied row names the spend it saw
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        day = r[2] // 86400
        if want[r[0]][0] == "cost":
            assert got[r[0]].decision.reason == f"Would exceed daily cap $0.35 (current: ${spend.get(day, 0):.2f})"
        spend[day] = spend.get(day, 0) + want[r[0]][2]


def test_a_wrong_guess_is_found_and_mended(spark, monkeypatch):
    def wrong(requests, cap):
        days = requests.select(F.to_date("ts").alias("day")).distinct()
        return days.select("day", F.lit(dt.datetime(2024, 1, 2, 1)).alias("until"), F.lit(2000).cast("bigint").alias("most"))

    rows = _rows(4, 700)
    monkeypatch.setattr(budget, "bounds", wrong, raising=False)
    assert _stages(_got(spark, rows, cost_limits={"daily_cap": float(CAP)})) == sequential(rows, CAP, 3600)


def test_no_days_bound_when_the_cap_never_binds(spark):
    asked = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), Decimal("0.01"), Decimal("0.01")) for i in range(50)],
                                  "request_id long, ts timestamp, estimated_cost decimal(18,6), actual_cost decimal(18,6)")
    assert budget.bounds(asked, "5.0").count() == 0
    assert govern.govern(spark.createDataFrame(_rows(5, 40), SCHEMA), _settings(spark, cost_limits={"daily_cap": 100.0})).where("decision.stage = 'cost'").count() == 0


def test_a_block_is_folded_whole_when_joins_turn_at_run_time(spark, monkeypatch):
    """A join whose small side is seen at run time is turned to a broadcast, and its other side is then read by the piece:
    the shuffle by blocks must come after every join, directly before the fold."""
    n, cap, plans = 2000, Decimal("1.5"), []
    rng = random.Random(6)
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=40 * i), Decimal(rng.randrange(1, 300000)) / 10**6, Decimal(rng.randrange(1, 3000)) / 10**6) for i in range(n)]
    spend, want = Decimal(0), {}
    for i, _, est, act in data:
        want[i] = (spend + est <= cap, spend)
        spend += act if want[i][0] else 0
    asked = spark.createDataFrame(data, "request_id long, ts timestamp, estimated_cost decimal(18,6), actual_cost decimal(18,6)")
    plain = budget.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(budget, "cut_lineage", seen)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.request_id: (r.allowed, r.spend_before) for r in budget.admission(asked, cap).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want and not all(a for a, _ in want.values())
    fold = next(p for p in plans if "MapInPandas fold" in p)
    assert "Exchange" in fold and fold.index("Exchange") < fold.index("Join")
