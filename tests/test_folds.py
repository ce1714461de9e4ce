"""Stateful folds against brute-force reimplementations of the original
algorithms on small inline cases (rate_cases, cache_cases, budget_cases,
reset_events of FIXTURES.md Part C) and random inputs."""

import datetime as dt
import random
from collections import deque
from decimal import Decimal

from pyspark.sql import functions as F

from vigil.operators import budget, cache, rate_limit

LIMITS = {"requests_per_minute": 1, "requests_per_hour": 2, "requests_per_day": 3}
WIN = [("requests_per_minute", 60, "min"), ("requests_per_hour", 3600, "hour"), ("requests_per_day", 86400, "day")]


def brute_rate(rows, limits, resets=()):
    """The original per-request algorithm: sorted sets of accepted seconds
    per (client, window), checked in policy order, stop at first denial."""
    sets = {}
    events = [(c, s, 0, rid) for rid, c, s in rows] + [(c, s, 1, None) for c, s in resets]
    out = {}
    for c, s, kind, rid in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3] or 0)):
        if kind == 1:
            for w in WIN:
                sets.pop((c, w[0]), None)
            continue
        rem, allowed, reason = {}, True, None
        for name, width, suf in WIN:
            if name not in limits:
                continue
            zs = sets.setdefault((c, name), set())
            for x in [x for x in zs if x <= s - width]:
                zs.discard(x)
            if len(zs) < limits[name]:
                rem[name] = limits[name] - len(zs) - 1
                zs.add(s)
            else:
                rem[name] = 0
                allowed, reason = False, f"Rate limit exceeded: {name} ({limits[name]} requests per {suf})"
                break
        out[rid] = (allowed, reason, rem.get("requests_per_minute"), rem.get("requests_per_hour"),
                    rem.get("requests_per_day"))
    return out


def _run_rate(spark, rows, resets=None):
    df = spark.createDataFrame(rows, "request_id long, client_id string, sec long")
    r = None
    if resets:
        r = spark.createDataFrame(resets, "client_id string, reset_sec long")
    got = rate_limit.decisions(df, LIMITS, r).collect()
    return {x.request_id: (x.allowed, x.reason, x.remaining_minute, x.remaining_hour, x.remaining_day)
            for x in got}


def test_rate_cases(spark):
    rows = [
        (1, "a", 1000), (2, "a", 1000), (3, "a", 1000),  # same-second burst shares one slot
        (4, "a", 1060),                                   # exactly at t - w: old slot expired
        (5, "a", 1061),                                   # denied at minute, not counted
        (6, "a", 1130),                                   # minute passes, hour denies
        (7, "b", 5), (8, "b", 7200), (9, "b", 7260), (10, "b", 90000),
    ]
    assert _run_rate(spark, rows) == brute_rate(rows, LIMITS)


def test_rate_reset_between_denials(spark):
    rows = [(1, "a", 0), (2, "a", 100), (3, "a", 200), (4, "a", 300), (5, "a", 400), (6, "a", 500)]
    resets = [("a", 350)]
    got = _run_rate(spark, rows, resets)
    assert got == brute_rate(rows, LIMITS, resets)
    assert got[4][0] is False and got[5][0] is True


def test_rate_random_against_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for rid in range(600):
        rows.append((rid, rnd.choice("abcd"), rnd.randrange(0, 4 * 3600, rnd.choice([1, 7, 45]))))
    assert _run_rate(spark, rows) == brute_rate(rows, LIMITS)


def test_rate_long_runs_are_decided_as_arrays(spark):
    """Clients that are always at their limits, in long runs: equal to one request after the other, also across Arrow batches."""
    rnd = random.Random(41)
    rows, resets, rid = [], [], 0
    for c, gap in (("busy", 1), ("steady", 9), ("bursts", 40)):
        t = 0
        for _ in range(1500):
            t += rnd.randrange(1, 2 * gap + 1) if rnd.random() > 0.02 else 4000
            for _ in range(rnd.choice([1, 1, 1, 3])):
                rows.append((rid, c, t))
                rid += 1
        resets += [(c, rows[-700][2]), (c, rows[-300][2])]
    df = spark.createDataFrame(rows, "request_id long, client_id string, sec long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, limits, rs in ((10_000, {"requests_per_minute": 7, "requests_per_hour": 90, "requests_per_day": 400}, []), (100, {"requests_per_minute": 3, "requests_per_hour": 50}, resets),
                                 (777, {"requests_per_minute": 0, "requests_per_day": 5}, []), (10_000, {"requests_per_hour": 10**6}, resets)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            want = brute_rate(rows, limits, rs)
            r = spark.createDataFrame(rs, "client_id string, reset_sec long") if rs else None
            for strategy in ("chunked", "serial"):
                got = {x.request_id: (x.allowed, x.reason, getattr(x, "remaining_minute", None), getattr(x, "remaining_hour", None), getattr(x, "remaining_day", None))
                       for x in rate_limit.decisions(df, limits, r, strategy=strategy).collect()}
                assert got == want, (size, strategy)
        got = {x.request_id: x.allowed for x in rate_limit.decisions(df, {"requests_per_minute": 7, "requests_per_hour": 90}, count_mode="requests").collect()}
        assert got == {k: v[0] for k, v in brute_rate_requests(rows, {"requests_per_minute": 7, "requests_per_hour": 90}).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_rate_fail_open_without_time(spark):
    df = spark.createDataFrame([(1, "a", None)], "request_id long, client_id string, sec long")
    r = rate_limit.decisions(df, LIMITS).first()
    assert r.allowed and r.remaining_minute == 1 and r.min_remaining == 1


def brute_cache(rows, ttl, ok=None):
    """Per key: a successful miss stores at t0; hits while t < t0 + ttl."""
    out, store = {}, {}
    for rid, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s = store.get(key)
        if s is not None and t < s + ttl:
            out[rid] = True
        else:
            out[rid] = False
            if ok is None or ok[rid]:
                store[key] = t
    return out


def _ts(sec):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=sec)


def test_cache_cases(spark):
    ttl = 3600
    rows = [(1, "k", 0), (2, "k", 3599), (3, "k", 3600), (4, "k", 3700), (5, "k", 7199), (6, "k", 7200),
            (7, "j", 10), (8, "j", 20)]
    df = spark.createDataFrame([(r, k, _ts(t)) for r, k, t in rows], "request_id long, cache_key string, ts timestamp")
    got = {x.request_id: x.cache_hit for x in cache.replay(df, ttl).collect()}
    assert got == brute_cache(rows, ttl)
    # hit just before expiry, miss exactly at t0 + ttl, hits do not extend
    assert got[2] and not got[3] and got[4] and not got[6]


def test_cache_failed_miss_stores_nothing(spark):
    rows = [(1, "k", 0), (2, "k", 10), (3, "k", 20)]
    ok = {1: False, 2: True, 3: True}
    df = spark.createDataFrame([(r, k, _ts(t), ok[r]) for r, k, t in rows],
                               "request_id long, cache_key string, ts timestamp, ok boolean")
    got = {x.request_id: x.cache_hit for x in cache.replay(df, 100, answered_ok=F.col("ok")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_cache_random_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.randrange(0, 20000)) for i in range(800)]
    df = spark.createDataFrame([(r, k, _ts(t)) for r, k, t in rows], "request_id long, cache_key string, ts timestamp")
    got = {x.request_id: x.cache_hit for x in cache.replay(df, 900).collect()}
    assert got == brute_cache(rows, 900)


def test_cache_one_key_over_many_chunks(spark):
    """All requests have one key: chunks replay in several tasks, and equal the plain fold."""
    rnd = random.Random(17)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks as of large inputs
    for ttl, gap, fails in ((60, 3, 0.0), (60, 50, 0.5), (600, 2000, 0.3), (7, 400, 0.1)):
        t, rows, ok = 0, [], {}
        for i in range(3000):
            t += rnd.randrange(0, 2 * gap + 1) if rnd.random() > 0.01 else 40 * ttl
            rows.append((i, "hot", t))
            ok[i] = rnd.random() >= fails
        df = spark.createDataFrame([(r, k, _ts(x), ok[r]) for r, k, x in rows], "request_id long, cache_key string, ts timestamp, ok boolean")
        out = cache.replay(df, ttl, answered_ok=F.col("ok"))
        got = out.withColumn("part", F.spark_partition_id()).collect()
        assert {x.request_id: x.cache_hit for x in got} == brute_cache(rows, ttl, ok), (ttl, gap)
        assert len({x.part for x in got}) > 1
        live = None
        for x in sorted(got, key=lambda x: (x.ts, x.request_id)):  # the entry of a hit is the last store
            live = x.ts if not x.cache_hit and ok[x.request_id] else live
            assert x.entry_stored_at == (live if x.cache_hit or ok[x.request_id] else None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cache_chunks_in_small_arrow_batches(spark):
    rnd = random.Random(23)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", "d" * 40]), rnd.randrange(0, 30_000)) for i in range(2500)]
    ok = {i: rnd.random() < 0.8 for i, *_ in rows}
    df = spark.createDataFrame([(r, k, _ts(t), ok[r], "x" * (r % 5)) for r, k, t in rows], "request_id long, cache_key string, ts timestamp, ok boolean, extra string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 64):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            got = cache.replay(df, 50, answered_ok=F.col("ok"), carry=["extra"]).collect()
            assert {x.request_id: x.cache_hit for x in got} == brute_cache(rows, 50, ok)
            assert all(x.extra == "x" * (x.request_id % 5) for x in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_cache_rows_without_key_or_time(spark):
    rows = [(1, "k", _ts(0)), (2, None, _ts(1)), (3, "k", None), (4, "k", _ts(5)), (5, None, None), (6, None, _ts(2)), (None, "k", _ts(6))]
    df = spark.createDataFrame(rows, "request_id long, cache_key string, ts timestamp")
    got = sorted((x.request_id or 0, x.cache_hit, x.entry_stored_at) for x in cache.replay(df, 100).collect())
    assert got == [(0, True, _ts(0)), (1, False, _ts(0)), (2, False, None), (3, False, None), (4, True, _ts(0)), (5, False, None), (6, False, None)]
    assert [x.cache_hit for x in cache.replay(df, 0).collect()] == [False] * 7
    assert cache.replay(df.limit(0), 100).count() == 0


def brute_budget(rows, cap):
    out, spend = {}, {}
    for rid, ts, est, act in sorted(rows, key=lambda r: (r[1], r[0])):
        day = ts.date()
        s = spend.get(day, Decimal(0))
        ok = s + est <= cap
        out[rid] = ok
        if ok:
            spend[day] = s + act
    return out


def test_budget_cases(spark):
    cap = Decimal("1.00")
    rows = [(1, _ts(0), Decimal("0.40"), Decimal("0.50")),
            (2, _ts(10), Decimal("0.50"), Decimal("0.50")),   # equality with the cap passes
            (3, _ts(20), Decimal("0.30"), Decimal("0.30")),   # large one denied
            (4, _ts(30), Decimal("0.00"), Decimal("0.00")),   # a later small request still fits
            (5, _ts(86400), Decimal("0.90"), Decimal("0.10"))]  # next day starts fresh
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, estimated_cost decimal(18,6), actual_cost decimal(18,6)")
    got = {x.request_id: x.allowed for x in budget.admission(df, cap).collect()}
    assert got == brute_budget(rows, cap)
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_budget_random_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(500):
        est = Decimal(rnd.randrange(0, 20000)) / Decimal(10 ** 6)
        rows.append((i, _ts(rnd.randrange(0, 3 * 86400)), est, (est * Decimal("0.8")).quantize(Decimal("0.000001"))))
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, estimated_cost decimal(18,6), actual_cost decimal(18,6)")
    got = {x.request_id: x.allowed for x in budget.admission(df, "0.5").collect()}
    assert got == brute_budget(rows, Decimal("0.5"))


def test_state_helpers_are_bounded():
    q = deque()
    states = [deque(), deque(), deque()]
    lim = rate_limit.limits_list(LIMITS)
    for t in range(0, 100000, 5):
        rate_limit._check(states, t, lim, add=True)
    assert all(len(s) <= 3 for s in states) and not q


def test_rate_chunked_fast_path_against_brute_force(spark):
    """Generous limits over many days: most day-chunks are calm (no fold),
    one client bursts into its limits on some days."""
    limits = {"requests_per_minute": 3, "requests_per_hour": 20, "requests_per_day": 60}
    rnd = random.Random(5)
    rows, rid = [], 0
    for day in range(10):
        for c in "abcd":
            for _ in range(rnd.randrange(5, 40)):
                rows.append((rid, c, day * 86400 + rnd.randrange(0, 86400)))
                rid += 1
        if day in (3, 4, 8):  # burst days for client z
            base = day * 86400 + 3600 * 5
            for i in range(120):
                rows.append((rid, "z", base + i * rnd.choice([1, 2, 20])))
                rid += 1
    rows.append((rid, "z", 6 * 86400))  # a calm request on a quiet day after the burst
    df = spark.createDataFrame(rows, "request_id long, client_id string, sec long")
    want = brute_rate(rows, limits)
    for strategy in ("chunked", "serial"):
        got = {x.request_id: (x.allowed, x.reason, x.remaining_minute, x.remaining_hour, x.remaining_day)
               for x in rate_limit.decisions(df, limits, strategy=strategy).collect()}
        assert got == want, strategy


def test_budget_long_tail_with_free_requests(spark):
    """One day with thousands of rows past the point where the cap can bind,
    many of them free (cache hits): exercises the vectorised tail."""
    rnd = random.Random(13)
    rows = []
    for i in range(6000):
        est = Decimal(rnd.randrange(0, 3000)) / Decimal(10 ** 6)
        act = Decimal(0) if rnd.random() < 0.4 else (est * Decimal("1.5")).quantize(Decimal("0.000001"))
        rows.append((i, _ts(rnd.randrange(0, 86400)), est, act))
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, estimated_cost decimal(18,6), actual_cost decimal(18,6)")
    got = {x.request_id: x.allowed for x in budget.admission(df, "0.8").collect()}
    want = brute_budget(rows, Decimal("0.8"))
    assert got == want
    assert sum(want.values()) < len(rows)  # the cap binds


def test_step_functions_equal_the_fold():
    import numpy as np

    rnd = random.Random(31)
    for _ in range(60):
        cap = rnd.randrange(1, 400)
        n = rnd.randrange(0, 40)
        est = np.array([rnd.randrange(0, 120) for _ in range(n)], dtype=np.int64)
        act = np.array([rnd.choice([0, int(e), int(e) // 2, int(e) + 7]) for e in est], dtype=np.int64)
        steps = budget.Steps(cap)
        cut = rnd.randrange(0, n + 1)
        steps.add(est[:cut], act[:cut])
        steps.add(est[cut:], act[cut:])
        assert steps.lo[0] == 0 and steps.hi[-1] == cap and (steps.lo[1:] == steps.hi[:-1] + 1).all()
        for left in range(cap + 1):
            spend = budget._fold_tail(est, act, cap - left, cap)[2]
            i = int(np.searchsorted(steps.lo, left, side="right")) - 1
            assert cap - left + int(steps.spent[i]) == spend


def test_budget_one_day_runs_in_many_tasks(spark):
    rnd = random.Random(37)
    rows = []
    for i in range(5000):
        est = Decimal(rnd.choice([10, 200, 3000, 40000])) / Decimal(10 ** 6)
        act = Decimal(0) if rnd.random() < 0.5 else (est * Decimal(rnd.choice(["0.1", "0.9", "1.3"]))).quantize(Decimal("0.000001"))
        rows.append((i, _ts(rnd.randrange(0, 6 * 3600)), est, act))
    df = spark.createDataFrame(rows, "request_id long, ts timestamp, estimated_cost decimal(18,6), actual_cost decimal(18,6)")
    tasks = []
    real, spark_task = budget.cut_lineage, F.spark_partition_id().alias("p")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks as of large inputs
    try:
        budget.cut_lineage = lambda d: real(d) if "allowed" not in d.columns else (tasks.append(d.select(spark_task).distinct().count()), real(d))[1]
        got = {x.request_id: x.allowed for x in budget.admission(df, "1.5").collect()}
    finally:
        budget.cut_lineage = real
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_budget(rows, Decimal("1.5"))
    assert got == want and 0 < sum(want.values()) < len(rows)
    assert tasks and tasks[0] > 1


def brute_rate_requests(rows, limits):
    """Request-counting variant: every admitted request takes a slot."""
    lists, out = {}, {}
    for rid, c, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        rem, allowed, reason = {}, True, None
        for name, width, suf in WIN:
            if name not in limits:
                continue
            zs = [x for x in lists.get((c, name), []) if x > s - width]
            lists[(c, name)] = zs
            if len(zs) < limits[name]:
                rem[name] = limits[name] - len(zs) - 1
                zs.append(s)
            else:
                rem[name] = 0
                allowed, reason = False, f"Rate limit exceeded: {name} ({limits[name]} requests per {suf})"
                break
        out[rid] = (allowed, reason, rem.get("requests_per_minute"), rem.get("requests_per_hour"),
                    rem.get("requests_per_day"))
    return out


def test_rate_count_mode_requests(spark):
    rows = [(1, "a", 1000), (2, "a", 1000), (3, "a", 1000), (4, "a", 1070), (5, "b", 5), (6, "b", 5)]
    limits = {"requests_per_minute": 2, "requests_per_hour": 3}
    df = spark.createDataFrame(rows, "request_id long, client_id string, sec long")
    got = {x.request_id: (x.allowed, x.reason, x.remaining_minute, x.remaining_hour, None)
           for x in rate_limit.decisions(df, limits, count_mode="requests").collect()}
    want = {k: (v[0], v[1], v[2], v[3], None) for k, v in brute_rate_requests(rows, limits).items()}
    assert got == want
    assert got[3][0] is False  # a third request in the same second counts


def test_chunked_fold_splits_a_hot_client(spark):
    """A client busy on days 1 and 5 with quiet days between: the chunked
    fold replays the two bursts as separate segments, whatever the size."""
    limits = {"requests_per_minute": 2, "requests_per_hour": 5, "requests_per_day": 20}
    rows, rid = [], 0
    for day in (1, 5):
        for i in range(60):
            rows.append((rid, "hot", day * 86400 + i * 7))
            rid += 1
    for day in range(0, 8):
        rows.append((rid, "hot", day * 86400 + 50000))
        rid += 1
    df = spark.createDataFrame(rows, "request_id long, client_id string, sec long")
    ps = rate_limit.per_second(df)
    lim = rate_limit.limits_list(limits)
    chunk_rows = rate_limit.fold_seconds_chunked(ps, lim)
    assert chunk_rows.count() == ps.count()
    got = {x.request_id: (x.allowed, x.reason, x.remaining_minute, x.remaining_hour, x.remaining_day)
           for x in rate_limit.decisions(df, limits).collect()}
    assert got == brute_rate(rows, limits)


def test_rows_without_client_or_time_fail_open(spark):
    rows = [(1, "a", 10), (2, "a", 20), (3, None, 10), (4, None, 11), (5, "a", None), (6, None, None)]
    df = spark.createDataFrame(rows, "request_id long, client_id string, sec long")
    for strategy in ("chunked", "serial"):
        got = {x.request_id: (x.allowed, x.reason, x.remaining_minute) for x in rate_limit.decisions(df, {"requests_per_minute": 1}, strategy=strategy).collect()}
        assert got[1] == (True, None, 0) and got[2][0] is False
        assert all(got[k] == (True, None, 1) for k in (3, 4, 5, 6))


def test_no_job_runs_while_a_limiter_plan_is_built(spark):
    sc = spark.sparkContext
    df = spark.range(100).selectExpr("id AS request_id", "concat('c', id % 3) AS client_id", "id * 7 AS sec")
    sc.setJobGroup("plan-only", "plan")
    rate_limit.decisions(df, {"requests_per_minute": 2, "requests_per_day": 9})
    assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
    sc.setJobGroup("other", "other")


def test_json_strings_equal_pythons(spark):
    import json

    from pyspark.sql import functions as F

    from vigil.functions.keys import json_string

    texts = ["", "plain", 'q" b\\ /', "tab\tnl\ncr\rbs\bff\f", "\x00\x01\x1f\x7f\x80", "äß 日本 ﷺ", "😀 \U0010ffff", "mixed \\u0041 é\"", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.j for r in df.select("i", json_string(F.col("t")).alias("j")).collect()}
    assert [got[i] for i in range(len(texts))] == [json.dumps(t) for t in texts]
