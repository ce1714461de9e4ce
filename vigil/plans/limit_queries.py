"""Rate-limit queries over the request log (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import rate_limit as rl
from vigil.plans.registry import query
from vigil.sources import fixtures
from vigil.sources.dims import RATE_WINDOWS
from vigil.sources.tables import read_table

# Test limits: the default ones (60/min, 1000/h, 10000/day) never trigger on
# this data (at most 4 events per user-hour), so tight limits exercise the fold.
TEST_LIMITS = {"requests_per_minute": 1, "requests_per_hour": 2, "requests_per_day": 3}
# "Now" for the status report: the end of the as-of day.
AS_OF_SEC = 1706659200  # 2024-01-31 00:00:00 UTC


def keyed(spark, sf_dir):
    return fixtures.with_client_and_key(fixtures.request_log(read_table(spark, sf_dir, "events")))


def resets_from(log):
    """Derived reset events: a 'signup' request resets its client's limits
    after its second."""
    return log.where(F.col("prompt").startswith("signup:")).select(
        "client_id", F.col("sec").alias("reset_sec"))


def _step_sql(limits, with_kind: bool) -> str:
    """Output columns of one fold step from q(p0.. = pruned state lists)."""
    k_n = len(limits)
    acc1, acc2, out = [], [], []
    for k, (name, lim, width, suffix) in enumerate(limits):
        prev1 = acc1[-1] if acc1 else "true"
        acc1.append(f"({prev1} AND len(p{k}) < {lim})")
    new_state = [f"CASE WHEN {acc1[k]} THEN list_append(p{k}, sec) ELSE p{k} END" for k in range(k_n)]
    if with_kind:
        new_state = [f"CASE WHEN kind = 1 THEN []::BIGINT[] ELSE {e} END" for e in new_state]
    for k, (name, lim, width, suffix) in enumerate(limits):
        prev2 = acc2[-1] if acc2 else "true"
        acc2.append(f"({prev2} AND len({new_state[k]}) < {lim})")

    def reason(acc):
        whens = " ".join(f"WHEN NOT {acc[k]} THEN 'Rate limit exceeded: {n} ({lim} requests per {suf})'"
                         for k, (n, lim, w, suf) in enumerate(limits))
        return f"CASE {whens} END"

    def rem(acc, cnt, k, lim):
        reached = "true" if k == 0 else acc[k - 1]
        return (f"CAST(CASE WHEN NOT {reached} THEN NULL WHEN {cnt} < {lim} THEN {lim} - {cnt} - 1 "
                f"ELSE 0 END AS BIGINT)")

    out.append(f"{acc1[-1]} AS first_allowed")
    out.append(f"{reason(acc1)} AS first_reason")
    for k, (n, lim, w, suf) in enumerate(limits):
        out.append(f"{rem(acc1, f'len(p{k})', k, lim)} AS first_rem_{rl._short(n)}")
    out.append(f"{acc2[-1]} AS rest_allowed")
    out.append(f"{reason(acc2)} AS rest_reason")
    for k, (n, lim, w, suf) in enumerate(limits):
        out.append(f"{rem(acc2, f'len({new_state[k]})', k, lim)} AS rest_rem_{rl._short(n)}")
    for k, (n, lim, w, suf) in enumerate(limits):
        out.append(f"{acc1[k]} AS slot_{rl._short(n)}")
    for k in range(k_n):
        out.append(f"{new_state[k]} AS st{k}")
    return ",\n    ".join(out)


def fold_sql(limits, with_resets: bool = False) -> str:
    """Recursive CTE ``fold`` carrying each window's accepted seconds."""
    kind = ", kind" if with_resets else ""
    resets = ""
    union = ""
    if with_resets:
        resets = """,
resets AS (SELECT DISTINCT client_id, sec AS reset_sec FROM keyed_log WHERE starts_with(prompt, 'signup:'))"""
        union = "UNION ALL SELECT client_id, reset_sec AS sec, 0 AS n, -1 AS first_id, 1 AS kind FROM resets"
    zero = ", ".join(f"[]::BIGINT[] AS p{k}" for k in range(len(limits)))
    pruned = ", ".join(f"list_filter(f.st{k}, lambda x: x > p.sec - {w}) AS p{k}"
                       for k, (n, lim, w, s) in enumerate(limits))
    step = _step_sql(limits, with_resets)
    return f"""{fixtures.KEYED_LOG_SQL}{resets},
ps0 AS (SELECT client_id, sec, count(*) AS n, min(request_id) AS first_id, 0 AS kind
        FROM keyed_log GROUP BY client_id, sec {union}),
ps AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY sec, kind) AS rn FROM ps0),
fold AS (
  SELECT client_id, rn, sec, n, first_id{kind},
    {step}
  FROM (SELECT *, {zero} FROM ps WHERE rn = 1)
  UNION ALL
  SELECT client_id, rn, sec, n, first_id{kind},
    {step}
  FROM (SELECT p.*, {pruned} FROM fold f JOIN ps p ON p.client_id = f.client_id AND p.rn = f.rn + 1))"""


def dec_cte(limits, with_resets=False) -> str:
    """CTEs up to ``dec`` (per-request decisions) without the WITH keyword."""
    rems = ", ".join(f"CASE WHEN l.request_id = f.first_id THEN first_rem_{rl._short(n)} "
                     f"ELSE rest_rem_{rl._short(n)} END AS remaining_{rl._short(n)}" for n, *_ in limits)
    return f"""{fold_sql(limits, with_resets)},
dec AS (
  SELECT l.request_id, l.client_id, l.sec,
         CASE WHEN l.request_id = f.first_id THEN first_allowed ELSE rest_allowed END AS allowed,
         CASE WHEN l.request_id = f.first_id THEN first_reason ELSE rest_reason END AS reason,
         {rems}
  FROM keyed_log l JOIN fold f ON l.client_id = f.client_id AND l.sec = f.sec{" AND f.kind = 0" if with_resets else ""})"""


def decisions_sql(limits, with_resets=False) -> str:
    names = ", ".join(f"remaining_{rl._short(n)}" for n, *_ in limits)
    return f"""WITH RECURSIVE {dec_cte(limits, with_resets)}
SELECT *, coalesce(least({names}), 0) AS min_remaining FROM dec"""


LIMITS = rl.limits_list(TEST_LIMITS)


@query("rate_limit_decisions", decisions_sql(LIMITS))
def rate_limit_decisions(spark, sf_dir):
    return rl.decisions(keyed(spark, sf_dir), TEST_LIMITS)


@query("rate_limit_after_reset", decisions_sql(LIMITS, with_resets=True))
def rate_limit_after_reset(spark, sf_dir):
    log = keyed(spark, sf_dir)
    return rl.decisions(log, TEST_LIMITS, resets=resets_from(log))


_STATUS_ROWS = " UNION ALL ".join(
    f"SELECT client_id, '{n}' AS limit_type, CAST({lim} AS BIGINT) AS \"limit\", "
    f"CAST(count(*) FILTER (WHERE slot_{rl._short(n)} AND sec > {AS_OF_SEC - w} AND sec <= {AS_OF_SEC}) AS BIGINT) AS used, "
    f"CAST({AS_OF_SEC + w} AS BIGINT) AS reset_time FROM fold GROUP BY client_id"
    for n, lim, w, s in LIMITS)


@query("rate_limit_status", f"""WITH RECURSIVE {fold_sql(LIMITS)}
SELECT client_id, limit_type, "limit", used, greatest(0, "limit" - used) AS remaining, reset_time
FROM ({_STATUS_ROWS})""")
def rate_limit_status(spark, sf_dir):
    log = keyed(spark, sf_dir)
    folded = rl.fold_seconds_chunked(rl.per_second(log), LIMITS)
    return rl.status(folded, TEST_LIMITS, AS_OF_SEC)


@query("client_ids", f"""WITH {fixtures.KEYED_LOG_SQL}
SELECT client_id, count(*) AS requests, min(client_ip) AS client_ip, min(user_agent) AS user_agent
FROM keyed_log GROUP BY client_id""")
def client_ids(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("requests"), F.min("client_ip").alias("client_ip"),
        F.min("user_agent").alias("user_agent"))


_TRAIL = ", ".join(
    f"count(*) OVER (PARTITION BY client_id ORDER BY sec RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) "
    f"AS requests_last_{rl._short(n)}" for n, w, _ in RATE_WINDOWS)


@query("trailing_request_count", f"""WITH {fixtures.KEYED_LOG_SQL}
SELECT request_id, client_id, sec, {_TRAIL} FROM keyed_log""")
def trailing_request_count(spark, sf_dir):
    return rl.trailing_request_count(keyed(spark, sf_dir))
