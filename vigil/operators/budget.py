"""Spend over time: W2 running daily spend, T6 daily-cap admission, W3
minute spend, W4 running total, A14 budget utilisation.

Admission under a daily cap is a serial fold (a denied request adds
nothing, so later decisions depend on earlier ones). What a day surely admits
comes from prefix sums; from where the cap can bind, each block of minutes is
summed up as a step function of the spend, and those are composed per day.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.windows import running_sum, trailing_sum
from vigil.session import cut_lineage
from vigil.sources.dims import DAILY_CAP_REASON, MONEY, MONEY_SUM

# ---------------------------------------------------------------------------
# Declared research budgets and their alert ladder.
# ---------------------------------------------------------------------------
BUDGETS = [("day", "50.00"), ("week", "200.00"), ("month", "500.00")]
ALERT_NOTIFY = "0.8"
ALERT_BLOCK = "0.95"
# ---------------------------------------------------------------------------

SCALE = 10 ** 6  # money is DECIMAL(18,6): the fold works on integer micro-dollars


def _minute():
    """Block of the prefix sums: short enough that its rows fit a task at any traffic, few enough for a small
    table of prefixes."""
    return F.date_trunc("minute", F.col("ts"))


#: Seconds of the blocks that are summed up as step functions: some hundred a day.
STEP_SECONDS = 300


def _step_block(kind: T.DataType):
    """Number of a time's block, in order within a day whatever the session's time zone does."""
    ts = F.col("ts")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 if isinstance(kind, T.TimestampNTZType) else F.unix_timestamp(ts)
    return F.floor(seconds / STEP_SECONDS).cast("bigint")


def daily_running_spend(df: DataFrame, cost_col: str = "cost") -> DataFrame:
    """Spend of the day strictly before each request (order ts,
    request_id), as a two-level prefix sum over minute blocks, so a hot day is
    spread over its minutes."""
    d = df.withColumn("day", F.to_date("ts")).withColumn("_c", F.coalesce(F.col(cost_col), F.lit(0).cast(MONEY)))
    out = running_sum(d, ["day"], ["ts", "request_id"], {"_c": "spend_before"},
                      block=_minute(), inclusive=False)
    return out.withColumn("spend_before", F.col("spend_before").cast(MONEY_SUM)).drop("_c")


LOOKAHEAD = 1024


def _fold_tail(est: np.ndarray, act: np.ndarray, s: int, cap: int):
    """One day's tail from spend ``s``: decisions and spend before each row.

    The spend changes only at admitted rows with a positive cost; between
    two changes every decision is the vector test ``est <= cap - s``, so
    Python iterates over spend changes, not rows (lookahead windows keep
    the work linear)."""
    n = len(est)
    allowed = np.zeros(n, dtype=bool)
    before = np.zeros(n, dtype=np.int64)
    pos = 0
    while pos < n:
        hi = min(n, pos + LOOKAHEAD)
        ok = est[pos:hi] <= cap - s
        change = np.flatnonzero(ok & (act[pos:hi] > 0))
        stop = hi if len(change) == 0 else pos + int(change[0]) + 1
        allowed[pos:stop] = ok[:stop - pos]
        before[pos:stop] = s
        if len(change):
            s += int(act[stop - 1])
        pos = stop
    return allowed, before, s


class Steps:
    """What a block's requests spend, as a step function of what is left of the cap before the block.

    Piece i holds the amounts left from ``lo[i]`` to ``hi[i]``, which all lead to the spend ``spent[i]``. A request is
    admitted where its estimate is at most what is then left, so it raises whole pieces, or cuts one at its own
    threshold; neighbours that have come to the same spend are one again. There are never more pieces than
    micro-dollars in the largest estimate."""

    def __init__(self, left: int):
        self.lo, self.hi, self.spent = np.array([0]), np.array([left]), np.array([0])

    def add(self, est: np.ndarray, act: np.ndarray) -> None:
        """The block's next requests, in order; those that can be admitted from no piece, or cost nothing, are skipped at once."""
        at, n = 0, len(est)
        while at < n:
            end = min(n, at + LOOKAHEAD)
            can = np.flatnonzero((est[at:end] <= (self.hi - self.spent).max()) & (act[at:end] > 0))
            if not len(can):
                at = end
                continue
            at += int(can[0])
            self._one(int(est[at]), int(act[at]))
            at += 1

    def _one(self, est: int, act: int) -> None:
        needs = est + self.spent
        cut = (self.lo < needs) & (needs <= self.hi)
        of = np.repeat(np.arange(len(needs)), 1 + cut)
        upper = np.zeros(len(of), dtype=bool)
        upper[1:] = of[1:] == of[:-1]
        lower = np.zeros(len(of), dtype=bool)
        lower[:-1] = upper[1:]
        lo, hi = np.where(upper, needs[of], self.lo[of]), np.where(lower, needs[of] - 1, self.hi[of])
        spent = self.spent[of] + act * ((lo >= needs[of]) & ~lower)
        keep = np.ones(len(of), dtype=bool)
        keep[1:] = spent[1:] != spent[:-1]
        first = np.flatnonzero(keep)
        self.lo, self.spent, self.hi = lo[first], spent[first], hi[np.append(first[1:], len(of)) - 1]


def _runs(pdf: pd.DataFrame, cols: list[str], cur):
    """(key, from, to, whether the group begins here) for the runs of equal ``cols`` in a sorted batch after group ``cur``."""
    values = [pdf[c].values for c in cols]
    new = np.zeros(len(pdf), dtype=bool)
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    cuts = np.flatnonzero(new).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        if hi > lo:
            key = tuple(v[lo] for v in values)
            yield key, lo, hi, key != cur
            cur = key


def _block_steps(cap_micro: int):
    def run(batches):
        def frame():
            return pd.DataFrame(out, columns=["day", "blk", "left", "bounds", "spent"])

        key, steps, out = None, None, []
        for pdf in batches:
            est, act, start = (pdf[c].values.astype(np.int64) for c in ("est_micro", "act_micro", "start_micro"))
            for k, lo, hi, begins in _runs(pdf, ["day", "blk"], key):
                if begins:
                    if steps is not None:
                        out.append((*key, left, steps.lo, steps.spent))
                    key, left = k, cap_micro - int(start[lo])
                    steps = Steps(left)
                steps.add(est[lo:hi], act[lo:hi])
            yield frame()
            out = []
        if steps is not None:
            out.append((*key, left, steps.lo, steps.spent))
            yield frame()

    return run


def _compose_steps(batches):
    """Applies a day's step functions one after the other: what is left before each block."""
    from bisect import bisect_right

    day, left = None, 0
    for pdf in batches:
        out = []
        for d, bounds, spent, start in zip(pdf["day"].values, pdf["bounds"].values, pdf["spent"].values, pdf["left"].values, strict=True):
            if d != day:
                day, left = d, int(start)
            out.append(left)
            if left >= 0:
                left -= int(spent[bisect_right(bounds, left) - 1])
        yield pd.DataFrame({"day": pdf["day"].values, "blk": pdf["blk"].values, "left": out})


def _admission_fold(cap_micro: int):
    def fold(batches):
        key, spend = None, 0
        for pdf in batches:
            est, act, left = (pdf[c].values.astype(np.int64) for c in ("est_micro", "act_micro", "left"))
            allowed, before = np.zeros(len(pdf), dtype=bool), np.zeros(len(pdf), dtype=np.int64)
            for key, lo, hi, begins in _runs(pdf, ["day", "blk"], key):
                spend = cap_micro - int(left[lo]) if begins else spend
                allowed[lo:hi], before[lo:hi], spend = _fold_tail(est[lo:hi], act[lo:hi], spend, cap_micro)
            out = pd.DataFrame({"request_id": pdf["request_id"].values, "ts": pdf["ts"].values, "day": pdf["day"].values, "act_micro": act,
                                "allowed": allowed, "spend_before_micro": before})
            yield out[pdf["ts"].notna().values]  # without the rows that only bring what is left
    return fold


def admission(requests: DataFrame, daily_cap: str | Decimal) -> DataFrame:
    """T6 per request: (request_id, allowed, spend_before, reason).

    ``requests`` needs request_id, ts, estimated_cost and actual_cost (the
    cost it adds when admitted; 0 for cache hits and failures).

    While the spend of the day so far (every earlier request admitted) plus
    the day's largest estimate stays within the cap, admission is certain;
    that prefix comes from a skew-safe running sum for every day in
    parallel. From the first row where the cap could bind, rows whose estimate
    no longer fits are denied in parallel. Those that may still fit are worked
    in blocks of minutes: each gives what it would spend as a step function of
    what is left (``Steps``), a day's functions are applied one after the other (a
    few numbers a block), and each block is decided from what is really left, so
    that no day is one task."""
    cap = Decimal(str(daily_cap))
    cap_micro = int(cap * SCALE)
    d = requests.select("request_id", "ts", F.to_date("ts").alias("day"),
                        (F.col("estimated_cost") * SCALE).cast("bigint").alias("est_micro"),
                        (F.coalesce(F.col("actual_cost"), F.lit(0)) * SCALE).cast("bigint").alias("act_micro"))
    emax = d.groupBy("day").agg(F.max("est_micro").alias("emax"))  # one row per day
    pre = running_sum(d.withColumn("_a", F.col("act_micro")), ["day"], ["ts", "request_id"],
                      {"_a": "prefix_micro"}, block=_minute(), inclusive=False).drop("_a")
    # the prefix table feeds three branches (certain rows, tail rows, tail
    # starts): checkpoint its slim columns once instead of recomputing them
    pre = cut_lineage(pre.join(emax, "day").select(
        "request_id", "ts", "day", "est_micro", "act_micro", "prefix_micro",
        (F.col("prefix_micro") + F.col("emax") <= cap_micro).alias("_sure")))
    sure = pre.where("_sure").select("request_id", F.lit(True).alias("allowed"),
                                     F.col("prefix_micro").alias("spend_before_micro"))
    tail = pre.where(~F.col("_sure"))
    starts = tail.groupBy("day").agg(F.min("prefix_micro").alias("start_micro"))  # one row per day
    tail = tail.join(starts, "day")
    # spend never falls: what does not fit at the tail's start never will, so only the rest is folded
    fits = F.col("est_micro") + F.col("start_micro") <= cap_micro
    schema = T.StructType([T.StructField("request_id", requests.schema["request_id"].dataType),
                           T.StructField("ts", requests.schema["ts"].dataType), T.StructField("day", T.DateType()),
                           T.StructField("act_micro", T.LongType()), T.StructField("allowed", T.BooleanType()),
                           T.StructField("spend_before_micro", T.LongType())])
    able = tail.where(fits).select("request_id", "ts", "day", _step_block(requests.schema["ts"].dataType).alias("blk"), "est_micro", "act_micro", "start_micro")
    steps = (able.select("day", "blk", "ts", "request_id", "est_micro", "act_micro", "start_micro")
             .repartition("day", "blk").sortWithinPartitions("day", "blk", "ts", "request_id")
             .mapInPandas(_block_steps(cap_micro), "day date, blk bigint, left bigint, bounds array<bigint>, spent array<bigint>"))
    left = (steps.repartition("day").sortWithinPartitions("day", "blk")
            .mapInPandas(_compose_steps, "day date, blk bigint, left bigint"))
    # what is left leads its block as a row without a time; a join here would be planned with the block's own shuffle, which
    # adaptive execution then reads by the piece (local reads, skew), and each piece of a block would begin with all that is left
    zero = F.lit(0).cast("bigint")
    leads = left.select("day", "blk", F.lit(None).cast(schema["ts"].dataType).alias("ts"), F.lit(0).cast(schema["request_id"].dataType).alias("request_id"),
                        zero.alias("est_micro"), zero.alias("act_micro"), "left")
    folded = (able.drop("start_micro").withColumn("left", zero).unionByName(leads).repartition("day", "blk").sortWithinPartitions("day", "blk", "ts", "request_id")
              .mapInPandas(_admission_fold(cap_micro), schema))
    folded = cut_lineage(folded)  # Python state over a day: not to be computed once per branch
    # a row that never fits sees the start's spend and what the fold admitted before it, a prefix sum over minutes
    steps = folded.where("allowed AND act_micro > 0").select("day", "ts", "request_id", "act_micro", F.lit(False).alias("ask"))
    asks = tail.where(~fits).select("day", "ts", "request_id", F.lit(0).cast("bigint").alias("act_micro"), F.lit(True).alias("ask"))
    seen = running_sum(steps.unionByName(asks), ["day"], ["ts", "request_id"], {"act_micro": "more"}, block=_minute(), inclusive=False).where("ask")
    denied = seen.join(starts, "day").select("request_id", F.lit(False).alias("allowed"),
                                             (F.col("start_micro") + F.col("more")).alias("spend_before_micro"))
    out = sure.unionByName(folded.select("request_id", "allowed", "spend_before_micro")).unionByName(denied)
    return _told(out, cap)


def _told(out: DataFrame, cap: Decimal, *carry: str) -> DataFrame:
    """(request_id, allowed, spend_before, reason) of decided rows."""
    spend = (F.col("spend_before_micro").cast("decimal(38,0)") * F.lit(Decimal("0.000001"))).cast(MONEY)
    before_text, after_text = DAILY_CAP_REASON.format(cap=_py_float(cap), current="\0").split("\0")
    reason = F.when(~F.col("allowed"), F.concat(
        F.lit(before_text), F.format_string("%.2f", F.round(spend, 2).cast("double")), F.lit(after_text)))
    return out.select("request_id", "allowed", spend.alias("spend_before"), reason.alias("reason"), *carry)


def micro(money: Column) -> Column:
    return (money * SCALE).cast("bigint")


#: Spending rows a day from where the cap can bind that ``bounds`` folds, in one task a day: by then little is left.
HEAD = 1000


def _head_left(cap_micro: int):
    """Folds each day's head: (day, time of its last row, what is left after it) of the days whose head is full."""
    def fold(batches):
        day, spend, n, until = None, 0, 0, None

        def closed():
            return [(day, until, cap_micro - spend)] if day is not None and n >= HEAD else []

        for pdf in batches:
            out = []
            est, act, start = (pdf[c].values.astype(np.int64) for c in ("est_micro", "act_micro", "start_micro"))
            for (k,), lo, hi, begins in _runs(pdf, ["day"], (day,)):
                if begins:
                    out += closed()
                    day, spend, n = k, int(start[lo]), 0
                spend = _fold_tail(est[lo:hi], act[lo:hi], spend, cap_micro)[2]
                n, until = n + hi - lo, pdf["ts"].iloc[hi - 1]
            yield pd.DataFrame(out, columns=["day", "until", "left"])
        yield pd.DataFrame(closed(), columns=["day", "until", "left"])

    return fold


def bounds(requests: DataFrame, daily_cap: str | Decimal) -> DataFrame:
    """A guess of which requests the cap can admit at all, from requests as ``admission`` takes them: (day, until,
    most) of the days that have many more than it can. Those after ``until`` whose estimate is more than ``most``
    micro-dollars are taken for denied; ``denied_unless`` checks that, once the others are decided.

    A day's spend is followed by minute totals to where the cap can bind, and from there by a fold of at most ``HEAD``
    spending rows (more at equal times), so nothing here grows with a day but aggregates and one partial sort."""
    cap_micro = int(Decimal(str(daily_cap)) * SCALE)
    d = requests.select("request_id", "ts", F.to_date("ts").alias("day"), _minute().alias("minute"), micro(F.col("estimated_cost")).alias("est_micro"),
                        micro(F.coalesce(F.col("actual_cost"), F.lit(0))).alias("act_micro"))
    days = d.groupBy("day").agg(F.max("est_micro").alias("emax"), F.percentile_approx("est_micro", 0.05).alias("cheap"))
    w = Window.partitionBy("day").orderBy("minute")  # minutes, not requests
    spent = d.groupBy("day", "minute").agg(F.sum("act_micro").alias("act_micro")).withColumn("end", F.sum("act_micro").over(w))
    starts = (spent.join(days, "day").where(F.col("end") + F.col("emax") > cap_micro)
              .groupBy("day", "cheap").agg(F.min("minute").alias("from"), F.min_by(F.col("end") - F.col("act_micro"), "minute").alias("start_micro")))
    starts = cut_lineage(starts)  # one row per day
    able = (d.where("act_micro > 0").join(starts.drop("cheap"), "day")
            .where((F.col("minute") >= F.col("from")) & (F.col("est_micro") + F.col("start_micro") <= cap_micro)))
    head = able.withColumn("nth", F.rank().over(Window.partitionBy("day").orderBy("ts", "request_id"))).where(F.col("nth") <= HEAD)
    schema = T.StructType([T.StructField("day", T.DateType()), T.StructField("until", requests.schema["ts"].dataType), T.StructField("left", T.LongType())])
    left = (head.select("day", "ts", "request_id", "est_micro", "act_micro", "start_micro")
            .repartition("day").sortWithinPartitions("day", "ts", "request_id").mapInPandas(_head_left(cap_micro), schema))
    return left.join(starts, "day").select("day", "until", F.greatest(F.col("left") * 2, "cheap").alias("most"))


def may_pass(bounds: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with their day and ``may``: whether ``bounds`` leaves it open that they are admitted."""
    d = requests.withColumn("day", F.to_date("ts")).join(F.broadcast(bounds), "day", "left")  # a row a day
    return d.withColumn("may", F.coalesce(F.col("until").isNull() | (F.col("ts") <= F.col("until")) | (micro(F.col("estimated_cost")) <= F.col("most")), F.lit(True))).drop("until", "most")


def denied_unless(rest: DataFrame, spends: DataFrame, daily_cap: str | Decimal) -> DataFrame:
    """Decides requests that spend nothing, after those that do: (request_id, allowed, spend_before, reason, day,
    est_micro) of ``rest`` (request_id, ts, estimated_cost) by the ``spends`` (request_id, ts, actual_cost) before each."""
    cap = Decimal(str(daily_cap))
    none = F.lit(None).cast("bigint")
    asks = rest.select(F.to_date("ts").alias("day"), "ts", "request_id", micro(F.col("estimated_cost")).alias("est_micro"), F.lit(0).cast("bigint").alias("act_micro"), F.lit(True).alias("ask"))
    steps = spends.select(F.to_date("ts").alias("day"), "ts", "request_id", none.alias("est_micro"), micro(F.col("actual_cost")).alias("act_micro"), F.lit(False).alias("ask"))
    seen = running_sum(asks.unionByName(steps), ["day"], ["ts", "request_id"], {"act_micro": "spend_before_micro"}, block=_minute(), inclusive=False).where("ask")
    return _told(seen.withColumn("allowed", F.col("est_micro") + F.col("spend_before_micro") <= int(cap * SCALE)), cap, "day", "est_micro")


def _py_float(x: Decimal) -> str:
    return str(float(x))


def minute_spend(df: DataFrame, max_per_minute: str = "1.0", cost_col: str = "cost") -> DataFrame:
    """Spend in the trailing 60 seconds at every second with spend,
    against max_per_minute. Per-second totals first (partial aggregation),
    then a sliding sum per day chunk with a halo: no single-task window."""
    ps = df.groupBy(F.unix_timestamp("ts").alias("sec")).agg(F.sum(cost_col).cast(MONEY_SUM).alias("spend"))
    tr = trailing_sum(ps, [], "sec", {"spend_last_minute": 60}, "spend", chunk_seconds=3600)
    return tr.select("sec", "spend", F.col("spend_last_minute").cast(MONEY_SUM).alias("spend_last_minute"),
                     (F.col("spend_last_minute") > F.lit(Decimal(max_per_minute))).alias("over_limit"))


def running_total_cost(df: DataFrame, cost_col: str = "cost") -> DataFrame:
    """Running total over the whole log in (ts, request_id) order; the
    global prefix is built from minute blocks, so no window runs without a
    partition key."""
    d = df.withColumn("_c", F.coalesce(F.col(cost_col), F.lit(0).cast(MONEY)))
    out = running_sum(d, [], ["ts", "request_id"], {"_c": "running_total"},
                      block=_minute(), inclusive=True)
    return out.withColumn("running_total", F.col("running_total").cast(MONEY_SUM)).drop("_c")


def utilisation(df: DataFrame, cost_col: str = "cost") -> DataFrame:
    """Spend per day / week / month against the declared budgets, with
    the alert ladder (notify at 80 %, block at 95 %). One pass to day
    totals; weeks and months roll up from that small table."""
    daily = df.groupBy(F.to_date("ts").alias("day")).agg(F.sum(cost_col).cast(MONEY_SUM).alias("spend"))
    parts = []
    for period, budget in BUDGETS:
        b = F.lit(Decimal(budget)).cast(MONEY)
        g = (daily.groupBy(F.date_trunc(period, F.col("day")).cast("date").alias("period_start"))
                  .agg(F.sum("spend").cast(MONEY_SUM).alias("spend")))
        ratio = F.round(F.col("spend") / b, 6)
        parts.append(g.select(F.lit(period).alias("period"), "period_start", "spend",
                              b.alias("budget"), ratio.cast("decimal(18,6)").alias("utilisation"),
                              F.when(ratio >= F.lit(Decimal(ALERT_BLOCK)), "block")
                               .when(ratio >= F.lit(Decimal(ALERT_NOTIFY)), "notify").otherwise("ok").alias("action")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
