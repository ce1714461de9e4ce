"""Sliding-window rate limiting: W1, T1-T4, T12, A12, J8.

The limiter is recursive (a denied request takes no slot, so whether a
request is admitted depends on earlier decisions), which no SQL window can
express. What keeps it cheap and skew-proof:

* A slot is an epoch *second*: every request of a client in the same second
  shares one slot, and only the first request of a second can change the
  state. Requests are therefore pre-aggregated to one row per (client,
  second) with partial aggregation before the shuffle; a client's fold input
  is bounded by the seconds in the time span, not by its request volume.
* The fold streams each client's seconds in time order through
  ``mapInPandas`` (repartition by client, sort within partitions) with state
  bounded by the limits (at most ``limit`` seconds per window): no group is
  ever materialised whole. Long runs are decided as arrays, ``limit`` decisions
  of a window at a time.
* Decisions go back to the requests with an equi-join on (client, second);
  the fold side has one row per key, so AQE can split a skewed request side.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.windows import trailing_sum
from vigil.sources.dims import RATE_LIMIT_REASON, RATE_WINDOWS

WINDOW_OF = {n: (w, s) for n, w, s in RATE_WINDOWS}
REASON = RATE_LIMIT_REASON


def limits_list(rate_limits: dict[str, int]) -> list[tuple[str, int, int, str]]:
    """Policy order kept; unknown limit names are skipped."""
    return [(n, int(v), WINDOW_OF[n][0], WINDOW_OF[n][1]) for n, v in rate_limits.items() if n in WINDOW_OF]


def _short(name: str) -> str:
    return {"requests_per_minute": "minute", "requests_per_hour": "hour", "requests_per_day": "day"}[name]


def per_second(log: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """(client_id, sec) -> n requests and the first request id; reset rows
    (client_id, reset_sec) are added with kind 1 so they sort after the
    requests of their second."""
    ps = (log.where(F.col("sec").isNotNull() & F.col("client_id").isNotNull())
             .groupBy("client_id", "sec")
             .agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first_id"))
             .withColumn("kind", F.lit(0)))
    if resets is not None:
        r = resets.select("client_id", F.col("reset_sec").alias("sec")).distinct() \
            .select("client_id", "sec", F.lit(0).cast("bigint").alias("n"),
                    F.lit(-1).cast(log.schema["request_id"].dataType).alias("first_id"), F.lit(1).alias("kind"))
        ps = ps.unionByName(r)
    return ps


def _fold_schema(limits) -> T.StructType:
    fields = [T.StructField("client_id", T.StringType()), T.StructField("sec", T.LongType()),
              T.StructField("first_id", T.LongType())]
    for tag in ("first", "rest"):
        fields += [T.StructField(f"{tag}_allowed", T.BooleanType()),
                   T.StructField(f"{tag}_reason", T.StringType())]
        fields += [T.StructField(f"{tag}_rem_{_short(n)}", T.LongType()) for n, *_ in limits]
    fields += [T.StructField(f"slot_{_short(n)}", T.BooleanType()) for n, *_ in limits]
    return T.StructType(fields)


def _step(states, t, limits, add, distinct=True):
    """One request against the per-window state: (number of the window that denies it or -1, remaining per window (-1
    where the check did not come), slots taken). With ``distinct`` a second holds one slot however many requests it
    has (the original's sorted-set members are seconds); otherwise every admitted request takes a slot."""
    rem, took = [-1] * len(limits), [False] * len(limits)
    for k, (_, limit, width, _) in enumerate(limits):
        q = states[k]
        while q and q[0] <= t - width:
            q.popleft()
        c = len(q)
        if c >= limit:
            rem[k] = 0
            return k, rem, took
        if add and (not distinct or not q or q[-1] != t):
            q.append(t)
            took[k] = True
        rem[k] = limit - c - 1
    return -1, rem, took


def _check(states, t, limits, add, distinct=True):
    """``_step`` with the answer's words: (allowed, reason, remaining per window (None where not reached), slots taken)."""
    k, rem, took = _step(states, t, limits, add, distinct)
    reason = None if k < 0 else REASON.format(name=limits[k][0], limit=limits[k][1], suffix=limits[k][3])
    return k < 0, reason, [None if x < 0 else x for x in rem], took


#: Rows of one group from which they are decided as arrays.
ARRAY_ROWS = 48


def _accepted(t: np.ndarray, last: np.ndarray, limit: int, width: int) -> np.ndarray:
    """Which of the sorted times one window accepts, after those accepted before (``last``, ascending).

    A request is accepted if the ``limit``-th accepted one before it is at least ``width`` old. So of the next
    ``limit`` accepted ones each has its bound in what is known already: the first place at or after the bound, and
    after the one before it. That is a sorted search and a running maximum for ``limit`` decisions at a time."""
    n = len(t)
    out = np.zeros(n, dtype=bool)
    at = 0
    while at < n and limit > 0:
        j = np.arange(min(limit, n - at))
        known = j + len(last) - limit
        bound = np.full(len(j), at)
        old = known >= 0
        bound[old] = np.maximum(np.searchsorted(t, last[known[old]] + width), at)
        place = j + np.maximum.accumulate(bound - j)
        place = place[place < n]
        out[place] = True
        if len(place) < len(j):
            break
        last = np.concatenate([last, t[place]])[-limit:]
        at = int(place[-1]) + 1
    return out


def _decide_rows(states, t: np.ndarray, many: np.ndarray, limits, distinct: bool):
    """The rows of one group, window by window: what one window accepts is what the next one sees.
    (failed window or -1, remaining, slots taken) of the first request of each row and of the others."""
    n, k_n = len(t), len(limits)
    fail1, fail2 = np.full(n, -1, dtype=np.int8), np.full(n, -1, dtype=np.int8)
    rem1, rem2 = np.full((k_n, n), -1, dtype=np.int64), np.full((k_n, n), -1, dtype=np.int64)  # -1: not reached
    took = np.zeros((k_n, n), dtype=bool)
    reach1, reach2 = np.ones(n, dtype=bool), many.copy()
    for k, (_, limit, width, _) in enumerate(limits):
        before = np.array(states[k], dtype=np.int64)
        seen = np.flatnonzero(reach1)
        took[k, seen] = _accepted(t[seen], before[-limit:] if limit > 0 else before[:0], limit, width)
        held = np.concatenate([before, t[took[k]]])
        count = len(before) + np.cumsum(took[k]) - took[k] - np.searchsorted(held, t - width, side="right")
        ok1 = reach1 & took[k]
        rem1[k] = np.where(ok1, limit - count - 1, np.where(reach1, 0, -1))
        fail1[reach1 & ~took[k]] = k
        after = count + (took[k] if distinct else 0)
        ok2 = reach2 & (after < limit)
        rem2[k] = np.where(ok2, limit - after - 1, np.where(reach2, 0, -1))
        fail2[reach2 & ~ok2] = k
        reach1, reach2 = ok1, ok2
        states[k] = deque(held[np.searchsorted(held, t[-1] - width, side="right"):].tolist()) if n else states[k]
    return (fail1, rem1, took), (fail2, rem2)


def make_fold(limits, group_cols=("client_id",), ctx_col: str | None = None, distinct: bool = True):
    """Iterator fold for mapInPandas over rows sorted by (group, sec, kind).
    State starts empty at each new group and at each reset; rows flagged
    ``ctx_col`` only build state (their decisions belong to another group).
    Long runs of one group are decided as arrays, short ones row by row."""
    k_n = len(limits)
    reasons = np.array([REASON.format(name=n, limit=lim, suffix=suf) for n, lim, _, suf in limits] + [None], dtype=object)

    def fold(batches):
        cur, states = None, [deque() for _ in limits]
        for pdf in batches:
            n = len(pdf)
            t, many = pdf["sec"].values.astype(np.int64), pdf["n"].values > 1
            reset = pdf["kind"].values == 1
            fail1, fail2 = np.full(n, -1, dtype=np.int8), np.full(n, -1, dtype=np.int8)
            rem1, rem2 = np.full((k_n, n), -1, dtype=np.int64), np.full((k_n, n), -1, dtype=np.int64)
            took = np.zeros((k_n, n), dtype=bool)
            cut = reset.copy()  # a run is cut where a group begins, and around resets
            cut[1:] |= reset[:-1]
            for c in group_cols:
                v = pdf[c].values
                cut[1:] |= v[1:] != v[:-1]
            cuts = np.flatnonzero(cut).tolist()
            for lo, hi in zip([0, *[c for c in cuts if c]], [*[c for c in cuts if c], n], strict=True) if n else ():
                group = tuple(pdf[c].values[lo] for c in group_cols)
                if group != cur or reset[lo]:
                    cur, states = group, [deque() for _ in limits]
                if reset[lo]:
                    continue
                if hi - lo >= ARRAY_ROWS:
                    (fail1[lo:hi], rem1[:, lo:hi], took[:, lo:hi]), (fail2[lo:hi], rem2[:, lo:hi]) = _decide_rows(states, t[lo:hi], many[lo:hi], limits, distinct)
                    continue
                for i in range(lo, hi):
                    fail1[i], rem1[:, i], took[:, i] = _step(states, int(t[i]), limits, True, distinct)
                    if many[i]:
                        fail2[i], rem2[:, i], _ = _step(states, int(t[i]), limits, False, distinct)
            keep = ~reset & ~(pdf[ctx_col].values.astype(bool) if ctx_col else np.zeros(n, dtype=bool))
            many = many[keep]
            number = lambda x: pd.arrays.IntegerArray(x[keep].copy(), x[keep] < 0)  # noqa: B023, E731
            out = {"client_id": pdf["client_id"].values[keep], "sec": t[keep], "first_id": pdf["first_id"].values[keep].astype(np.int64),
                   "first_allowed": fail1[keep] < 0, "first_reason": reasons[fail1[keep]]}
            out |= {f"first_rem_{_short(x[0])}": number(rem1[k]) for k, x in enumerate(limits)}
            out |= {"rest_allowed": pd.arrays.BooleanArray(fail2[keep] < 0, ~many), "rest_reason": np.where(many, reasons[fail2[keep]], None)}
            out |= {f"rest_rem_{_short(x[0])}": number(rem2[k]) for k, x in enumerate(limits)}
            yield pd.DataFrame(out | {f"slot_{_short(x[0])}": took[k][keep] for k, x in enumerate(limits)})

    return fold


def fold_seconds(per_sec: DataFrame, limits) -> DataFrame:
    """T1/T2 fold over each client's whole timeline: one decision row per
    (client, second) for its first request and for any later request of the
    same second."""
    ordered = per_sec.repartition("client_id").sortWithinPartitions("client_id", "sec", "kind")
    return ordered.mapInPandas(make_fold(limits), _fold_schema(limits))


def fold_seconds_chunked(per_sec: DataFrame, limits) -> DataFrame:
    """Same result as ``fold_seconds``, with a client's timeline split into
    chunks of the largest window (a day).

    A second is *calm* when the offered load (distinct seconds in each
    window, a sliding sum) leaves room in every window whatever was denied
    before: then it is admitted, and if the whole previous chunk was calm
    too, the state equals the offered seconds, so its decision follows from
    the sliding counts alone (JVM, parallel). Only chunks with a non-calm
    second (or a reset), and the chunk after them, go through the fold; runs
    of such chunks form independent segments, each replayed from the calm
    chunk before it. A hot client is thus split by day, and a client that
    stays under its limits never reaches Python."""
    from pyspark.sql import Window

    wmax = max(w for _, _, w, _ in limits)
    cnt_cols = {f"_cnt{k}": w for k, (_, _, w, _) in enumerate(limits)}
    # a reset counts as no request; it is a row of its own, after the requests of its second
    counted = trailing_sum(per_sec.withColumn("_one", 1 - F.col("kind").cast("bigint")), ["client_id"], "sec",
                           cnt_cols, "_one", chunk_seconds=wmax, keep_chunk=True).drop("_one")
    extra = F.when(F.col("n") > 1, 1).otherwise(0)
    calm = F.lit(True)
    for k, (_, lim, _, _) in enumerate(limits):
        calm = calm & ((F.col(f"_cnt{k}") - 1 + extra) < lim)
    rows = counted.withColumn("_hot", (F.col("kind") == 1) | ~calm)

    # one row per (client, chunk), bounded by the time span and not by request volume: a hot chunk and its
    # successor (whose windows reach back) are folded; runs of them are segments, named by their first chunk;
    # the calm chunk before a segment is its context
    w = Window.partitionBy("client_id").orderBy("_chunk")
    # (all columns of the rows are read here too, so that their exchange is made once and reused below)
    days = rows.groupBy("client_id", "_chunk").agg(F.max("_hot").alias("_hot"), F.count("first_id").alias("_rows")).where("_rows >= 0")
    follows = F.coalesce(F.lag("_chunk").over(w) == F.col("_chunk") - 1, F.lit(False))
    days = days.withColumn("_follows", follows).withColumn("_fold", F.col("_hot") | (follows & F.coalesce(F.lag("_hot").over(w), F.lit(False))))
    days = days.withColumn("_start", F.col("_fold") & ~(F.col("_follows") & F.coalesce(F.lag("_fold").over(w), F.lit(False))))
    days = days.select(
        "client_id", "_chunk", "_fold",
        F.when(F.col("_fold"), F.last(F.when(F.col("_start"), F.col("_chunk")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .when(F.lead("_start").over(w) & (F.lead("_chunk").over(w) == F.col("_chunk") + 1), F.col("_chunk") + 1).alias("_seg"))
    rows = rows.drop("_hot").join(days, ["client_id", "_chunk"])
    fold_in = (rows.where(F.col("_fold") | (F.col("_seg").isNotNull() & (F.col("kind") == 0)))
               .select("client_id", "sec", "n", "first_id", "kind", "_seg", (~F.col("_fold")).alias("_ctx")))
    folded = (fold_in.repartition("client_id", "_seg").sortWithinPartitions("client_id", "_seg", "sec", "kind")
              .mapInPandas(make_fold(limits, ("client_id", "_seg"), "_ctx"), _fold_schema(limits)))

    fast = rows.where(~F.col("_fold") & (F.col("kind") == 0))
    many = F.col("n") > 1
    fast_cols = [F.col("client_id"), F.col("sec"), F.col("first_id").cast("bigint").alias("first_id"),
                 F.lit(True).alias("first_allowed"), F.lit(None).cast("string").alias("first_reason")]
    fast_cols += [(F.lit(lim) - F.col(f"_cnt{k}")).cast("bigint").alias(f"first_rem_{_short(n)}")
                  for k, (n, lim, _, _) in enumerate(limits)]
    fast_cols += [F.when(many, True).alias("rest_allowed"), F.lit(None).cast("string").alias("rest_reason")]
    fast_cols += [F.when(many, F.lit(lim) - F.col(f"_cnt{k}") - 1).cast("bigint").alias(f"rest_rem_{_short(n)}")
                  for k, (n, lim, _, _) in enumerate(limits)]
    fast_cols += [F.lit(True).alias(f"slot_{_short(n)}") for n, *_ in limits]
    return fast.select(*fast_cols).unionByName(folded)


def fold_requests(log: DataFrame, limits, resets: DataFrame | None = None) -> DataFrame:
    """count_mode='requests': every admitted request takes a slot, so each
    request is its own fold row (sorted by second, then id)."""
    rows = (log.where(F.col("sec").isNotNull())
               .select("client_id", "sec", F.lit(1).cast("bigint").alias("n"),
                       F.col("request_id").cast("bigint").alias("first_id"), F.lit(0).alias("kind")))
    if resets is not None:
        rows = rows.unionByName(resets.select("client_id", F.col("reset_sec").alias("sec")).distinct().select(
            "client_id", "sec", F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("first_id"),
            F.lit(1).alias("kind")))
    ordered = rows.repartition("client_id").sortWithinPartitions("client_id", "sec", "kind", "first_id")
    return ordered.mapInPandas(make_fold(limits, distinct=False), _fold_schema(limits))


def decisions(log: DataFrame, rate_limits: dict[str, int], resets: DataFrame | None = None,
              strategy: str = "chunked", count_mode: str = "distinct_seconds",
              keep: list[str] | None = None) -> DataFrame:
    """T1 + T2 + T4 + T12 per request: allowed, reason, remaining per window
    (NULL where the check stopped before it), min_remaining. Rows without a
    time or without a client fail open with full remaining. ``strategy``:
    'chunked' splits clients by day with a parallel fast path for calm days,
    whatever the size; 'serial' folds each client's whole timeline in one
    streaming pass (the plain form that tests compare with).
    ``count_mode='requests'``
    counts every request instead of every active second (what the
    original's documentation promises; one fold row per request).
    ``keep``: further columns of ``log`` carried through the join back, so
    a caller needs no second join on the request id."""
    keep = [c for c in (keep or []) if c not in ("request_id", "client_id", "sec")]
    limits = limits_list(rate_limits)
    if count_mode == "requests":
        folded = fold_requests(log, limits, resets)
        keyed = log.select("request_id", "client_id", "sec", *keep)
        j = keyed.join(folded.drop("client_id", "sec").withColumnRenamed("first_id", "request_id"),
                       on="request_id", how="left").withColumn("first_id", F.col("request_id"))
        return _decide(j, limits, keep)
    fold = fold_seconds if strategy == "serial" else fold_seconds_chunked
    folded = fold(per_second(log, resets), limits)
    keyed = log.select("request_id", "client_id", "sec", *keep)
    j = keyed.join(folded, on=["client_id", "sec"], how="left")
    return _decide(j, limits, keep)


def _decide(j: DataFrame, limits, keep: list[str] = ()) -> DataFrame:
    is_first = F.col("request_id") == F.col("first_id")
    fail_open = F.col("sec").isNull() | F.col("client_id").isNull()
    out = j.select(
        "request_id", "client_id", "sec", *keep,
        F.when(fail_open, True).when(is_first, F.col("first_allowed")).otherwise(F.col("rest_allowed")).alias("allowed"),
        F.when(fail_open, None).when(is_first, F.col("first_reason")).otherwise(F.col("rest_reason")).alias("reason"),
        *[F.when(fail_open, F.lit(lim).cast("bigint"))
           .when(is_first, F.col(f"first_rem_{_short(n)}"))
           .otherwise(F.col(f"rest_rem_{_short(n)}")).alias(f"remaining_{_short(n)}")
          for n, lim, *_ in limits],
    )
    rem_cols = [F.col(f"remaining_{_short(n)}") for n, *_ in limits]
    return out.withColumn("min_remaining", F.coalesce(F.least(*rem_cols), F.lit(0).cast("bigint"))
                          if len(rem_cols) > 1 else F.coalesce(rem_cols[0], F.lit(0).cast("bigint")))


def status(folded: DataFrame, rate_limits: dict[str, int], as_of_sec: int) -> DataFrame:
    """Per client and limit at ``as_of_sec``: used = slots held in the
    window, remaining = max(0, limit - used), reset = as_of + window. One
    aggregate over the fold output counts every window at once; the limit
    rows come from exploding a literal array (no union, no join)."""
    limits = limits_list(rate_limits)
    used = folded.groupBy("client_id").agg(*[
        F.count_if(F.col(f"slot_{_short(n)}") & (F.col("sec") > as_of_sec - width)
                   & (F.col("sec") <= as_of_sec)).alias(f"used_{_short(n)}")
        for n, _, width, _ in limits])
    rows = F.array(*[F.struct(F.lit(n).alias("limit_type"), F.lit(lim).cast("bigint").alias("limit"),
                              F.col(f"used_{_short(n)}").cast("bigint").alias("used"),
                              F.lit(width).cast("bigint").alias("width")) for n, lim, width, _ in limits])
    out = used.select("client_id", F.explode(rows).alias("l")).select("client_id", "l.*")
    return out.select("client_id", "limit_type", "limit", "used",
                      F.greatest(F.lit(0).cast("bigint"), F.col("limit") - F.col("used")).alias("remaining"),
                      (F.lit(as_of_sec) + F.col("width")).cast("bigint").alias("reset_time"))


def trailing_request_count(log: DataFrame) -> DataFrame:
    """Offered load, requests per client in (t - w, t] for the three
    windows. Counts go per second first (partial aggregation), the sliding
    sums run per (client, day chunk) with a halo, then join back."""
    ps = log.groupBy("client_id", "sec").agg(F.count(F.lit(1)).alias("n"))
    wins = {f"requests_last_{_short(n)}": w for n, w, _ in RATE_WINDOWS}
    tr = trailing_sum(ps, ["client_id"], "sec", wins, "n")
    return log.select("request_id", "client_id", "sec").join(tr.drop("n"), on=["client_id", "sec"], how="left")
