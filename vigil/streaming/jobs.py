"""Structured Streaming twins of the batch jobs: T7, T8, T9, T1, T12, T5, T10, T11.

Event time comes from the log (the original used the server clock); the
watermark bounds state: counters close 7 days after their day, rate-limit
state is dropped a day after a client's last request (no window can still
hold a slot), cache state when the entry has expired.

Rows inside a micro-batch are unordered, so the stateful handlers sort by
event time before folding; rows behind the watermark are dropped (the
original has no late data).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from vigil.operators import access_log, cache, costs, rate_limit
from vigil.sources import fixtures
from vigil.sources.dims import COUNTER_RETENTION_DAYS, MONEY_SUM


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream of parquet files (schema taken from the files)."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _event_time(log: DataFrame) -> DataFrame:
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def cost_counters_stream(events: DataFrame) -> DataFrame:
    """T7 + T8: running day and model-day counters; the 7-day watermark
    evicts closed days (counter retention)."""
    tracked = costs.tracked_requests(_event_time(fixtures.request_log(events)))
    return (tracked.withWatermark("ts", f"{COUNTER_RETENTION_DAYS} days")
            .groupBy(F.window("ts", "1 day").alias("w"), "model")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast(MONEY_SUM).alias("cost"))
            .select(F.to_date(F.col("w.start")).alias("day"), "model", "requests", "input_tokens",
                    "output_tokens", "cost"))


def merge_counters(path: str):
    """K1/K2 stream sink for ``foreachBatch``: each epoch's new totals go to a
    folder of their own, ``path/epoch=N``; nothing is read or overwritten but
    that epoch's own folder when it is retried, so no failure can lose
    counters. ``read_counters`` takes the latest total of each group."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return sink


COUNTER_SCHEMA = "day date, model string, requests bigint, input_tokens bigint, output_tokens bigint, cost decimal(28,6), epoch bigint"


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters as of the latest epoch: (day, model) -> totals."""
    rows = spark.read.schema(COUNTER_SCHEMA).parquet(path)
    values = [c for c in rows.columns if c not in ("day", "model", "epoch")]
    return (rows.groupBy("day", "model").agg(F.max(F.struct("epoch", *values)).alias("v"))
            .select("day", "model", *[F.col(f"v.{c}").alias(c) for c in values]))


def compact_counters(spark: SparkSession, path: str, target: str) -> None:
    """Writes the current counters as one epoch of a new table, so that old epochs can be removed with ``path``."""
    rows = spark.read.schema(COUNTER_SCHEMA).parquet(path).agg(F.max("epoch")).first()[0]
    if rows is not None:
        read_counters(spark, path).write.mode("overwrite").parquet(f"{target.rstrip('/')}/epoch={rows}")


def start_counter_table(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """T7 + T9: counters refreshed on a trigger (30 s by default, as the
    dashboard) into files; ``{'availableNow': True}`` processes what exists
    and stops."""
    return (cost_counters_stream(events).writeStream.outputMode("update")
            .foreachBatch(merge_counters(path)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())


#: How far behind the newest event a request may come and still be decided by the stateful streams.
LATE_BY = "1 day"


def _expire(state, at_ms: int) -> None:
    """Lets the state go at ``at_ms`` of event time; a timeout must lie beyond the watermark, so state whose
    time has already come is dropped at once."""
    if at_ms > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(at_ms)
    else:
        state.remove()


#: Rows of one frame that a stateful handler gives out.
OUT_ROWS = 10_000


def _gathered(pdfs, *cols: str) -> list[np.ndarray]:
    """The given number columns of a key's rows of a micro-batch: each Arrow batch goes once its numbers are taken, so
    a hot key costs a few numbers a row."""
    parts = [[p[c].values.astype(np.int64) for c in cols] for p in pdfs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def undecided(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Batch side output: requests that came later than the streams accept, and so have no decision."""
    return requests.join(decisions.select("request_id").distinct(), "request_id", "left_anti")


# --- T1: rate limiting with per-client state ---------------------------------

def _rate_state_schema(limits) -> T.StructType:
    return T.StructType([T.StructField(f"w{k}", T.ArrayType(T.LongType())) for k in range(len(limits))])


def _rate_output_schema(limits) -> T.StructType:
    return T.StructType([T.StructField("request_id", T.LongType()), T.StructField("client_id", T.StringType()),
                         T.StructField("sec", T.LongType()), T.StructField("allowed", T.BooleanType()),
                         T.StructField("reason", T.StringType())] +
                        [T.StructField(f"remaining_{rate_limit._short(n)}", T.LongType()) for n, *_ in limits])


def rate_limit_stream(keyed: DataFrame, rate_limits: dict[str, int], late_by: str = LATE_BY) -> DataFrame:
    """T1/T2 per request as a stream; state per client is at most ``limit``
    seconds per window. Requests are decided in order of arrival: one that is
    older than the client's last decided second counts at that second. Those
    more than ``late_by`` behind the newest event get no row (``undecided``)."""
    limits = rate_limit.limits_list(rate_limits)
    max_w = max(w for _, _, w, _ in limits)

    def handle(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        prev = state.get if state.exists else tuple([] for _ in limits)
        states = [deque(int(x) for x in (prev[k] or [])) for k in range(len(limits))]
        ids, secs = _gathered(pdfs, "request_id", "sec")
        order = np.lexsort((ids, secs))
        newest = max((q[-1] for q in states if q), default=None)
        cols = [f.name for f in _rate_output_schema(limits).fields]

        def frame(rows):
            out = pd.DataFrame(rows, columns=cols)
            for c in cols:
                if c.startswith("remaining_"):
                    out[c] = out[c].astype("Int64")
            return out

        rows, last, seen = [], newest or 0, newest
        for rid, own in zip(ids[order].tolist(), secs[order].tolist()):
            sec = max(int(own), last)
            first = sec != seen
            seen = sec
            a, r, rem, _ = rate_limit._check(states, sec, limits, add=first)
            rows.append((int(rid), key[0], int(own), a, r, *rem))
            last = sec
            if len(rows) >= OUT_ROWS:
                yield frame(rows)
                rows = []
        state.update(tuple(list(q) for q in states))
        _expire(state, (last + max_w) * 1000)
        yield frame(rows)

    s = keyed.select("request_id", "client_id", "sec", F.col("ts").cast("timestamp").alias("ts"))
    known = F.col("client_id").isNotNull() & F.col("sec").isNotNull()
    # A request without a client or a time fails open, as in batch, and never meets the state
    open_ = s.where(~known).select(
        F.col("request_id").cast("bigint").alias("request_id"), "client_id", F.col("sec").cast("bigint").alias("sec"), F.lit(True).alias("allowed"),
        F.lit(None).cast("string").alias("reason"), *[F.lit(lim).cast("bigint").alias(f"remaining_{rate_limit._short(n)}") for n, lim, *_ in limits])
    return (s.where(known).withWatermark("ts", late_by).groupBy("client_id")
            .applyInPandasWithState(handle, _rate_output_schema(limits), _rate_state_schema(limits),
                                    "append", GroupStateTimeout.EventTimeTimeout)).unionByName(open_)


# --- T5: cache replay with per-key state --------------------------------------

CACHE_OUT = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("cache_key", T.StringType()),
                          T.StructField("cache_hit", T.BooleanType())])
CACHE_STATE = T.StructType([T.StructField("store_us", T.LongType())])


def cache_replay_stream(keyed: DataFrame, ttl_seconds: int, late_by: str = LATE_BY) -> DataFrame:
    """T5 as a stream; state per key is the live entry's store time. A request
    older than the entry it finds counts as of the entry's time; those more
    than ``late_by`` behind the newest event get no row (``undecided``)."""
    ttl_us = int(ttl_seconds) * 1_000_000

    def handle(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        store = state.get[0] if state.exists else None
        ids, times, ok = _gathered(pdfs, "request_id", "t_us", "ok")
        order = np.lexsort((ids, times))
        ids, t = ids[order], np.maximum(times[order], store or 0)
        hit, _, store = cache._fold_key(t, ok[order].astype(bool), store, ttl_us)
        if store is not None:
            state.update((store,))
            _expire(state, (store + ttl_us) // 1000)
        for at in range(0, len(ids), OUT_ROWS):
            yield pd.DataFrame({"request_id": ids[at:at + OUT_ROWS], "cache_key": key[0], "cache_hit": hit[at:at + OUT_ROWS]})

    s = keyed.select("request_id", "cache_key", F.col("ts").cast("timestamp").alias("ts"),
                     F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
                     (F.col("status") == 200).alias("ok") if "status" in keyed.columns else F.lit(True).alias("ok"))
    return (s.withWatermark("ts", late_by).groupBy("cache_key")
            .applyInPandasWithState(handle, CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# --- J5: requests with their answers ----------------------------------------------

def pair_stream(requests: DataFrame, responses: DataFrame, within: str = "10 minutes", late_by: str = LATE_BY) -> DataFrame:
    """J5 as a stream: each request (request_id, ts, ..) with the answer
    (request_id, answered_at, ..) that comes up to ``within`` after it. Both
    sides' state goes once the watermark has passed the bound; a request
    without an answer is emitted then, with nulls."""
    q = requests.withWatermark("ts", late_by).alias("q")
    a = responses.withColumnRenamed("request_id", "_rid").withWatermark("answered_at", late_by).alias("a")
    bound = F.expr(f"_rid = request_id AND answered_at >= ts AND answered_at <= ts + INTERVAL {within}")
    return q.join(a, bound, "left").drop("_rid")


# --- T10: live access log -----------------------------------------------------------

#: Bytes of a file whose lines one block of the entry count holds.
ENTRY_BLOCK = 1 << 20
OPEN_SCHEMA = "file string, at bigint, line string, base bigint"


def _open_entries(lines: DataFrame) -> DataFrame:
    """Of each file the lines that make its last entry so far (at most three: the HTTP line, the last cost, a PII line),
    with the number of entries before it."""
    parsed = access_log.parse_lines(lines.withColumn("line_no", F.col("at"))).select(
        "file", F.col("line_no").alias("at"), "is_http", F.col("cost").isNotNull().alias("is_cost"), "is_pii")
    told = lines.join(parsed.where("is_http OR is_cost OR is_pii"), ["file", "at"])
    last = told.groupBy("file").agg(F.max(F.when(F.col("is_http"), F.col("at"))).alias("http_at"),
                                    (F.count_if("is_http") - 1 + F.coalesce(F.max("base"), F.lit(0))).alias("base")).where("http_at IS NOT NULL")
    own = told.drop("base").join(last, "file").where("at >= http_at")
    line = F.struct("at", "line")
    kept = own.groupBy("file", "base").agg(*[F.max(F.when(F.col(c), line)).alias(c) for c in ("is_http", "is_cost", "is_pii")])
    return (kept.select("file", "base", F.explode(F.array_distinct(F.array_compact(F.array("is_http", "is_cost", "is_pii")))).alias("l"))
            .select("file", F.col("l.at").alias("at"), F.col("l.line").alias("line"), "base"))


def live_access_log(spark: SparkSession, directory: str, sink, state_dir: str, checkpoint: str, suffix: str = "",
                    trigger: dict | None = None):
    """Entries of log files as lines are appended to them. ``sink(entries, epoch)`` gets each entry whose lines
    are new, keyed by (file, line_no), the byte of its HTTP line; an entry that gets a cost or PII line later comes
    again, with both. The last entry of each file is kept between batches in ``state_dir``, a folder per epoch that
    only that epoch writes, so a retried epoch gives the same."""
    from vigil.session import cut_lineage
    from vigil.sources.log_tail import follow

    def per_batch(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        lines = batch.withColumn("base", F.lit(None).cast("bigint"))
        if epoch > 0:
            lines = lines.unionByName(s.read.schema(OPEN_SCHEMA).parquet(f"{state_dir}/epoch={epoch - 1}"))
        lines = cut_lineage(lines)
        numbered = lines.withColumn("line_no", F.col("at")).withColumn("block", F.floor(F.col("at") / ENTRY_BLOCK))
        e = access_log.entries(access_log.parse_lines(numbered), order=["block", "line_no"])
        base = lines.where("base IS NOT NULL").groupBy("file").agg(F.max("base").alias("_base"))
        e = e.join(base, "file", "left").withColumn("entry_id", F.col("entry_id") + F.coalesce("_base", F.lit(0))).drop("_base")
        fresh = batch.select("file").distinct()
        sink(access_log.describe(e.join(fresh, "file", "left_semi")), epoch)
        _open_entries(lines).write.mode("overwrite").parquet(f"{state_dir}/epoch={epoch}")

    w = follow(spark, directory, suffix).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


# --- T11: policies that change while a stream runs ------------------------------------

def policy_checks_stream(requests: DataFrame, policies_dir: str, versions: str, sink, checkpoint: str, wanted: str = "policy",
                         trigger: dict | None = None):
    """Per-request cost limits of a stream under policies that may change between two batches. Before a batch is
    decided, changed policy files become a new version of the policy table (P12 decides whether they are read at all);
    ``sink(decisions, epoch)`` gets request_id, policy_name, policy_version, allowed and reason. ``requests`` needs
    request_id, estimated_cost and the name of the policy asked for."""

    def per_batch(batch: DataFrame, epoch: int) -> None:
        from vigil.operators import policy

        s = batch.sparkSession
        now = policy.refresh_versions(s, policies_dir, versions)
        in_force = policy.read_versions(s, versions).where(F.col("version") == now)
        d = policy.with_versions(batch.withColumn("policy_version", F.lit(now)), in_force, wanted)
        ok, reason = costs.per_request_check(F.col("estimated_cost"), F.col("max_per_request"))
        ok = F.coalesce(ok, F.lit(True))
        sink(d.select("request_id", "policy_name", "policy_version", ok.alias("allowed"), F.when(~ok, reason).alias("reason")), epoch)

    return (requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())
