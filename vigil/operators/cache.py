"""Response cache: replay (T5), table build (K3), lookup (J3), hit stats
(A13) and invalidation (P19).

Replay is anchored: an entry is stored by a successfully answered miss at
t0 and serves hits while t < t0 + ttl; hits do not refresh it and the first
request at or after expiry misses again. So the store after one at t0 is the
first storable request at or after t0 + ttl, its *successor*, and a key's stores
are the chain of successors from its first storable request. Neither a session
window nor lag expresses that, and folding a key from its start would put a hot
key into one task. Here a key is cut into chunks of ``CHUNK_TTLS`` times the ttl:

1. Each (key, chunk), on its own, finds every storable request's successor by
   one sorted search and, by pointer doubling, the last store of the chain from
   it. What the chunk does to an expiry that comes in is a step function, from
   the requests that can be first: chains merge, so it has few steps.
2. Per key, these functions are applied one after the other: a few numbers per
   chunk, bounded by the time span and not by the requests.
3. Each (key, chunk) is replayed from the expiry that really comes in.

Steps 1 and 3 spread a key that holds all requests over its chunks; both work
on Arrow batches without a loop over rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a chunk in times to live.
CHUNK_TTLS = 16


def _fold_key(t: np.ndarray, ok: np.ndarray, e_in: int | None, ttl_us: int):
    """One key's sorted times -> (hit flags, entry time per row, new state), the plain form.

    ``e_in`` is the store time of the live entry carried in (or None)."""
    n = len(t)
    hit = np.zeros(n, dtype=bool)
    entry = np.full(n, -1, dtype=np.int64)
    store = e_in
    i = 0
    while i < n:
        if store is not None:
            j = int(np.searchsorted(t, store + ttl_us, side="left"))
            if j > i:  # rows i..j-1 fall inside the live entry
                hit[i:j] = True
                entry[i:j] = store
                i = j
                if i >= n:
                    break
        # row i is a miss; it stores when answered successfully
        if ok[i]:
            store = int(t[i])
            entry[i] = store
        i += 1
    return hit, entry, store


def _changes(batch, cols=("cache_key", "chunk")) -> np.ndarray:
    """Where rows of a sorted Arrow batch begin another group."""
    import pyarrow.compute as pc

    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in cols if n > 1 else ():
        x, y = batch.column(c).slice(1), batch.column(c).slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
        none = pc.is_null(x).to_numpy(zero_copy_only=False) != pc.is_null(y).to_numpy(zero_copy_only=False)
        new[1:] |= differs | none
    return new


def _successors(place: np.ndarray, group: np.ndarray, ttl: int) -> np.ndarray:
    """Of sorted places (group * span + time in the chunk), the next one of the group at least ``ttl`` on, or -1."""
    nxt = np.searchsorted(place, place + ttl)
    inside = nxt < len(place)
    inside[inside] = group[nxt[inside]] == group[inside]
    return np.where(inside, nxt, -1)


def _summarise(ttl: int, width: int):
    """(key, chunk, bounds, exits): an expiry up to ``bounds[i]`` (and beyond the bound before) that comes into the
    chunk leaves it with the last store at ``exits[i]``; one beyond all bounds leaves as it came."""
    span = width + ttl

    def functions(keys, t, group, starts):
        import pyarrow as pa

        # t: distinct storable times, sorted by group, with the group's number and each group's start of the chunk
        step = _successors(group * span + (t - starts[group]), group, ttl)
        last = np.where(step >= 0, step, np.arange(len(t)))
        while len(t) and (further := last[last] != last).any():  # as many rounds as the logarithm of a chunk's stores
            last = np.where(further, last[last], last)
        off = t - starts[group]
        first = np.ones(len(t), dtype=bool)
        first[1:] = (group[1:] != group[:-1]) | (off[:-1] < ttl)  # can be the first at or after an expiry that comes in
        at = np.flatnonzero(first)
        keep = np.ones(len(at), dtype=bool)
        keep[:-1] = (last[at][1:] != last[at][:-1]) | (group[at][1:] != group[at][:-1])
        at = at[keep]
        ends = np.searchsorted(group[at], np.arange(len(starts) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (t[at], t[last[at]])]
        return pa.RecordBatch.from_arrays([*keys, *lists], ["cache_key", "chunk", "bounds", "exits"])

    def run(batches):
        import pyarrow as pa

        held_key, held = None, []  # the last group may go on in the next batch
        for b in batches:
            if b.num_rows == 0:
                continue
            new = _changes(b)
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            t, ok = b.column("t_us").fill_null(0).to_numpy(), b.column("ok").to_numpy(zero_copy_only=False)
            name = lambda row: (b.column("cache_key")[row].as_py(), b.column("chunk")[row].as_py())  # noqa: B023, E731
            if held_key != name(0):
                if held_key is not None:
                    yield emit(held_key, held)
                held_key, held = name(0), []
            held.append(t[ok & (group == 0)])
            n = len(at)
            if n == 1:
                continue
            yield emit(held_key, held)
            if n > 2:
                whole = ok & (group >= 1) & (group < n - 1)
                tt, gg = t[whole], group[whole] - 1
                fresh = np.ones(len(tt), dtype=bool)
                fresh[1:] = (tt[1:] != tt[:-1]) | (gg[1:] != gg[:-1])
                keys = [b.column(c).take(pa.array(at[1:-1])) for c in ("cache_key", "chunk")]
                yield functions(keys, tt[fresh], gg[fresh], keys[1].fill_null(0).to_numpy() * width)
            held_key, held = name(int(at[-1])), [t[ok & (group == n - 1)]]
        if held_key is not None:
            yield emit(held_key, held)

    def emit(key, held):
        import pyarrow as pa

        t = np.unique(np.concatenate(held))
        keys = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64())]
        return functions(keys, t, np.zeros(len(t), dtype=np.int64), np.array([(key[1] or 0) * width]))

    return run


def _compose(ttl: int, width: int):
    """The expiry that comes into each chunk, where it matters there: (key, chunk, expiry)."""

    def run(batches):
        from bisect import bisect_left

        import pyarrow as pa

        key, expiry = None, None
        for b in batches:
            keys, chunks, expiries = [], [], []
            for k, c, bounds, exits in zip(*(b.column(x).to_pylist() for x in ("cache_key", "chunk", "bounds", "exits")), strict=True):
                if k != key:
                    key, expiry = k, None
                if c is None:
                    continue
                if expiry is not None and expiry > c * width:
                    keys.append(k)
                    chunks.append(c)
                    expiries.append(expiry)
                at = 0 if expiry is None else bisect_left(bounds, expiry)
                if at < len(bounds):
                    expiry = exits[at] + ttl
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(chunks, pa.int64()), pa.array(expiries, pa.int64())], ["cache_key", "chunk", "expiry"])

    return run


def _replay_chunks(ttl: int, width: int, names: list[str]):
    """Rows sorted by (key, chunk), each chunk led by the expiry that comes in -> hits and entries."""
    span = width + ttl
    none = -(1 << 62)

    def run(batches):
        import pyarrow as pa

        at_key, state = None, none  # the last group's expiry, as it may go on
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            new = _changes(b)
            starts_at, group = np.flatnonzero(new), np.cumsum(new) - 1
            heads = [(b.column("cache_key")[i].as_py(), b.column("chunk")[i].as_py()) for i in (0, int(starts_at[-1]))]
            expiry_in = b.column("expiry").fill_null(none).to_numpy()[starts_at]
            if at_key == heads[0]:
                expiry_in = expiry_in.copy()
                expiry_in[0] = state
            start = b.column("chunk").fill_null(0).to_numpy()[starts_at] * width
            t = b.column("t_us").fill_null(0).to_numpy()
            ok = b.column("ok").fill_null(False).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(ok)
            place = group[rows] * span + (t - start[group])[rows]
            fresh = np.ones(len(rows), dtype=bool)
            fresh[1:] = place[1:] != place[:-1]  # of equal times the smallest id stores
            rows, place = rows[fresh], place[fresh]
            step = _successors(place, group[rows], ttl)
            at = np.searchsorted(place, np.arange(len(starts_at)) * span + np.clip(expiry_in - start, 0, span - 1))  # each group's first store
            there = at < len(rows)
            there[there] = group[rows[at[there]]] == np.flatnonzero(there)
            at = at[there]
            stored = np.zeros(n, dtype=bool)
            while len(at):
                stored[rows[at]] = True
                at = step[at]
                at = at[at >= 0]
            last = np.maximum.accumulate(np.where(stored, np.arange(n), -1))
            own = (last >= 0) & (group[np.maximum(last, 0)] == group)
            came = expiry_in[group]
            entry = np.where(own, t[np.maximum(last, 0)], came - ttl)
            hit = ~stored & (t < entry + ttl) & (own | (came > none))
            at_key = heads[1]
            state = int(t[last[-1]]) + ttl if own[-1] else int(expiry_in[-1])
            out = {"cache_hit": pa.array(hit), "entry_stored_us": pa.array(entry, mask=~(hit | stored))}
            got = pa.RecordBatch.from_arrays([out[c] if c in out else b.column(c) for c in names], names)
            yield got.filter(b.column("expiry").is_null())  # without the rows that only bring an expiry

    return run


def replay(requests: DataFrame, ttl_seconds: int, eligible: Column | None = None,
           answered_ok: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """T5 over requests (request_id, cache_key, ts). ``eligible`` marks rows
    that reach the cache step (default all); ``answered_ok`` marks misses
    whose answer is stored (default all). Output per eligible request:
    cache_hit and the store time of the entry involved (NULL for a miss that
    stored nothing). ``carry`` columns pass through unchanged. A request
    without a key or a time is a miss that stores nothing."""
    carry = list(carry or [])
    ttl = int(ttl_seconds) * 1_000_000
    width = ttl * max(1, min(CHUNK_TTLS, 10**14 // max(1, ttl)))  # places in a batch of chunks stay 64-bit numbers
    d = requests
    if eligible is not None:
        d = d.where(eligible)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ok = (answered_ok if answered_ok is not None else F.lit(True)) & F.col("cache_key").isNotNull() & F.col("ts").isNotNull()
    if ttl <= 0:  # entries are never alive
        at = F.when(F.coalesce(ok, F.lit(False)), F.col("ts"))
        return d.select(F.col("request_id").cast("bigint").alias("request_id"), "cache_key", "ts", F.lit(False).alias("cache_hit"), at.alias("entry_stored_at"), *carry)
    d = d.select("cache_key", F.floor(t / F.lit(width)).cast("bigint").alias("chunk"), t.alias("t_us"),
                 F.col("request_id").cast("bigint").alias("request_id"), F.coalesce(ok, F.lit(False)).alias("ok"), *carry)
    times = d.select("cache_key", "chunk", "t_us", "ok").repartition("cache_key", "chunk").sortWithinPartitions("cache_key", "chunk", "t_us")
    steps = times.mapInArrow(_summarise(ttl, width), "cache_key string, chunk bigint, bounds array<bigint>, exits array<bigint>")
    came = (steps.repartition("cache_key").sortWithinPartitions("cache_key", "chunk")
            .mapInArrow(_compose(ttl, width), "cache_key string, chunk bigint, expiry bigint"))
    both = d.withColumn("expiry", F.lit(None).cast("bigint")).unionByName(came, allowMissingColumns=True)
    names = ["request_id", "cache_key", "t_us", "cache_hit", "entry_stored_us", *carry]
    kinds = {"cache_hit": T.BooleanType(), "entry_stored_us": T.LongType()}
    schema = T.StructType([T.StructField(c, kinds.get(c) or d.schema[c].dataType) for c in names])
    out = (both.repartition("cache_key", "chunk").sortWithinPartitions("cache_key", "chunk", F.desc("expiry"), "t_us", "request_id")
           .mapInArrow(_replay_chunks(ttl, width, names), schema))
    ntz = requests.schema["ts"].dataType
    return out.select("request_id", "cache_key", F.timestamp_micros("t_us").cast(ntz).alias("ts"), "cache_hit",
                      F.timestamp_micros("entry_stored_us").cast(ntz).alias("entry_stored_at"), *carry)


def cache_table(replayed: DataFrame, responses: DataFrame | None, ttl_seconds: int) -> DataFrame:
    """K3: the entries the replay stored; last write per key wins. One row
    per key: (cache_key, stored_at, expires_at[, response])."""
    stores = replayed.where(~F.col("cache_hit") & F.col("entry_stored_at").isNotNull())
    if responses is not None:
        stores = stores.join(responses, "request_id", "left")
    cols = [c for c in stores.columns if c not in ("cache_key", "entry_stored_at", "ts", "cache_hit")]
    agg = [F.max("entry_stored_at").alias("stored_at")] + [
        F.max_by(F.col(c), F.struct("entry_stored_at", "request_id")).alias(c) for c in cols]
    t = stores.groupBy("cache_key").agg(*agg)
    return t.withColumn("expires_at", F.col("stored_at") + F.make_interval(secs=F.lit(ttl_seconds)))


def lookup(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Requests against a cache table: hit when the key matches and
    stored_at <= ts < expires_at. One row per key in the table, so the
    equi-join cannot multiply rows."""
    t = table.select("cache_key", "stored_at", "expires_at")
    j = requests.join(t, "cache_key", "left")
    hit = F.coalesce((F.col("stored_at") <= F.col("ts")) & (F.col("ts") < F.col("expires_at")), F.lit(False))
    return j.withColumn("cache_hit", hit).drop("expires_at")


def hit_stats(replayed_with_model: DataFrame) -> DataFrame:
    """Hits and misses per (day, model)."""
    return (replayed_with_model.groupBy(F.to_date("ts").alias("day"), "model")
            .agg(F.count_if(F.col("cache_hit")).alias("hits"),
                 F.count_if(~F.col("cache_hit")).alias("misses")))


def glob_to_regex(pattern: str) -> str:
    """Redis-style glob (* ? [..]) to an anchored regex."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = pattern.find("]", i)
            if j < 0:
                out.append(re.escape(c))
            else:
                out.append("[" + pattern[i + 1:j].replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def invalidate(table: DataFrame, pattern: str) -> DataFrame:
    """Drop entries whose key matches the glob."""
    return table.where(~F.col("cache_key").rlike(glob_to_regex(pattern)))
