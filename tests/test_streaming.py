"""Streaming twins equal the batch jobs (availableNow over the same files)."""

import datetime as dt
import os
import shutil
import tempfile

from pyspark.sql import functions as F

from paths import SF01
from vigil.operators import cache, costs, rate_limit
from vigil.sources import fixtures
from vigil.streaming import jobs

LIMITS = {"requests_per_minute": 1, "requests_per_hour": 2, "requests_per_day": 3}


def _events_dir():
    d = tempfile.mkdtemp(prefix="vigil-ev-")
    shutil.copy(os.path.join(SF01, "events.parquet"), os.path.join(d, "events.parquet"))
    return d


def _run(spark, df, name, mode="append"):
    ck = tempfile.mkdtemp(prefix="vigil-ck-")
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return spark.table(name)


def test_cost_counters_stream_equals_batch(spark):
    ev = jobs.event_stream(spark, _events_dir())
    got = _run(spark, jobs.cost_counters_stream(ev), "counters_t", "update")
    batch = costs.model_daily_stats(fixtures.request_log(spark.read.parquet(os.path.join(SF01, "events.parquet"))))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_rate_limit_stream_equals_batch(spark):
    ev = jobs.event_stream(spark, _events_dir())
    keyed = fixtures.with_client_and_key(fixtures.request_log(ev))
    got = _run(spark, jobs.rate_limit_stream(keyed, LIMITS), "rate_t")
    blog = fixtures.with_client_and_key(fixtures.request_log(spark.read.parquet(os.path.join(SF01, "events.parquet"))))
    batch = rate_limit.decisions(blog, LIMITS).drop("min_remaining")
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(got.columns)).count() == 0


def test_cache_stream_equals_batch(spark):
    ev = jobs.event_stream(spark, _events_dir())
    keyed = fixtures.with_client_and_key(fixtures.request_log(ev)).where(F.col("status") != 429)
    got = _run(spark, jobs.cache_replay_stream(keyed, 6 * 3600), "cache_t")
    blog = fixtures.with_client_and_key(fixtures.request_log(spark.read.parquet(os.path.join(SF01, "events.parquet"))))
    batch = cache.replay(blog, 6 * 3600, eligible=F.col("status") != 429, answered_ok=F.col("status") == 200)
    b = batch.select("request_id", "cache_key", "cache_hit")
    assert got.count() == b.count() and got.exceptAll(b).count() == 0


HTTP = 'INFO:     1.2.3.4:5000 - "{} HTTP/1.1" {}'


def _live(spark, d, seen, state, ck):
    def sink(e, epoch):
        seen.append(sorted(((os.path.basename(r.file), r.entry_id, r.line_no, r.method, r.status, None if r.cost is None else str(r.cost), r.pii_findings)
                            for r in e.collect()), key=str))

    jobs.live_access_log(spark, d, sink, state, ck, suffix=".log", trigger={"availableNow": True}).awaitTermination(600)


def test_live_access_log_reads_what_is_appended(spark):
    d, state, ck, seen = (tempfile.mkdtemp(prefix="vigil-log-") for _ in range(3)), None, None, []
    d, state, ck = d
    a, b = os.path.join(d, "a.log"), os.path.join(d, "b.log")
    post, get = HTTP.format("POST /v1/chat/completions", 200), HTTP.format("GET /health", 404)

    def append(path, text):
        with open(path, "a") as f:
            f.write(text)

    append(a, f"INFO:     _meta_cost cost 9.0\n{post}\n")  # a cost before any request is dropped
    append(os.path.join(d, "other.txt"), post + "\n")
    _live(spark, d, seen, state, ck)
    assert seen[-1] == [("a.log", 1, 30, "POST", 200, None, None)]
    # a detail line for the open entry, and a line that is not finished
    append(a, "noise\nINFO:     _meta_cost cost 0.001250\n" + get[:20])
    append(b, get + "\r\n")
    _live(spark, d, seen, state, ck)
    assert seen[-1] == [("a.log", 1, 30, "POST", 200, "0.001250", None), ("b.log", 1, 0, "GET", 404, None, None)]
    append(a, get[20:] + "\nINFO:     _meta_pii findings 1\n")  # its end, and an entry in the other file that stays as it was
    _live(spark, d, seen, state, ck)
    at = 30 + len(post) + 1 + 6 + len("INFO:     _meta_cost cost 0.001250\n")
    assert seen[-1] == [("a.log", 1, 30, "POST", 200, "0.001250", None), ("a.log", 2, at, "GET", 404, None, 1)]
    append(b, "INFO:     _meta_cost cost 0.5\n" + post + "\n")
    _live(spark, d, seen, state, ck)
    assert [x[:2] + x[5:6] for x in seen[-1]] == [("b.log", 1, "0.500000"), ("b.log", 2, None)]
    n = len(seen)
    _live(spark, d, seen, state, ck)  # nothing new
    assert all(not x for x in seen[n:])
    # all entries, each as it was told last, are those of the whole files
    from vigil.operators import access_log

    last = {x[:2]: x[3:] for batch in seen for x in batch}
    whole = access_log.entries(access_log.parse_lines(access_log.read_access_log(spark, f"{d}/*.log"))).collect()
    assert last == {(os.path.basename(r.file), r.entry_id): (r.method, r.status, None if r.cost is None else str(r.cost), r.pii_findings) for r in whole}


def test_log_tail_blocks_hold_every_line_once():
    from vigil.sources import log_tail

    d = tempfile.mkdtemp(prefix="vigil-log-")
    path = os.path.join(d, "x.log")
    lines = ["", "a", "é" * 40, "long " * 300, "", "z"] * 7
    with open(path, "w", newline="") as f:
        f.write("\n".join(lines) + "\nunfinished")
    source = log_tail._source()({"path": d})
    for size in (1, 7, 64, 10**6):
        source.options["blockBytes"] = str(size)
        r = source.streamReader(None)
        end = r.latestOffset()
        parts = r.partitions({}, end)
        got = sorted((x["at"], x["line"]) for p in parts for batch in r.read(p) for x in batch.to_pylist())
        assert [x for _, x in got] == lines and all(p.hi - p.lo <= size for p in parts)
    assert r.partitions(end, end) == []
    with open(path, "w") as f:
        f.write("new\n")  # started anew, shorter
    got = [x["line"] for p in r.partitions(end, r.latestOffset()) for batch in r.read(p) for x in batch.to_pylist()]
    assert got == ["new"]


def test_access_log_batch_read(spark):
    from vigil.operators import access_log

    d = tempfile.mkdtemp(prefix="vigil-log-")
    with open(os.path.join(d, "b.log"), "w") as f:
        f.write("INFO:     _meta_cost cost 0.5\n"  # before any request line: dropped
                'INFO:     9.9.9.9:5000 - "POST /v1/chat/completions HTTP/1.1" 429\n'
                "INFO:     _meta_cost cost 0.000100\n"
                "INFO:     _meta_cost cost 0.000200\n")  # the later cost line wins
    lines = access_log.read_access_log(spark, d)
    rows = access_log.entries(access_log.parse_lines(lines)).collect()
    assert len(rows) == 1 and rows[0].status == 429 and str(rows[0].cost) == "0.000200"


def test_policies_changed_between_batches_change_decisions(spark, monkeypatch):
    from vigil.operators import policy

    pols, table, d, ck = (tempfile.mkdtemp(prefix="vigil-pol-") for _ in range(4))
    table = os.path.join(table, "versions")
    reads = []
    real = policy.read_policies
    monkeypatch.setattr(policy, "read_policies", lambda *a: reads.append(1) or real(*a))

    def put(name, limit, mtime, enabled="true"):
        path = os.path.join(pols, f"{name}.yaml")
        with open(path, "w") as f:
            f.write(f"name: {name}\nenabled: {enabled}\ncost_limits:\n  max_per_request: {limit}\n")
        os.utime(path, (mtime, mtime))

    def batch(no, rows):
        spark.createDataFrame(rows, "request_id long, estimated_cost decimal(18,6), policy string").coalesce(1).write.parquet(os.path.join(d, f"b{no}"))
        seen = []
        stream = spark.readStream.schema("request_id long, estimated_cost decimal(18,6), policy string").option("recursiveFileLookup", "true").parquet(d)
        jobs.policy_checks_stream(stream, pols, table, lambda e, epoch: seen.extend(e.collect()), ck, trigger={"availableNow": True}).awaitTermination(600)
        return {r.request_id: (r.policy_name, r.policy_version, r.allowed) for r in seen}

    from decimal import Decimal as D

    assert batch(0, [(1, D("0.5"), "strict"), (2, D("5"), None)]) == {1: ("default", 0, False), 2: ("default", 0, False)}  # no file: the built-in default (0.03)
    put("strict", 0.4, 1_700_000_000)
    put("wide", 9.0, 1_700_000_000)
    assert batch(1, [(3, D("0.5"), "strict"), (4, D("5"), "wide"), (5, D("5"), "unknown")]) == {
        3: ("strict", 1, False), 4: ("wide", 1, True), 5: ("strict", 1, False)}
    n = len(reads)
    assert batch(2, [(6, D("0.5"), "strict")]) == {6: ("strict", 1, False)} and len(reads) == n  # nothing changed: no file is read
    put("strict", 0.6, 1_700_000_100)
    assert batch(3, [(7, D("0.5"), "strict")]) == {7: ("strict", 2, True)}
    os.remove(os.path.join(pols, "strict.yaml"))
    assert batch(4, [(8, D("5"), "strict")]) == {8: ("wide", 3, True)}
    # the same by time, over the versions
    v = policy.read_versions(spark, table)
    loads = [r.at for r in v.groupBy("version").agg(F.min("loaded_at").alias("at")).orderBy("version").collect()]
    rows = [(i, at + dt.timedelta(microseconds=shift), "strict") for i, (at, shift) in enumerate([(loads[0], -5), (loads[1], 0), (loads[2], -1), (loads[2], 3), (loads[3], 10**6)])]
    got = policy.with_policies_as_of(spark.createDataFrame(rows, "request_id int, ts timestamp, wanted string"), v, "wanted").orderBy("request_id").collect()
    assert [(r.policy_version, r.policy_name) for r in got] == [(0, "default"), (1, "strict"), (1, "strict"), (2, "strict"), (3, "wide")]
    assert [str(r.max_per_request) for r in got[1:4]] == ["0.400000", "0.400000", "0.600000"]


def test_rate_limit_stream_fails_open(spark):
    rows = [(1, "a", "k", 100, 200), (2, "a", "k", 110, 200), (3, None, "k", 100, 200), (4, "a", "k", None, 200), (5, None, "k", None, 200)]
    stream, table = _files(spark, [rows])
    limits = {"requests_per_minute": 1, "requests_per_day": 5}
    got = _run(spark, jobs.rate_limit_stream(stream, limits), "rate_open")
    want = rate_limit.decisions(table, limits).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {r.request_id: r.allowed for r in got.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_counter_table_merge_sink(spark):
    """Two arrivals in time order (the 7-day watermark drops older data):
    the table ends equal to the batch aggregate over both."""
    src = tempfile.mkdtemp(prefix="vigil-ev2-")
    ev = spark.read.parquet(os.path.join(SF01, "events.parquet"))
    ev.where("ts < '2024-01-16'").write.mode("overwrite").parquet(os.path.join(src, "a"))
    stream = jobs.event_stream(spark, os.path.join(src, "a"))
    table = os.path.join(tempfile.mkdtemp(prefix="vigil-tbl-"), "stats")
    ck = tempfile.mkdtemp(prefix="vigil-ck-")
    q = jobs.start_counter_table(stream, table, ck, {"availableNow": True})
    q.awaitTermination(600)
    # second arrival: the later half of the events in a new file of the same folder
    ev.where("ts >= '2024-01-16'").write.mode("append").parquet(os.path.join(src, "a"))
    q = jobs.start_counter_table(jobs.event_stream(spark, os.path.join(src, "a")), table, ck, {"availableNow": True})
    q.awaitTermination(600)
    got = jobs.read_counters(spark, table)
    want = costs.model_daily_stats(fixtures.request_log(ev))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    for _ in range(2):  # an epoch that is retried replaces its own folder only
        jobs.merge_counters(table)(want.limit(3), 999)
    assert jobs.read_counters(spark, table).exceptAll(want).count() == 0
    jobs.compact_counters(spark, table, table + "-new")
    assert jobs.read_counters(spark, table + "-new").exceptAll(want).count() == 0


KEYED = "request_id long, client_id string, cache_key string, sec long, status int"


def _files(spark, batches):
    """A stream that gets one file per batch, and the same rows as a table."""
    d = tempfile.mkdtemp(prefix="vigil-st-")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, KEYED).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1)
        df.write.parquet(os.path.join(d, f"b{i}"))
        os.utime(os.path.join(d, f"b{i}"), (1_000_000 + i, 1_000_000 + i))
        for f in os.listdir(os.path.join(d, f"b{i}")):
            if f.endswith(".parquet"):
                os.utime(os.path.join(d, f"b{i}", f), (1_000_000 + i, 1_000_000 + i))
    schema = KEYED + ", ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(d)
    return stream, spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(d)


def test_rate_limit_stream_over_files_out_of_order(spark):
    h = 3600
    batches = [[(1, "a", "k", 10 * h, 200), (2, "b", "k", 10 * h + 5, 200)],
               [(3, "a", "k", 10 * h + 30, 200), (4, "c", "k", 13 * h, 200)],
               [(5, "c", "k", 13 * h - 180, 200), (6, "a", "k", 13 * h + 1, 200)],  # 5 comes three minutes late
               [(7, "b", "k", 40 * h, 200)], [(8, "b", "k", 2 * h, 200), (9, "a", "k", 40 * h + 1, 200)]]  # 8 is beyond the delay
    stream, table = _files(spark, batches)
    got = {r.request_id: r.allowed for r in _run(spark, jobs.rate_limit_stream(stream, {"requests_per_minute": 1}, "2 hours"), "rate_ooo").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 9: True}
    late = jobs.undecided(table, spark.createDataFrame([(k,) for k in got], "request_id long"))
    assert [r.request_id for r in late.collect()] == [8]
    # in time order, the stream over several files equals the batch
    ordered = [[(i, f"c{i % 3}", "k", 1000 + 17 * i, 200) for i in range(lo, lo + 20)] for lo in (0, 20, 40)]
    stream, table = _files(spark, ordered)
    limits = {"requests_per_minute": 2, "requests_per_hour": 9}
    got = _run(spark, jobs.rate_limit_stream(stream, limits), "rate_three")
    want = rate_limit.decisions(table, limits).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_cache_stream_with_an_expired_key(spark):
    h = 3600
    batches = [[(1, "u", "x", 10 * h, 200), (2, "u", "y", 10 * h, 200)], [(3, "u", "y", 13 * h, 200), (4, "u", "x", 10 * h + 60, 200)],
               [(5, "u", "x", 13 * h + 5, 400), (6, "u", "z", 13 * h + 9, 400)], [(7, "u", "x", 13 * h + 20, 200), (8, "u", "x", 13 * h + 30, 200)]]
    stream, table = _files(spark, batches)
    got = {r.request_id: r.cache_hit for r in _run(spark, jobs.cache_replay_stream(stream, h, "4 hours"), "cache_ooo").collect()}
    want = {r.request_id: r.cache_hit for r in cache.replay(table, h, answered_ok=F.col("status") == 200).collect()}
    assert got == want and want[4] and not want[5] and want[8]


def test_pair_stream(spark):
    def stream(rows, schema, name):
        d = tempfile.mkdtemp(prefix="vigil-pr-")
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(d, f"{name}{i}"))
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(d)

    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    q = stream([[(1, at(0)), (2, at(1))], [(3, at(2)), (9, at(600))]], "request_id long, ts timestamp", "q")
    a = stream([[(1, at(3), "one"), (2, at(30), "too late")], [(3, at(2), "three"), (9, at(601), "nine")]], "request_id long, answered_at timestamp, answer string", "a")
    got = {r.request_id: r.answer for r in _run(spark, jobs.pair_stream(q, a, late_by="5 minutes"), "pairs_t").collect()}
    assert got[1] == "one" and got[3] == "three" and got[9] == "nine" and got.get(2) is None
