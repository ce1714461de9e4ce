"""JSON sources/sinks and day-partitioned counters."""

import json
import os
import tempfile

from paths import SF01
from vigil.operators import costs, replay
from vigil.sources import fixtures, json_io


def test_read_request_and_replay_report(spark):
    d = tempfile.mkdtemp(prefix="vigil-req-")
    with open(os.path.join(d, "r1.json"), "w") as f:
        json.dump({"messages": [{"content": "List three rivers of the Balkans with their sources.", "role": "user"}, {"content": "Briefly.", "role": "system"}],
                   "top_p": 0.25, "max_tokens": 90, "model": "gpt-4"}, f, indent=1)
    reqs = json_io.read_requests(spark, d)
    from pyspark.sql import functions as F
    from vigil.functions import cost as fc
    r = reqs.select(F.lit("r1").alias("request_id"), "model", F.size("messages").alias("message_count"),
                    fc.request_tokens(F.col("messages"), F.col("system")).alias("input_tokens"), "max_tokens")
    rep = replay.replay_report(r, 0.03, None, None).first()
    # 4 + 4 // 4 + 52 // 4 and 4 + 6 // 4 + 8 // 4 tokens; 25 at 0.03 and 90 at 0.06 a thousand
    assert rep.input_tokens == 18 + 7 and str(rep.estimated_cost) == "0.006150"
    assert rep.per_request_check == "PASS" and rep.caching == "DISABLED" and rep.max_output_tokens == 90
    out = tempfile.mkdtemp(prefix="vigil-out-")
    json_io.write_replay_corpus(reqs, os.path.join(out, "corpus"))
    assert json_io.read_requests(spark, os.path.join(out, "corpus"), multiline=False).count() == 1


def test_counters_roundtrip_with_pruning(spark):
    log = fixtures.request_log(spark.read.parquet(os.path.join(SF01, "events.parquet")))
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-cnt-"), "stats")
    json_io.write_counters(costs.model_daily_stats(log), path)
    daily = json_io.read_daily_costs(spark, path, "2024-01-30")
    assert daily.count() == 7
    plan = json_io.read_model_stats(spark, path, "2024-01-30")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan
