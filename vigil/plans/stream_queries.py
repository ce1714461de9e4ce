"""The streaming jobs over the given event log: read as a stream until its end, written, and read back. Their oracles
are those of the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.plans.cache_queries import REPLAY_TTL, replay_sql
from vigil.plans.limit_queries import LIMITS, TEST_LIMITS, dec_cte
from vigil.plans.registry import ORACLES, query
from vigil.plans.sink_queries import folder
from vigil.sources import fixtures
from vigil.sources.tables import table_path
from vigil.streaming import jobs

NOW = {"availableNow": True}


def events_stream(spark, sf_dir):
    """The table as a stream; the pattern, as the file source takes a single file for a folder of partitions."""
    return jobs.event_stream(spark, table_path(sf_dir, "events") + "*")


def keyed_stream(spark, sf_dir):
    return fixtures.with_client_and_key(fixtures.request_log(events_stream(spark, sf_dir)))


def run(spark, stream, name: str):
    """Appends everything the stream gives to a folder and reads it."""
    path = folder(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", path + "-checkpoint").trigger(**NOW).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("rate_limit_streamed", f"""WITH RECURSIVE {dec_cte(LIMITS)}
SELECT * FROM dec""")
def rate_limit_streamed(spark, sf_dir):
    """T1 / T2 / T12 as a stream with per-client state."""
    return run(spark, jobs.rate_limit_stream(keyed_stream(spark, sf_dir), TEST_LIMITS), "rate")


@query("cache_replay_streamed", f"""WITH RECURSIVE {replay_sql(REPLAY_TTL)}
SELECT request_id, cache_key, hit AS cache_hit FROM f""")
def cache_replay_streamed(spark, sf_dir):
    """T5 as a stream with per-key state."""
    return run(spark, jobs.cache_replay_stream(keyed_stream(spark, sf_dir).where(F.col("status") != 429), REPLAY_TTL), "replay")


@query("cost_counters_streamed", ORACLES["model_daily_stats"])
def cost_counters_streamed(spark, sf_dir):
    """T7 + T8 + T9: the counters kept by the stream, as of its last epoch."""
    path = folder(spark, "streamed")
    jobs.start_counter_table(events_stream(spark, sf_dir), path, path + "-checkpoint", NOW).awaitTermination()
    return jobs.read_counters(spark, path)
