"""Pricing, token estimates and the skew-safe window helpers."""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import cost as fc
from vigil.operators import costs
from vigil.operators.windows import running_sum, trailing_sum


def test_calculate_cost_and_fallback(spark):
    df = spark.createDataFrame([("gpt-3.5-turbo", 1000, 500), ("gpt-4", 1000, 500), ("unknown-model", 1000, 500),
                                ("gpt-3.5-turbo", 1, 0)], "model string, input_tokens long, output_tokens long")
    got = [r.cost for r in costs.price_requests(df).collect()]
    assert got[0] == Decimal("0.001250") and got[1] == Decimal("0.060000") and got[2] == got[0]
    assert got[3] == Decimal("0.000001")  # half-up on the exact decimal (H3)


def test_request_tokens_and_response_tokens(spark):
    df = spark.createDataFrame(
        [([("system", "You are a helpful assistant."), ("user", "What is the weather today?")], None)],
        "messages array<struct<role:string,content:string>>, system string")
    n = df.select(fc.request_tokens(F.col("messages"), F.col("system")).alias("n")).first().n
    assert 10 < n < 50
    r = spark.createDataFrame([((100, 50, 150), None)],
                              "usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>, "
                              "choices array<struct<message:struct<content:string>>>")
    assert r.select(fc.response_tokens(F.col("usage"), F.col("choices")).alias("n")).first().n == 50
    c = spark.createDataFrame([(None, [(("This is a test response with several words.",),)])],
                              "usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>, "
                              "choices array<struct<message:struct<content:string>>>")
    assert 5 < c.select(fc.response_tokens(F.col("usage"), F.col("choices")).alias("n")).first().n < 20


def test_per_request_check(spark):
    df = spark.createDataFrame([(Decimal("0.5"),), (Decimal("0.005"),)], "e decimal(18,6)")
    ok, reason = costs.per_request_check(F.col("e"), 0.01)
    rows = df.select(ok.alias("ok"), reason.alias("r")).collect()
    assert not rows[0].ok and "exceeds per-request limit" in rows[0].r and rows[1].ok and rows[1].r is None


def test_running_sum_matches_plain_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"),
                                     (F.col("id") % 7).alias("v"))
    got = running_sum(df, ["k"], "o", {"v": "rs"}, block=F.floor(F.col("o") / 100), inclusive=True)
    ref = df.withColumn("ref", F.sum("v").over(Window.partitionBy("k").orderBy("o")
                                               .rowsBetween(Window.unboundedPreceding, 0)))
    bad = got.join(ref, ["k", "o"]).where(F.col("rs") != F.col("ref")).count()
    assert bad == 0 and got.count() == 3000


def test_trailing_sum_matches_plain_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 20000).alias("t"),
                                     F.lit(1).alias("v")).dropDuplicates(["k", "t"])
    got = trailing_sum(df, ["k"], "t", {"w": 500}, "v", chunk_seconds=1000)
    ref = df.withColumn("ref", F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(-499, 0)))
    bad = got.join(ref, ["k", "t"]).where(F.col("w") != F.col("ref")).count()
    assert bad == 0 and got.count() == df.count()


def test_cluster_conf_sizes_partitions():
    from vigil.session import cluster_conf
    conf = cluster_conf(100 * (1 << 40), executors=1000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 1024
    assert conf["spark.sql.adaptive.enabled"] == "true" and conf["spark.sql.session.timeZone"] == "UTC"
    small = cluster_conf(1 << 30, executors=2)
    assert int(small["spark.sql.shuffle.partitions"]) == 32  # at least two tasks per core
