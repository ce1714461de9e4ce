"""JSON request/response sources and sinks (S1, S2, K4, K5) and the
day-partitioned counter tables (K1, K2, S8, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources.dims import MONEY, MONEY_SUM

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

# M1: chat request
REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("system", T.StringType()),
])

# M2: provider response
USAGE = T.StructType([T.StructField("prompt_tokens", T.LongType()),
                      T.StructField("completion_tokens", T.LongType()),
                      T.StructField("total_tokens", T.LongType())])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]))),
    T.StructField("usage", USAGE),
])


def read_requests(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One JSON request per file (multiLine) or per line; the declared
    schema avoids inference and keeps NULL for absent fields (defaults are
    applied by the operators with coalesce)."""
    return spark.read.schema(REQUEST_SCHEMA).option("multiLine", multiline).json(path)


def read_requests_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).option("multiLine", True).json(path)


def read_responses(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """S2."""
    return spark.read.schema(RESPONSE_SCHEMA).option("multiLine", multiline).json(path)


def parse_requests(df: DataFrame, col: str = "request_json") -> DataFrame:
    """S1 from a string column."""
    return df.withColumn("request", F.from_json(F.col(col), REQUEST_SCHEMA))


def parse_responses(df: DataFrame, col: str = "response_json") -> DataFrame:
    """S2 from a string column."""
    return df.withColumn("response", F.from_json(F.col(col), RESPONSE_SCHEMA))


def write_replay_corpus(requests: DataFrame, path: str) -> None:
    """K4: requests saved as JSON lines for later replay."""
    requests.select(*[f.name for f in REQUEST_SCHEMA.fields if f.name in requests.columns]) \
        .write.mode("overwrite").json(path)


def write_counters(model_daily: DataFrame, path: str) -> None:
    """K1/K2 in batch: model/day counters partitioned by day, so readers
    prune to the days they ask for."""
    model_daily.write.mode("overwrite").partitionBy("day").parquet(path)


def read_daily_costs(spark: SparkSession, path: str, as_of: str, days: int = 7) -> DataFrame:
    """Last ``days`` day totals (partition pruning on ``day``), dense
    and zero-filled."""
    a = F.to_date(F.lit(as_of))
    stats = spark.read.parquet(path).where((F.col("day") > F.date_sub(a, days)) & (F.col("day") <= a))
    daily = stats.groupBy("day").agg(F.sum("cost").cast(MONEY_SUM).alias("cost"))
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(a, days - 1), a)).alias("day"))
    return spine.join(daily, "day", "left").select("day", F.coalesce("cost", F.lit(0).cast(MONEY_SUM)).alias("cost"))


def read_model_stats(spark: SparkSession, path: str, as_of: str, days: int = 7) -> DataFrame:
    """model/day rows of the last ``days`` days with the dashboard's
    integer truncation of token counters."""
    a = F.to_date(F.lit(as_of))
    s = spark.read.parquet(path).where((F.col("day") > F.date_sub(a, days)) & (F.col("day") <= a))
    return s.select("day", "model", F.col("requests").cast("bigint"), F.col("input_tokens").cast("bigint"),
                    F.col("output_tokens").cast("bigint"), F.col("cost").cast(MONEY))
