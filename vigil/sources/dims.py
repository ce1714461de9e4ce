"""Small constant dimensions: pricing, name list, PII types, built-in policies.

Everything here is fixed-size (tens of rows), so broadcasting it is safe at
any data volume.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the governed proxy's for identical results.
# ---------------------------------------------------------------------------

# USD per 1,000 tokens: model, input price, output price.
PRICING = [
    ("gpt-4o", "0.005", "0.015"),
    ("gpt-4o-mini", "0.00015", "0.0006"),
    ("gpt-4-turbo", "0.01", "0.03"),
    ("gpt-4", "0.03", "0.06"),
    ("gpt-3.5-turbo", "0.0005", "0.0015"),
    ("gpt-3.5-turbo-16k", "0.003", "0.004"),
    ("claude-3-opus", "0.015", "0.075"),
    ("claude-3-sonnet", "0.003", "0.015"),
    ("claude-3-haiku", "0.00025", "0.00125"),
    ("claude-2.1", "0.008", "0.024"),
    ("claude-2", "0.008", "0.024"),
]
# Model whose prices apply to any model missing from the table.
FALLBACK_MODEL = "gpt-3.5-turbo"
DEFAULT_MODEL = "gpt-3.5-turbo"

# Lower-case names treated as person names.
COMMON_NAMES = [
    "john", "jane", "smith", "johnson", "williams", "brown", "jones",
    "davis", "miller", "wilson", "moore", "taylor", "anderson", "thomas",
    "jackson", "white", "harris", "martin", "thompson", "garcia", "martinez",
]

# PII types in detection order (ties on the same start keep this order).
PII_TYPES = ["email", "phone", "ssn", "credit_card", "ip_address", "api_key",
             "aws_key", "person_name"]
PII_ACTIONS = ["redact", "block", "warn", "hash"]

# Rate-limit names, their window in seconds and the word used in the reason.
RATE_WINDOWS = [
    ("requests_per_minute", 60, "min"),
    ("requests_per_hour", 3600, "hour"),
    ("requests_per_day", 86400, "day"),
]

RESPONSE_BLOCKED_TEXT = "Response blocked due to PII detection."

# Decision and validation messages (Python format fields filled per row).
RATE_LIMIT_REASON = "Rate limit exceeded: {name} ({limit} requests per {suffix})"
PII_BLOCK_REASON = "PII detected in request: %d instances found"
PER_REQUEST_REASON = "Estimated cost ${estimate} exceeds per-request limit ${limit}"
DAILY_CAP_REASON = "Would exceed daily cap ${cap} (current: ${current})"
POLICY_NAME_ERROR = "Policy must have a 'name' field"
POLICY_NUMBER_ERROR = "cost_limits.{field} must be a number"
POLICY_INTEGER_ERROR = "rate_limits.{field} must be an integer"
DEFAULT_MAX_TOKENS_FOR_COST = 500
DEFAULT_CACHE_TTL = 3600
COUNTER_RETENTION_DAYS = 7

# ---------------------------------------------------------------------------

PRICE_TYPE = T.DecimalType(12, 8)
MONEY = T.DecimalType(18, 6)
MONEY_SUM = T.DecimalType(28, 6)

PRICING_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("input_per_1k", PRICE_TYPE, False),
    T.StructField("output_per_1k", PRICE_TYPE, False),
])


def pricing_table(spark: SparkSession) -> DataFrame:
    """The 11-row pricing dimension as a local relation."""
    rows = [(m, Decimal(i), Decimal(o)) for m, i, o in PRICING]
    return spark.createDataFrame(rows, PRICING_SCHEMA)


def fallback_prices() -> tuple[Column, Column]:
    _, i, o = next(p for p in PRICING if p[0] == FALLBACK_MODEL)
    return (F.lit(Decimal(i)).cast(PRICE_TYPE), F.lit(Decimal(o)).cast(PRICE_TYPE))


def names_array() -> Column:
    """The name list as a literal array (no join needed)."""
    return F.array(*[F.lit(n) for n in COMMON_NAMES])


def pii_type_rank(type_col: Column) -> Column:
    """Position of a PII type in detection order (0-based)."""
    return F.array_position(F.array(*[F.lit(t) for t in PII_TYPES]), type_col) - 1


def sql_pricing_values(alias: str = "pricing", model_col: str = "model") -> str:
    """The pricing table as a SQL VALUES list (for oracle SQL)."""
    rows = ", ".join(
        f"('{m}', CAST({i} AS DECIMAL(12,8)), CAST({o} AS DECIMAL(12,8)))"
        for m, i, o in PRICING)
    return f"(VALUES {rows}) AS {alias}({model_col}, input_per_1k, output_per_1k)"
