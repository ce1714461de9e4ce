"""Token and cost column functions.

All of these are JVM expressions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.sources.dims import MONEY, PRICE_TYPE


def count_tokens(text: Column) -> Column:
    """X12 default: code points div 4, the governed proxy's own fallback when
    its BPE vocabulary cannot be loaded. NULL text counts 0."""
    return F.coalesce(F.floor(F.length(text) / 4).cast("bigint"), F.lit(0).cast("bigint"))


def message_tokens(role: Column, content: Column) -> Column:
    """Per-message share of A8: 4 + tok(role) + tok(content)."""
    return F.lit(4).cast("bigint") + count_tokens(role) + count_tokens(content)


def request_tokens(messages: Column, system: Column | None = None) -> Column:
    """A8 over a messages array column: sum of message_tokens, plus tok(system)."""
    total = F.aggregate(messages, F.lit(0).cast("bigint"),
                        lambda acc, m: acc + message_tokens(m["role"], m["content"]))
    total = F.coalesce(total, F.lit(0).cast("bigint"))
    if system is not None:
        total = total + F.when(system.isNotNull(), count_tokens(system)).otherwise(0)
    return total


def response_tokens(usage: Column, choices: Column) -> Column:
    """completion_tokens when usage is present (0 if that field is NULL),
    else the token count summed over choice contents."""
    from_choices = F.coalesce(
        F.aggregate(choices, F.lit(0).cast("bigint"),
                    lambda acc, c: acc + count_tokens(c["message"]["content"])),
        F.lit(0).cast("bigint"))
    return F.when(usage.isNotNull(),
                  F.coalesce(usage["completion_tokens"].cast("bigint"), F.lit(0).cast("bigint"))
                  ).otherwise(from_choices)


def calculate_cost(input_tokens: Column, output_tokens: Column,
                   input_per_1k: Column, output_per_1k: Column) -> Column:
    """X13 in exact decimal: round(in/1000*p_in + out/1000*p_out, 6), half-up."""
    raw = (input_tokens.cast("decimal(20,0)") * input_per_1k.cast(PRICE_TYPE)
           + output_tokens.cast("decimal(20,0)") * output_per_1k.cast(PRICE_TYPE)) * F.lit(Decimal("0.001"))
    return F.round(raw, 6).cast(MONEY)


def sql_cost(input_tokens: str, output_tokens: str, p_in: str, p_out: str) -> str:
    """The same formula as SQL text for the oracle."""
    return (f"CAST(round((CAST({input_tokens} AS DECIMAL(20,0)) * {p_in} + "
            f"CAST({output_tokens} AS DECIMAL(20,0)) * {p_out}) * 0.001, 6) AS DECIMAL(18,6))")
