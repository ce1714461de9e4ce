"""Display helpers: fixed-point money text, status classes, previews (X22,
P13, P14, O6).

Money is DECIMAL throughout, so fixed-point text is rounded half-up from the
exact decimal first and then printed; the original printed binary floats,
which can show one unit less at an exact tie (deviation D9).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, places: int) -> Column:
    """'%.<places>f' of a decimal, rounded half-up."""
    return F.format_string(f"%.{places}f", F.round(c, places).cast("double"))


def sql_fixed(expr: str, places: int) -> str:
    return f"printf('%.{places}f', CAST(round({expr}, {places}) AS DOUBLE))"


def money(c: Column, places: int = 4) -> Column:
    return F.concat(F.lit("$"), fixed(c, places))


def status_class_dashboard(status: Column) -> Column:
    """200 ok, 429 warning, anything else error."""
    return F.when(status == 200, "ok").when(status == 429, "warning").otherwise("error")


def status_class_log(status: Column) -> Column:
    """>= 400 error, >= 300 warning, else ok."""
    return F.when(status >= 400, "error").when(status >= 300, "warning").otherwise("ok")


def thousands(c: Column) -> Column:
    """'{:,}' of an integer."""
    return F.format_number(c.cast("bigint"), 0)
