"""Skew-safe window building blocks.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so
a key holding a third of the data becomes a third of the job in one task.
These helpers split each key into blocks and stitch the blocks together with
small pre-aggregated tables:

* ``running_sum``: two-level prefix sum. Block totals (partial aggregation),
  a prefix over the block totals (tiny: one row per key and block), then a
  running sum inside each (key, block) partition plus the block's offset.
* ``trailing_sum``: sliding ``(t - w, t]`` sums. Rows are bucketed by time
  into chunks of at least ``w`` seconds; each row is also copied into the
  next chunk when it lies within ``w`` of that chunk's start (a halo), so
  every window is complete inside one (key, chunk) partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: str | list[str],
                values: dict[str, str], block: Column, inclusive: bool = True) -> DataFrame:
    """Adds ``values[src]`` = running sum of ``src`` per ``keys`` in ``order``.

    ``block`` must be monotone in ``order`` within a key (e.g. hour of ts).
    ``inclusive=False`` sums strictly earlier rows only. ``order`` must be a
    total order within a key (add a tie-breaker column if needed).

    Block totals come from a partial aggregate (one row per key, block and
    task crosses the shuffle); their prefix is a small table that is joined
    back on (key, block), which the window output is already partitioned by.
    """
    order_cols = [order] if isinstance(order, str) else list(order)
    blk = "_blk"
    d = df.withColumn(blk, block)
    end = Window.currentRow if inclusive else -1
    wi = Window.partitionBy(*keys, blk).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, end)
    within = d.select("*", *[F.coalesce(F.sum(s).over(wi), F.lit(0)).alias(f"_in_{s}") for s in values])
    totals = d.groupBy(*keys, blk).agg(*[F.sum(s).alias(f"_tot_{s}") for s in values])
    wb = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, blk, *[
        F.coalesce(F.sum(f"_tot_{s}").over(wb), F.lit(0)).alias(f"_off_{s}") for s in values])
    out = within.join(offsets, on=[*keys, blk], how="inner")
    for s, dst in values.items():
        out = out.withColumn(dst, (F.col(f"_off_{s}") + F.col(f"_in_{s}")).cast("bigint")
                             if _is_integral(df, s) else F.col(f"_off_{s}") + F.col(f"_in_{s}"))
    drop = [blk] + [f"_off_{s}" for s in values] + [f"_in_{s}" for s in values]
    return out.drop(*drop)


def _is_integral(df: DataFrame, col: str) -> bool:
    t = df.schema[col].dataType.typeName()
    return t in ("long", "integer", "short", "byte")


def trailing_sum(df: DataFrame, keys: list[str], t: str, windows: dict[str, int],
                 value: str, chunk_seconds: int | None = None, keep_chunk: bool = False) -> DataFrame:
    """Adds, per window name -> width w (seconds), the sum of ``value`` over the
    rows of the same key with time in ``(t - w, t]``.

    Expects at most a few rows per (key, t) (pre-aggregate first); the work of
    a hot key is spread over its time chunks. Rows and their halo copies come
    from one pass over ``df``. With ``keep_chunk`` the column ``_chunk`` (time
    divided by the chunk's length) stays: the output is partitioned by it.
    """
    wmax = max(windows.values())
    chunk = max(chunk_seconds or wmax, wmax)
    own = F.floor(F.col(t) / chunk)
    places = F.array(F.struct(own.alias("c"), F.lit(True).alias("native")),
                     F.when(F.col(t) > (own + 1) * chunk - wmax, F.struct((own + 1).alias("c"), F.lit(False).alias("native"))))
    both = (df.withColumn("_place", F.explode(places)).where(F.col("_place").isNotNull())
            .withColumn("_chunk", F.col("_place.c")).withColumn("_native", F.col("_place.native")).drop("_place"))
    base = Window.partitionBy(*keys, "_chunk").orderBy(F.col(t))
    cols = [F.sum(value).over(base.rangeBetween(-(w - 1), 0)).alias(name)
            for name, w in windows.items()]
    return both.select("*", *cols).where("_native").drop("_native", *([] if keep_chunk else ["_chunk"]))
