"""Shards of near equal bytes by sampled splitters, with DataFrame functions only.

Records are ordered by (group key, id): the group key is a hash of the text,
so equal texts lie together until a range boundary subdivides their run by id.
A size-weighted sample of the keys, drawn by exponential priorities from a hash
of the record (a rerun draws the same), gives quantile boundaries; records are
range-partitioned by them, and a range that came out overfull is subdivided
by further splitters of its own sample. Exact sums per range and within each
range then cut the order into ``shards`` runs of equal bytes: a shard is off the
mean by one record at most, whatever the sample was. The number of ranges
follows the number of rows; all driver data (sample, boundaries, sums per range)
is bounded by parameters.

Defined cases: a null text counts 0 bytes and has crc32 0; equal rows share a
key and are ordered arbitrarily among themselves, being interchangeable; null
ids come first; an empty table gives no rows; columns named like an added
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import staged

SHARDS, ROW_BYTES = 24, 8
#: Least ranges per shard, rows from which a shard has more (up to a bound), sampled keys per range, and the share of
#: the mean range from which one is overfull.
RANGES_PER_SHARD, RANGE_ROWS, MOST_RANGES, SAMPLE_PER_RANGE, OVERFULL = 16, 1_000_000, 2_048, 16, 2.0


def _priority(seed: int) -> Column:
    """-ln(u) / size with u uniform from a hash of the record: the smallest are a size-weighted sample."""
    u = (F.pmod(F.xxhash64("_k", "_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return -F.log(u) / F.col("_size")


def _splitters(rows: DataFrame, n: int, sample: int, seed: int) -> list[tuple[int, int]]:
    """At most n - 1 boundaries (key, id) at the quantiles of a bounded size-weighted sample."""
    s = rows.select("_k", "_id", _priority(seed).alias("_p")).orderBy("_p", "_k", "_id").limit(sample)
    got = sorted((r._k, r._id) for r in s.collect())
    return sorted({got[len(got) * i // n] for i in range(1, n)} if got else set())


def _range_of(bounds: list[tuple[int, int]], base: Column) -> Column:
    """The number of boundaries at or below (key, id), by halving steps over a literal array."""
    if not bounds:
        return base
    arr = ", ".join(f"struct(bigint('{k}') AS k, bigint('{i}') AS i)" for k, i in bounds)  # one expression: built by one call
    steps = ", ".join(str(1 << s) for s in range((len(bounds)).bit_length() - 1, -1, -1))
    return base + F.expr(f"aggregate(array({steps}), 0, (at, s) -> if(at + s <= {len(bounds)} AND "
                         f"get(array({arr}), at + s - 1) <= struct(_k AS k, _id AS i), at + s, at))")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", row_id: str = "doc_id",
          ranges_per_shard: int = RANGES_PER_SHARD, sample_per_range: int = SAMPLE_PER_RANGE, row_bytes: int = ROW_BYTES,
          keep: list[str] | None = None, seed: int = 4) -> DataFrame:
    """``keep`` columns (default: the id) with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    added = {"size", "text_crc32", "shard", "slot"}
    keep = [c for c in (keep or [row_id]) if c.lower() not in added]
    slim = staged(docs.select(
        *[F.col(c) for c in keep], (F.octet_length(body) + F.lit(row_bytes)).cast("bigint").alias("_size"),
        F.crc32(body).alias("_crc"), F.xxhash64(body).alias("_k"),
        F.coalesce(F.col(row_id).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("_id")))
    n = shards * max(ranges_per_shard, min(MOST_RANGES, -(-slim.count() // (shards * RANGE_ROWS))))  # a range's rows are one sort
    bounds = _splitters(slim, n, n * sample_per_range, seed)
    ranged = slim.withColumn("_range", _range_of(bounds, F.lit(0)).cast("bigint"))
    sums = ranged.groupBy("_range").agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_n")).collect()  # at most n rows
    total = sum(int(r._b) for r in sums)
    limit = OVERFULL * total / n
    over = sorted(((int(r._range), int(r._b)) for r in sums if r._b > limit))
    if over:  # subdivide: the boundaries of the overfull ranges are drawn from samples of their own rows
        more = []
        inside = ranged.where(F.col("_range").isin([k for k, _ in over]))
        parts = max(2, sum(-(-int(b * n) // max(1, total)) for _, b in over))
        more = _splitters(inside, parts * 2, parts * 2 * sample_per_range, seed + 1)
        bounds = sorted(set(bounds) | set(more))
        ranged = slim.withColumn("_range", _range_of(bounds, F.lit(0)).cast("bigint"))
    per = ranged.groupBy("_range").agg(F.sum("_size").alias("_b"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range, a bounded number
    per = per.select("_range", F.coalesce(F.sum("_b").over(ahead), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_range").orderBy("_k", "_id", *keep)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranged.withColumn("_rb", F.coalesce(F.sum("_size").over(run), F.lit(0))).withColumn("_rn", F.row_number().over(inside) - 1)
              .join(F.broadcast(per), "_range")  # at most as many rows as ranges
              .withColumn("_at", F.col("_b0") + F.col("_rb")).withColumn("_no", F.col("_n0") + F.col("_rn"))
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_at * {shards}) div {max(1, total)}")).cast("int")))
    placed = staged(placed.select(*keep, "_size", "_crc", "_no", "shard"))
    first = placed.groupBy("shard").agg(F.min("_no").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")  # one row per shard
            .select(*keep, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_no") - F.col("_first")).alias("slot")))
