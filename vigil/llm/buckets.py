"""Documents dealt into buckets of bounded text, for operators that pass over the texts more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import text_bytes
from vigil.llm.repeats import bucket_bytes


def bucketed(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> tuple[DataFrame, int]:
    """((bucket, id, text, text_hash), UTF-8 bytes of all texts). A bucket is chosen by a hash of the id and the text,
    so rows of one source, and other texts under one id or none, spread evenly."""
    rows, total = text_bytes(docs, text)
    n = max(1, -(-total // bucket_bytes(total)))
    return docs.select(F.pmod(F.xxhash64(F.col(row_id), F.col(text), F.lit(n)), F.lit(n)).alias("bucket"),
                       F.col(row_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash")), total


def in_order(table):
    """A bucket's rows in the same order on every pass (equal rows are interchangeable)."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table
