"""Helpers shared by the corpus operators: Arrow batch mapping, staged tables
in the shared folder, a per-worker cache, and column rules."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds of whole texts at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of text columns (whole texts can be long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet under the shared checkpoint folder and
    reads it back: cuts the lineage, and a lost executor loses nothing."""
    from vigil.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that outlives the tasks of one Python worker process, for models
    that are costly to load. (Task code is pickled by value, so a module
    global would be new in every task.)"""
    return sys.__dict__.setdefault("_vigil_llm_cache", {})


#: Models and other values of one job (keyed by a string) that a worker keeps, and lasting tables (other keys).
JOB_VALUES, LASTING = 1, 16


def cached(key, make: Callable):
    """The worker's value for ``key``, made once. A worker outlives jobs, so only the latest jobs' values stay."""
    c = worker_cache()
    if key not in c:
        alike = [k for k in c if isinstance(k, str) == isinstance(key, str)]
        for k in alike[:max(0, len(alike) + 1 - (JOB_VALUES if isinstance(key, str) else LASTING))]:
            c.pop(k)
        c[key] = make()
    return c[key]


def tidy() -> None:
    """Gives back what Arrow and the allocator hold of freed memory. Workers stay alive beside those of the next job,
    so what they keep counts twice."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def with_columns(df: DataFrame, added: T.StructType, fn, drop: tuple[str, ...] = ()) -> DataFrame:
    """``fn(pyarrow.RecordBatch) -> dict of added arrays`` over Arrow batches.
    The columns of ``df`` pass through; one of the same name as an added column
    is replaced by it (names compare without case, as Spark's do)."""
    new = {f.name.lower() for f in added.fields} | {d.lower() for d in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(keep + added.fields)
    names, order = [f.name for f in keep], [f.name for f in added.fields]

    def run(batches):
        import pyarrow as pa

        tidy()
        for b in batches:
            if b.num_rows == 0:
                continue
            got = fn(b)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [got[n] for n in order], names + order)
            del got, b
        tidy()

    return df.mapInArrow(run, schema)


def sha_hex(c):
    """Lower-case hex SHA-256 of a string column."""
    return F.sha2(c.cast("binary"), 256)


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the text column), for sizing partitions."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    return int(r[0]), int(r[1])
