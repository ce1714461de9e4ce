"""Spark session helpers shared by tests, the bench and the streaming jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil") -> SparkSession:
    """Local session with the settings every job here relies on.

    On a cluster the session comes from the platform; only the SQL options
    below matter there (UTC day boundaries, AQE, Arrow batches).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there (the context picks it up at start);
    we only invent one (a fresh local folder) when neither the setting nor the
    context has one and the master is local (tests, the bench); elsewhere a
    missing folder is an error. The setting itself
    cannot change at runtime, so the context's folder is set directly.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet under the shared checkpoint folder and
    reads it back: the plan runs once, later reads take only the columns they
    use, and a lost executor loses nothing (never a local checkpoint)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of an input that has fewer splits than the cluster has cores (a file of one row group, say) out
    to all of them; an input with enough splits, as any large one has, is left as it is and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 8) -> dict[str, str]:
    """Starting settings for a large cluster run (the session builder of the
    platform applies them): AQE starts from one shuffle partition per GB of
    raw input (100 TB: about 100k, of ~100 MB of slim columns) and coalesces; text scans split at 128 MB so a regex task
    stays small; skewed joins are split by AQE; broadcasts stay at the
    default size bound."""
    cores = max(1, executors * cores_per_executor)
    # the jobs shuffle slim columns (keys, numbers, hashes), not the raw input: about a gigabyte of it per partition
    shuffle_parts = max(cores * 2, int(input_bytes // (1 << 30)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
