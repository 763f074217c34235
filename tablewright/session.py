"""Session construction for tests and the bench, and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tablewright") -> SparkSession:
    """A session set up the way the operators expect (UTC, AQE, no UI).

    On a cluster the caller's own session is used instead; operators never build one.
    """
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location comes from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Where neither is set, a local master gets a temporary folder; on a
    cluster that folder would be another disk on every machine, so the call is refused.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = _local_scratch(sc.master)
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"


def _local_scratch(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tablewright-ckpt-")


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made under :func:`scratch_dir` (through the file system of its path)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df, name: str = "part"):
    """Write ``df`` once as parquet under the shared checkpoint location and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor re-reads files instead of
    recomputing), but in ONE job: ``Dataset.checkpoint`` computes its input twice (once
    for the action, once to write) unless the data is also cached.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
