"""Replacing many tables at once (M-01): versioned folders and one pointer.

A copy writes all tables of one version to a fresh folder; readers follow the pointer, a file
of one line that names the folder of the current version. It is replaced by one rename after
every table has been written, so readers see all tables of the old version or all of the new
one, and a copy that fails, or is lost with its driver, leaves the old version as it is.
"""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.session import remove_scratch
from tablewright.sources.mirror import Reader, mirror_tables

POINTER = "_current"
log = logging.getLogger("tablewright.versions")


class MirrorFailed(RuntimeError):
    """Some table could not be copied; ``status`` has the rows of :func:`mirror_tables`."""

    def __init__(self, status):
        failed = [f"{r['table_name']}: {r['error']}" for r in status if r["status"] != "copied"]
        super().__init__("The earlier version stays: " + "; ".join(failed))
        self.status = status


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, target: str) -> str | None:
    """The folder name of the current version (None: nothing has been committed)."""
    jvm, where, fs = _files(spark, f"{target.rstrip('/')}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _point(spark: SparkSession, target: str, version: str) -> None:
    """Write the pointer beside the old one and rename it over it."""
    jvm, new, fs = _files(spark, f"{target}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, False)
    try:
        out.write(version.encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        new.toUri() if new.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{target}/{POINTER}"), options)


def mirror_version(spark: SparkSession, reader: Reader, names, target: str, *, fmt: str = "parquet",
                   parallel: int = 4, keep: int = 2) -> DataFrame:
    """Copy every table to a new version under ``target`` and make it the current one. Returns
    the status rows of :func:`mirror_tables`; raises :class:`MirrorFailed` and removes the new
    folder when a table could not be copied. The ``keep`` newest versions stay readable, for
    readers that have opened one; older ones are removed after the commit."""
    target = target.rstrip("/")
    before = current_version(spark, target)
    number = int(before.split("-")[1]) + 1 if before else 1
    version = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    status = mirror_tables(spark, reader, names, f"{target}/{version}", fmt=fmt, parallel=parallel)
    rows = status.collect()                                    # one row per table
    if any(r["status"] != "copied" for r in rows):
        remove_scratch(spark, f"{target}/{version}")
        raise MirrorFailed(rows)
    _point(spark, target, version)
    _, where, fs = _files(spark, target)
    older = sorted(p.getPath().getName() for p in fs.listStatus(where)
                   if re.fullmatch(r"v-\d{8}-[0-9a-f]{8}", p.getPath().getName()))
    for name in older[:-keep] if keep > 0 else []:
        if name != version:
            remove_scratch(spark, f"{target}/{name}")
    log.info("Version %s of %s table(s) is current in %s", version, len(rows), target)
    return status


def version_reader(spark: SparkSession, target: str, fmt: str = "parquet") -> Reader:
    """A reader of the version that is current now: all its tables are of that one version,
    also when a newer one is committed meanwhile."""
    version = current_version(spark, target)
    if version is None:
        raise ValueError(f"There is no version in {target}")
    return lambda name: spark.read.format(fmt).load(f"{target.rstrip('/')}/{version}/{name}")
