"""Many-table operators (S-09 … S-11, M-01 … M-02): list a source's columns, copy every
table of a source, or expose each as a view.

A *source* is a reader: a callable ``name -> DataFrame`` (a JDBC reader, a folder of
parquet files, a catalogue namespace). The data of each table moves executor to executor
in its own Spark job; the driver only submits the jobs and records their outcome, so one
failing table does not stop the others.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import quote_ident

Reader = Callable[[str], DataFrame]
log = logging.getLogger("tablewright.mirror")

_JDBC_TYPE = {  # java.sql.Types codes for the 19-column listing
    "string": 12, "bigint": -5, "int": 4, "smallint": 5, "tinyint": -6, "double": 8,
    "float": 7, "boolean": 16, "date": 91, "timestamp": 93, "timestamp_ntz": 93,
    "binary": -3, "decimal": 3,
}


def parquet_folder_reader(spark: SparkSession, folder: str) -> Reader:
    base = folder.rstrip("/")
    return lambda name: spark.read.parquet(f"{base}/{name}.parquet")


def jdbc_options(url: str, name: str, properties: dict | None = None,
                 partition: dict | None = None) -> dict:
    """Options of one remote table scan. ``partition`` (column, lower, upper, parts) splits
    it into that many range scans; the bounds place the cuts and drop no rows."""
    out = {"url": url, "dbtable": name, **(properties or {})}
    if partition:
        out.update(partitionColumn=partition["column"], lowerBound=str(partition["lower"]),
                   upperBound=str(partition["upper"]), numPartitions=str(partition["parts"]))
    return out


def jdbc_reader(spark: SparkSession, url: str, properties: dict | None = None,
                partitions: dict | None = None) -> Reader:
    """Reader over a JDBC source (the linked-server counterpart). ``partitions`` maps a
    table to its split (see :func:`jdbc_options`); a table without one is read by one task."""
    return lambda name: spark.read.format("jdbc").options(
        **jdbc_options(url, name, properties, (partitions or {}).get(name))).load()


def list_source_columns(spark: SparkSession, reader: Reader, names, catalog: str = "",
                        schema: str = "") -> DataFrame:
    """S-09/S-10: the 19-column column listing of every table of a source, taken from the
    tables' schemas (no data is read). Bounded by the number of columns."""
    rows = []
    for name in names:
        for pos, f in enumerate(reader(name).schema.fields, start=1):
            tname = f.dataType.simpleString().split("(")[0]
            size = f.dataType.precision if isinstance(f.dataType, T.DecimalType) else None
            digits = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else None
            rows.append((catalog, schema, name, f.name, _JDBC_TYPE.get(tname), tname, size, None,
                         digits, 10 if size else None, 1 if f.nullable else 0, None, None,
                         _JDBC_TYPE.get(tname), None, None, pos, "YES" if f.nullable else "NO",
                         None))
    ddl = ("table_cat string, table_schem string, table_name string, column_name string, "
           "data_type smallint, type_name string, column_size int, buffer_length int, "
           "decimal_digits smallint, num_prec_radix smallint, nullable smallint, remarks string, "
           "column_def string, sql_data_type smallint, sql_datetime_sub smallint, "
           "char_octet_length int, ordinal_position int, is_nullable string, ss_data_type tinyint")
    return spark.createDataFrame(rows, ddl).orderBy("table_name", "ordinal_position")


def _copy_one(reader: Reader, name: str, target: str, fmt: str, as_table: bool):
    obs = Observation(f"copy_{name}")
    try:
        df = reader(name).observe(obs, F.count(F.lit(1)).alias("rows"))
        w = df.write.mode("overwrite").format(fmt)
        if as_table:
            w.saveAsTable(f"{target}.{name}")
            where = f"{target}.{name}"
        else:
            where = f"{target.rstrip('/')}/{name}"
            w.save(where)
        rows = int(obs.get.get("rows", 0))
        log.info("SUCCESS: copied %s (%s rows) to %s", name, rows, where)
        return (name, "copied", rows, where, None)
    except Exception as e:  # noqa: BLE001 – go on with the next table, report this one
        log.error("ERROR: failed to copy %s: %s", name, e)
        return (name, "failed", None, target, f"{type(e).__name__}: {e}")


def mirror_tables(spark: SparkSession, reader: Reader, names, target: str, *,
                  fmt: str = "parquet", as_table: bool = False, parallel: int = 4) -> DataFrame:
    """M-01: copy every (distinct) table of a source to ``target`` (a folder, or a
    namespace when ``as_table``), replacing earlier copies; a failure is reported and the
    others go on. Returns one status row per table."""
    if as_table:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {target}")
    uniq = list(dict.fromkeys(names))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        results = list(pool.map(lambda n: _copy_one(reader, n, target, fmt, as_table), uniq))
    return spark.createDataFrame(
        results, "table_name string, status string, rows bigint, target string, error string")


def expose_views(reader: Reader, names, prefix: str = "", columns: dict | None = None) -> list:
    """M-02: one temporary view per source table, columns in ordinal (or given) order;
    a failing table is skipped and reported. Returns (view, status, error) tuples."""
    out = []
    for name in dict.fromkeys(names):
        view = f"{prefix}{name}"
        try:
            df = reader(name)
            cols = (columns or {}).get(name) or df.columns
            df.select(*[F.col(quote_ident(c)) for c in cols]).createOrReplaceTempView(view)
            out.append((view, "created", None))
        except Exception as e:  # noqa: BLE001
            out.append((view, "failed", f"{type(e).__name__}: {e}"))
    return out
