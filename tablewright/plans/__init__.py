"""Queries over the driver's tables: one Spark callable and, where SQL can say it, one
DuckDB-runnable SQL text per operator. ``registry()`` merges the families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def registry():
    """(queries, oracle_sql) merged over all plan families."""
    from tablewright.plans import catalog, loading, maintaining, profiling, reconciling, reports
    queries, oracle = {}, {}
    for mod in (profiling, reports, reconciling, loading, catalog, maintaining):
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle
