"""Row counts, null counts and limits from Parquet footers (A-01, A-05, A-12).

The V2 Parquet source answers COUNT, MIN and MAX from the files' footers when aggregates are
pushed down; no column data is read, so the cost follows the number of files and row groups,
not the rows. The settings live in a session of their own and leave the caller's alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import quote_ident, sql_str

#: Types whose limits stand in the footers as they are (text may be cut there, floating
#: columns have no limits beside a NaN).
LIMITED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def _footer_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_stats(spark: SparkSession, path, columns=None) -> DataFrame:
    """(column_name, row_count, no_nulls, min_raw, max_raw), one row per top-level column that
    is not nested; limits as text, for whole numbers, dates and booleans (NULL for others)."""
    files = _footer_session(spark).read.parquet(path)
    fields = [f for f in files.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
              and (columns is None or f.name in columns)]
    aggs, structs = ["count(*) AS n"], []
    for i, f in enumerate(fields):
        c = quote_ident(f.name)
        aggs.append(f"count({c}) AS c{i}")
        limits = isinstance(f.dataType, LIMITED)
        if limits:
            aggs += [f"min({c}) AS a{i}", f"max({c}) AS b{i}"]
        ends = [f"CAST({x}{i} AS STRING)" if limits else "CAST(NULL AS STRING)" for x in "ab"]
        structs.append(f"named_struct('column_name', {sql_str(f.name)}, 'row_count', n, 'no_nulls', n - c{i}, "
                       f"'min_raw', {ends[0]}, 'max_raw', {ends[1]})")
    one = files.selectExpr(*aggs)
    return one.select(F.inline(F.expr(f"array({', '.join(structs)})")))
