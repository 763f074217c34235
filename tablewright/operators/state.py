"""Profile states: what a profile needs, stored per file set and merged with that of new files.

A state has one row per column: counts, limits, exact sums and a distinct sketch (a
DataSketches HyperLogLog of 2^``lg_k`` registers). States of several file sets are unioned by
one small aggregate, so a table that grows by a partition a day is profiled by reading that
partition alone. Everything but the distinct count is exact; that one has a relative standard
error of about ``1.04 / sqrt(2^lg_k)`` (0.8 % for 14).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import (
    looks_date_sql, looks_numeric_sql, pct_of, quote_ident, seconds_nonzero_sql, sql_str, time_of_day_nonzero_sql,
)
from tablewright.operators.columns import BINARY, DATE, LOB, NUMERIC, TEXT, ProfileColumn, select_profile_columns
from tablewright.operators.profile import DEC, PROFILE_COLUMNS, _finite_sql, _length_sql

#: Field, type, and how it is merged.
STATE_FIELDS = [
    ("column_name", "string", None), ("column_position", "int", "min"), ("column_data_length", "int", "max"),
    ("data_type", "string", None), ("type_class", "string", "max"), ("sql_type", "string", "max"),
    ("row_count", "bigint", "sum"), ("no_nulls", "bigint", "sum"), ("no_zero_length", "bigint", "sum"),
    ("no_date_with_hour_minute_second", "bigint", "sum"), ("no_date_with_second", "bigint", "sum"),
    ("no_is_numeric", "bigint", "sum"), ("no_is_date", "bigint", "sum"), ("no_non_finite", "bigint", "sum"),
    ("min_data_length", DEC, "min"), ("max_data_length", DEC, "max"),
    ("measured", "bigint", "sum"), ("sum_exact", "decimal(38,2)", "sum"), ("sum_double", "double", "sum"),
    ("min_date", "timestamp_ntz", "min"), ("max_date", "timestamp_ntz", "max"), ("distinct_sketch", "binary", "sketch"),
]


def _column_state(i: int, pc: ProfileColumn, lg_k: int) -> str:
    """named_struct SQL of one column's state."""
    c = quote_ident(pc.name)
    v = {name: "NULL" for name, _, _ in STATE_FIELDS}
    v.update(column_name=sql_str(pc.name), column_position=str(i), data_type=sql_str(pc.dtype.simpleString()),
             type_class=sql_str(pc.type_class), sql_type=sql_str(pc.sql_type), row_count="count(1)",
             no_nulls=f"count_if({c} IS NULL)")
    if pc.declared_length is not None:
        v["column_data_length"] = str(pc.declared_length)
    is_string = isinstance(pc.dtype, (T.StringType, T.VarcharType, T.CharType))
    measure = None
    if pc.type_class in (TEXT, LOB, BINARY):
        measure = _length_sql(pc)
        v["sum_exact"] = f"sum(CAST({measure} AS DECIMAL(28,0)))"
    if pc.type_class == TEXT and is_string:
        v["no_is_numeric"] = f"count_if({looks_numeric_sql(c)})"
        v["no_is_date"] = f"count_if({looks_date_sql(c)})"
    if pc.type_class in (TEXT, LOB) and is_string:
        v["no_zero_length"] = f"count_if(length(trim({c})) = 0)"
    if pc.type_class == NUMERIC:
        floating = isinstance(pc.dtype, (T.FloatType, T.DoubleType))
        measure = f"({_finite_sql(c)})" if floating else c
        v["sum_exact"] = f"try_sum(try_cast({measure} AS DECIMAL(36,2)))"
        if floating:
            v["no_non_finite"] = f"count_if({c} IS NOT NULL AND {measure} IS NULL)"
    if measure is not None:
        v["min_data_length"], v["max_data_length"] = (f"try_cast({f}({measure}) AS {DEC})" for f in ("min", "max"))
        v["measured"] = f"count({measure})"
        v["sum_double"] = f"sum(CAST({measure} AS DOUBLE))"
    if pc.type_class == DATE:
        v["min_date"], v["max_date"] = (f"CAST({f}({c}) AS TIMESTAMP_NTZ)" for f in ("min", "max"))
        if isinstance(pc.dtype, (T.TimestampType, T.TimestampNTZType)):
            ntz = isinstance(pc.dtype, T.TimestampNTZType)
            v["no_date_with_hour_minute_second"] = f"count_if({time_of_day_nonzero_sql(c, ntz)})"
            v["no_date_with_second"] = f"count_if({seconds_nonzero_sql(c, ntz)})"
    plain = isinstance(pc.dtype, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    v["distinct_sketch"] = f"hll_sketch_agg({c if plain else f'CAST({c} AS STRING)'}, {lg_k})"
    return "named_struct(" + ", ".join(f"'{n}', CAST({v[n]} AS {t})" for n, t, _ in STATE_FIELDS) + ")"


def profile_state(df: DataFrame, *, columns=None, lob_cols=(), lg_k: int = 14) -> DataFrame:
    """The state of one file set: one scan, one aggregate, one row per column. Write it next to
    the files it stands for."""
    cols, unknown = select_profile_columns(df.schema, columns, lob_cols=lob_cols)
    if unknown:
        raise ValueError(f"The table has no column {', '.join(unknown)}")
    structs = [_column_state(i, pc, lg_k) for i, pc in enumerate(cols)]
    return df.agg(F.expr(f"array({', '.join(structs)})").alias("s")).select(F.inline("s"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all file sets together. A column missing in one of them counts there as
    not present; a column of two data types is refused when the state is read."""
    every = reduce(DataFrame.unionByName, states)
    merge = {"sum": lambda c: F.sum(c), "min": F.min, "max": F.max,
             "sketch": lambda c: F.hll_union_agg(c)}
    aggs = [F.expr(f"CAST(try_sum({n}) AS {t})").alias(n) if n == "sum_exact" else merge[how](n).cast(t).alias(n)
            for n, t, how in STATE_FIELDS if how]
    # a sum of file sets that one of them has lost (an overflow) is lost
    lost = F.count_if(F.col("sum_exact").isNull() & (F.col("measured") > 0)) > 0
    merged = every.groupBy("column_name", "data_type").agg(*aggs, lost.alias("_lost"))
    return merged.withColumn("sum_exact", F.when(~F.col("_lost"), F.col("sum_exact"))).select(
        *[n for n, _, _ in STATE_FIELDS])


def profile_from_state(state: DataFrame, *, distinct_min=200, null_pct=90.0, type_pct=2,
                       table_schema: str | None = None, table_name: str | None = None) -> DataFrame:
    """The profile of the rows that a state stands for, with its remarks; distinct counts are
    estimates (``distinct_estimated``), limits' counts and domains are not there."""
    from tablewright.operators.suggest import suggest
    lengths = F.col("type_class").isin(TEXT, LOB, BINARY)
    exact = F.col("sum_exact").cast("double") / F.col("measured")
    mean = (F.when(F.coalesce("measured", F.lit(0)) == 0, None)
             .when(lengths, F.expr("CAST(sum_exact DIV measured AS DOUBLE)"))
             .otherwise(F.coalesce(exact, F.col("sum_double") / F.col("measured"))))
    base = state.withColumn("avg_data_length", mean).withColumn(
        "no_distinct", F.hll_sketch_estimate("distinct_sketch")).select(
        F.lit(table_schema).cast("string").alias("table_schema"), F.lit(table_name).cast("string").alias("table_name"),
        "column_name", "column_data_length", "data_type", "type_class", "sql_type", "min_data_length", "max_data_length",
        "avg_data_length", "min_date", "max_date", "no_distinct", "no_nulls", "no_zero_length",
        "no_date_with_hour_minute_second", "no_date_with_second", "no_is_numeric", "no_is_date", "row_count",
        F.col("min_data_length").cast("string").alias("min_raw"), F.col("max_data_length").cast("string").alias("max_raw"),
        "no_non_finite", pct_of("no_nulls", "row_count").alias("percentage_nulls"),
        pct_of("no_zero_length", "row_count").alias("percentage_zero_length"),
        F.lit(None).cast("bigint").alias("no_at_limit"), F.lit(False).alias("is_fk"),
        F.lit(True).alias("distinct_estimated"))
    out = suggest(base, distinct_min=distinct_min, null_pct=null_pct, type_pct=type_pct, boundary=None,
                  sparse_thresholds=None)
    return out.select(*PROFILE_COLUMNS)
