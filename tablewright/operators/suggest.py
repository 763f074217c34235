"""Suggestions on a profile frame (D-10 … D-15, and the D-16 comment).

The frame has one row per profiled column, so every rule is a plain Column expression; the
reference's fifteen in-place updates become: one "last rule wins" type suggestion, a list
of appended remarks, one replacing long-object remark, then the sparse and limit remarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import sql_str

# --- fixed values (must equal the reference's for equal results) -------------------------
# Suggestion texts, in rule order. Version remarks are dropped from the texts.
TXT_DATE_TYPES = "Possibly could be one of the DATE types. "
TXT_NUMERIC_TYPES = "Possibly could be one of the NUMERIC types. "
TXT_INT = "Possibly could be INT type. "
TXT_SMALLINT = "Possibly could be SMALLINT type. "
TXT_TINYINT = "Possibly could be TINYINT type. "
TXT_SMALLDATE = "Possibly could be SMALLDATE type. "
TXT_DATE = "Possibly could be DATE type. "
TXT_DATETIME = "Possibly could be DATETIME type. "
TXT_EMPTY = "Seems empty - is it required? "
TXT_MANY_NULLS = "There is a large percentage of NULLs - attention may be required. "
TXT_LOOKUP = "Few distinct elements - potential for reference/lookup table (contains NULLs)."
TXT_FK = "Few distinct elements - potential for Foreign Key."
TXT_FILESTREAM_YES = "Possibly a good candidate for FILESTREAM."
TXT_FILESTREAM_NO = "Possibly not a good candidate for FILESTREAM."
TXT_SPARSE = "Could benefit from sparse columns. "
TXT_AT_LIMIT = "Large numbers of data elements at the max/minvalues. "
# Percent of NULLs from which a type benefits from sparse storage. ("numeric" is spelled
# correctly here, so numeric columns are matched; see SURVEY N-04.)
SPARSE_THRESHOLDS = [
    ("tinyint", 86), ("smallint", 76), ("int", 64), ("bigint", 52), ("real", 64),
    ("float", 52), ("money", 64), ("smallmoney", 64), ("smalldatetime", 52),
    ("datetime", 52), ("uniqueidentifier", 43), ("date", 69), ("datetime2", 52),
    ("decimal", 42), ("numeric", 42), ("char", 60), ("varchar", 60), ("nchar", 60),
    ("nvarchar", 60), ("binary", 60), ("varbinary", 60), ("xml", 60),
]
TEXT_TYPES = ("varchar", "nvarchar", "char", "nchar")
INT_LIMITS = (-2147483648, 2147483647)          # upper bound is INT's true maximum (N-03)
SMALLINT_LIMITS = (-32768, 32767)
TINYINT_LIMITS = (0, 255)
SMALLDATE_RANGE = ("1900-01-01", "2079-06-06")
DATETIME_RANGE = ("1753-01-01", "9999-12-31")
FILESTREAM_AVG = 1000000
# -------------------------------------------------------------------------------------------


def _when(pred: str, text: str) -> str:
    return f"CASE WHEN coalesce({pred}, false) THEN {sql_str(text)} END"


def type_suggestion_sql(type_pct: int = 2) -> str:
    """D-10 … D-12 as SQL, one remark per column. Text and integer rules: the last matching
    one of the reference wins, so the CASE lists them in reverse order. Date rules: the
    narrowest type that holds all values wins (DATE, then SMALLDATE, then DATETIME); in the
    reference's order DATETIME, which nearly every column fits, would hide the other two."""
    variance = f"((row_count * {int(type_pct)}) div 100)"
    near = lambda c: f"{c} BETWEEN row_count - {variance} AND row_count + {variance}"
    text_types = ", ".join(sql_str(t) for t in TEXT_TYPES)
    ts = lambda d: f"CAST({sql_str(d)} AS TIMESTAMP_NTZ)"
    rules = [
        ("no_date_with_hour_minute_second = 0 AND sql_type IN ('datetime', 'datetime2')", TXT_DATE),
        (f"no_date_with_second = 0 AND min_date >= {ts(SMALLDATE_RANGE[0])}"
         f" AND max_date <= {ts(SMALLDATE_RANGE[1])} AND sql_type IN ('datetime', 'datetime2')",
         TXT_SMALLDATE),
        (f"sql_type = 'datetime2' AND min_date >= {ts(DATETIME_RANGE[0])}"
         f" AND max_date <= {ts(DATETIME_RANGE[1])}", TXT_DATETIME),
        (f"min_data_length >= {TINYINT_LIMITS[0]} AND max_data_length <= {TINYINT_LIMITS[1]}"
         " AND sql_type IN ('bigint', 'int', 'smallint')", TXT_TINYINT),
        (f"min_data_length >= {SMALLINT_LIMITS[0]} AND max_data_length <= {SMALLINT_LIMITS[1]}"
         " AND sql_type IN ('bigint', 'int')", TXT_SMALLINT),
        (f"min_data_length >= {INT_LIMITS[0]} AND max_data_length <= {INT_LIMITS[1]}"
         " AND sql_type = 'bigint'", TXT_INT),
        (f"{near('no_is_numeric')} AND sql_type IN ({text_types})", TXT_NUMERIC_TYPES),
        (f"{near('no_is_date')} AND sql_type IN ({text_types})", TXT_DATE_TYPES),
    ]
    return "CASE " + " ".join(f"WHEN coalesce({p}, false) THEN {sql_str(t)}" for p, t in rules) + " END"


def comments_sql(*, distinct_min: int = 200, null_pct: float = 90.0, type_pct: int = 2,
                 boundary: float | None = None, own_thresholds: bool = False) -> str:
    """The ordered array of remarks for one profile row, as one SQL expression."""
    few = f"no_distinct < {int(distinct_min)} AND row_count > {int(distinct_min)} AND NOT is_fk"
    appended = [
        type_suggestion_sql(type_pct),
        _when("(percentage_nulls = 100 OR percentage_zero_length = 100) AND NOT is_fk", TXT_EMPTY),
        _when(f"percentage_nulls >= CAST({sql_str(str(null_pct))} AS DECIMAL(9,4))", TXT_MANY_NULLS),
        _when(f"{few} AND percentage_nulls <> 100 AND no_nulls <> 0", TXT_LOOKUP),
        _when(f"{few} AND no_nulls = 0 AND NOT contains(lower(sql_type), 'date')"
              " AND lower(sql_type) <> 'time'", TXT_FK),
    ]
    lob_bin = "sql_type = 'varbinary' AND column_data_length = -1"
    replaced = (f"CASE WHEN coalesce({lob_bin} AND avg_data_length >= {FILESTREAM_AVG}, false)"
                f" THEN array({sql_str(TXT_FILESTREAM_YES)})"
                f" WHEN coalesce({lob_bin} AND avg_data_length < {FILESTREAM_AVG}, false)"
                f" THEN array({sql_str(TXT_FILESTREAM_NO)})"
                f" ELSE array_compact(array({', '.join(appended)})) END")
    if own_thresholds:
        threshold = "_sparse_threshold"
    else:
        pairs = ", ".join(f"{sql_str(t)}, CAST({p} AS DECIMAL(9,4))" for t, p in SPARSE_THRESHOLDS)
        threshold = f"element_at(map({pairs}), sql_type)"
    tail = [_when(f"percentage_nulls >= {threshold}", TXT_SPARSE)]
    if boundary is not None:
        tail.append(_when(f"CAST(no_at_limit AS DECIMAL(38,6)) >= CAST(row_count AS DECIMAL(38,6))"
                          f" * CAST({sql_str(str(boundary))} AS DECIMAL(9,4))", TXT_AT_LIMIT))
    return f"concat({replaced}, array_compact(array({', '.join(tail)})))"


def suggest(prof: DataFrame, *, distinct_min: int = 200, null_pct: float = 90.0,
            type_pct: int = 2, boundary: float | None = None,
            sparse_thresholds: DataFrame | None = None) -> DataFrame:
    """Add ``comments`` (ordered array) and ``data_type_comments`` (joined text, NULL when
    there is nothing to say) to a profile frame (one row per column)."""
    if sparse_thresholds is not None:
        # one row per type that the profile has (the smallest threshold given): bounded by
        # the number of profiled columns before it is broadcast
        th = (sparse_thresholds.select(F.col("data_type").alias("sql_type"),
                                       F.col("threshold").cast("decimal(9,4)").alias("_t"))
              .join(F.broadcast(prof.select("sql_type").distinct()), "sql_type", "left_semi")
              .groupBy("sql_type").agg(F.min("_t").alias("_sparse_threshold")))
        prof = prof.join(F.broadcast(th), "sql_type", "left")
    expr = comments_sql(distinct_min=distinct_min, null_pct=null_pct, type_pct=type_pct,
                        boundary=boundary, own_thresholds=sparse_thresholds is not None)
    keep = [F.col(f"`{c}`") for c in prof.columns if c != "_sparse_threshold"]
    with_comments = prof.select(*keep, F.expr(expr).alias("comments"))
    return with_comments.select(
        *[F.col(f"`{c}`") for c in with_comments.columns],
        F.nullif(F.array_join("comments", ""), F.lit("")).alias("data_type_comments"))
