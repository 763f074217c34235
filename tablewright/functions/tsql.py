"""Scalar rules of the reference: Column expressions, or SQL text where the wide profile
aggregate is built from text. Each rule has one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ----------------------------------------------------------------------------
# Run status code -> label, in code order (equal to the reference's labels).
RUN_STATUS_LABELS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In Progress"}
RUN_STATUS_UNKNOWN = "Unknown"
# Numeric-looking pattern and date formats: our documented stand-ins for the server's
# locale-bound ISNUMERIC / ISDATE tests.
NUMERIC_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss")
# Shape of each format (same order): only text of this shape is handed to the parser.
DATE_SHAPES = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{8}$", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
               r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
# -------------------------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Integer division ``a div b``, exact at any bigint size."""
    return F.call_function("div", _col(a).cast("bigint"), _col(b).cast("bigint"))


def hhmmss_minutes(c) -> Column:
    """HHMMSS-encoded integer duration -> whole minutes, rounded at 30 s, integer maths:
    (d div 10000 * 3600 + (d div 100) % 100 * 60 + d % 100 + 31) div 60."""
    d = _col(c).cast("bigint")
    secs = int_div(d, F.lit(10000)) * 3600 + (int_div(d, F.lit(100)) % 100) * 60 + d % 100
    return int_div(secs + 31, F.lit(60)).cast("int")


def decode_status(c) -> Column:
    """Run status code -> label (unknown codes, NULL included, -> 'Unknown')."""
    col = _col(c)
    out = None
    for code, label in RUN_STATUS_LABELS.items():
        out = F.when(col == code, label) if out is None else out.when(col == code, label)
    return out.otherwise(RUN_STATUS_UNKNOWN)


def pct_of(n, total, scale: int = 4, precision: int = 9) -> Column:
    """n * 100 / total as decimal(precision, scale), rounded half up, in exact integer maths.

    Multiplying before dividing avoids the early cut of the reference's ``(n/rows)*100``.
    NULL when total is 0 or NULL.
    """
    # 19 digits of a bigint and those of the factor: the products never overflow
    n, total = _col(n).cast("bigint").cast("decimal(27,0)"), _col(total).cast("bigint").cast("decimal(27,0)")
    factor = F.lit(2 * 100 * 10 ** scale).cast("decimal(10,0)")
    q = F.when(total > 0, F.call_function("div", n * factor + total, total * F.lit(2).cast("decimal(1,0)")))
    step = F.lit(10 ** -scale).cast(f"decimal({scale + 1},{scale})")
    return (q.cast("decimal(38,0)") * step).cast(f"decimal({precision},{scale})")


def _whole_second(c: Column, dtype=None) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.date_trunc("SECOND", c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.minute(c), F.second(c))


def second_boundaries(start, end, dtype=None) -> Column:
    """DATEDIFF(SECOND, start, end): whole-second boundaries crossed (0.9 s -> 1.0 s is 1).

    Timestamp-without-zone values are truncated field-wise, so no time zone is involved.
    """
    return F.timestamp_diff("SECOND", _whole_second(_col(start), dtype),
                            _whole_second(_col(end), dtype))


def quote_ident(name: str) -> str:
    """Quote an identifier for Spark SQL (the QUOTENAME counterpart)."""
    return "`" + name.replace("`", "``") + "`"


# --- rules as SQL text (one JVM-side parse instead of many py4j calls) ----------------------

def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NUMERIC_FIRST = "('0','1','2','3','4','5','6','7','8','9','+','-','.')"


def looks_numeric_sql(c: str, pattern: str = NUMERIC_PATTERN) -> str:
    """Numeric-looking text (stand-in for ISNUMERIC = 1); NULL counts as no. A first-character
    test skips the regex for text that cannot match (it starts with a digit, sign or dot)."""
    t = f"trim({c})"
    return f"coalesce(substr({t}, 1, 1) IN {_NUMERIC_FIRST} AND {t} RLIKE r'{pattern}', false)"


def looks_date_sql(c: str, formats=DATE_FORMATS, shapes=DATE_SHAPES) -> str:
    """Date-looking text (stand-in for ISDATE = 1): has the shape of one of ``formats`` and
    parses as a valid date/time under it. Every shape starts with a digit, so other text is
    skipped before any regex or parse; the parser only sees plausible text."""
    t = f"trim({c})"
    tries = ", ".join(f"CASE WHEN {t} RLIKE r'{shape}' THEN try_to_timestamp({t}, '{f}') END"
                      for f, shape in zip(formats, shapes))
    return (f"coalesce(substr({t}, 1, 1) BETWEEN '0' AND '9' AND (coalesce({tries}) IS NOT NULL),"
            f" false)")


def time_of_day_nonzero_sql(c: str, ntz: bool) -> str:
    """Value is not at midnight (FLOOR of the day fraction differs from the value)."""
    if ntz:
        return f"(CAST(CAST({c} AS DATE) AS TIMESTAMP_NTZ) <> {c})"
    return f"(date_trunc('DAY', {c}) <> {c})"


def seconds_nonzero_sql(c: str, ntz: bool) -> str:
    """Seconds or sub-seconds are not zero (DATEPART(ss) <> 0 OR DATEPART(mcs) <> 0)."""
    if ntz:
        return (f"(make_timestamp_ntz(year({c}), month({c}), day({c}), hour({c}), minute({c}), 0)"
                f" <> {c})")
    return f"(date_trunc('MINUTE', {c}) <> {c})"
