"""Column classes and column selection for the profiler (P-01, P-02)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

TEXT, NUMERIC, DATE, LOB, BINARY, OTHER = "text", "numeric", "date", "lob", "binary", "other"

_DECLARED = re.compile(r"^(var)?char\((\d+)\)$", re.IGNORECASE)


@dataclass(frozen=True)
class ProfileColumn:
    name: str
    dtype: T.DataType
    type_class: str      # text | numeric | date | lob | binary | other
    sql_type: str        # the equivalent server type name used by the suggestion rules
    declared_length: int | None


def classify(field: T.StructField, lob_cols=()) -> ProfileColumn:
    """Map a Spark field to its profiling class and server-type name."""
    dt, name = field.dataType, field.name
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        if name in lob_cols:
            return ProfileColumn(name, dt, LOB, "varchar", -1)
        declared = None
        sql_type = "varchar"
        meta = (field.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
        m = _DECLARED.match(meta or "")
        if isinstance(dt, (T.VarcharType, T.CharType)):
            declared = dt.length
            sql_type = "char" if isinstance(dt, T.CharType) else "varchar"
        elif m:
            declared = int(m.group(2))
            sql_type = "varchar" if m.group(1) else "char"
        return ProfileColumn(name, dt, TEXT, sql_type, declared)
    if isinstance(dt, T.BinaryType):
        if name in lob_cols:
            return ProfileColumn(name, dt, LOB, "varbinary", -1)
        return ProfileColumn(name, dt, BINARY, "binary", None)
    numeric = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int",
               T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "float",
               T.DecimalType: "decimal"}
    for cls, sql in numeric.items():
        if isinstance(dt, cls):
            return ProfileColumn(name, dt, NUMERIC, sql, 0)
    if isinstance(dt, T.DateType):
        return ProfileColumn(name, dt, DATE, "date", 0)
    if isinstance(dt, T.TimestampNTZType):
        return ProfileColumn(name, dt, DATE, "datetime2", 0)
    if isinstance(dt, T.TimestampType):
        return ProfileColumn(name, dt, DATE, "datetime", 0)
    if isinstance(dt, T.BooleanType):
        return ProfileColumn(name, dt, OTHER, "bit", 0)
    return ProfileColumn(name, dt, OTHER, dt.simpleString(), None)


MAX_LISTED = 100_000        # no table is so wide: a longer frame is not a column list


def parse_column_list(columns) -> list[str]:
    """Comma list, sequence, or a column-list DataFrame (``column_name``) -> names, blanks
    trimmed, empties and repeats dropped."""
    if columns is None:
        return []
    if hasattr(columns, "select") and hasattr(columns, "collect"):
        names = columns.select("column_name").distinct().limit(MAX_LISTED + 1).collect()
        if len(names) > MAX_LISTED:
            raise ValueError("The column list has more names than a table has columns")
        columns = [r[0] for r in names if r[0] is not None]
    items = columns.split(",") if isinstance(columns, str) else list(columns)
    out: list[str] = []
    for item in items:
        name = item.strip()
        if name and name not in out:
            out.append(name)
    return out


def select_profile_columns(schema: T.StructType, columns=None, *, text=True, numeric=True,
                           date=True, lob=True, lob_cols=()):
    """Columns to profile, and the listed names that the schema does not have.

    With an explicit list every known listed column is profiled whatever its class; the
    unknown names are returned (not silently ignored). Names are compared without case, as
    Spark does, unless the schema has that very name. Without a list the four switches
    choose classes; booleans and nested types are only profiled when listed.
    """
    listed = parse_column_list(columns)
    exact = {f.name: f for f in schema.fields}
    folded = {f.name.lower(): f for f in reversed(schema.fields)}
    if listed:
        fields = {n: exact.get(n) or folded.get(n.lower()) for n in listed}
        unknown = [n for n, f in fields.items() if f is None]
        once = dict.fromkeys(f.name for f in fields.values() if f is not None)
        known = [classify(exact[n], lob_cols) for n in once]
    else:
        wanted = {TEXT: text, BINARY: text, NUMERIC: numeric, DATE: date, LOB: lob, OTHER: False}
        known = [pc for pc in (classify(f, lob_cols) for f in schema.fields) if wanted[pc.type_class]]
        unknown = []
    if not known:
        raise ValueError("The columns do not exist in the table or no columns are selected")
    return known, unknown
