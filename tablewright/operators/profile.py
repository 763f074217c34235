"""Table profiler (D-01 … D-09, D-13, D-16 … D-19).

Plan shape, whatever the width of the table and the kinds of its columns:

1. All columns are unpivoted by one Generate and grouped: one scan, a partial aggregate per
   map task, one shuffle. Whole numbers, decimals and amounts of cents, dates, midnights and
   booleans are not grouped by value but by *word* (the value over 64): a word's row holds the
   bits of the values seen (``bit_or``), their rows and the sum of their low parts. Distinct
   counts, sums and limits follow exactly, and 64 neighbouring values cost one row. All other
   values have a typed slot of their own and are counted one by one; long text is counted as
   (SHA-256 digest, length, blank), so whole texts are never shuffled. A hot value collapses
   map-side: one that holds a third of all rows costs one row per task.
2. One aggregate per column folds every statistic from those rows: min/max, length statistics
   and exact means; null, blank, numeric-looking, date-looking and time-of-day counts as sums
   of counts. The rules for text thus run once per distinct value.
3. In advanced mode the statistics, one row per column, are collected. The rows at the limits
   of text columns come from the same shuffle (lengths are summed first), those of numbers
   from one more scan with the limits as literals; the columns below ``distinct_min`` distinct
   values, and they alone, are counted by value once more when the domains are read. Nothing
   is written.

With ``approx_distinct`` only likely low-cardinality columns are counted; the others get
HyperLogLog estimates and their statistics from one direct aggregate (``column_stats``),
and one more scan for their limits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import (
    looks_date_sql, looks_numeric_sql, pct_of, quote_ident, seconds_nonzero_sql, sql_str,
    time_of_day_nonzero_sql,
)
from tablewright.operators.columns import (
    BINARY, DATE, LOB, NUMERIC, TEXT, ProfileColumn, select_profile_columns,
)

DEC = "decimal(38,6)"

STAT_FIELDS = [
    ("column_name", "string"), ("column_data_length", "int"), ("data_type", "string"),
    ("type_class", "string"), ("sql_type", "string"),
    ("min_data_length", DEC), ("max_data_length", DEC), ("avg_data_length", "double"),
    ("min_date", "timestamp_ntz"), ("max_date", "timestamp_ntz"),
    ("no_nulls", "bigint"), ("no_zero_length", "bigint"),
    ("no_date_with_hour_minute_second", "bigint"), ("no_date_with_second", "bigint"),
    ("no_is_numeric", "bigint"), ("no_is_date", "bigint"),
    ("min_raw", "string"), ("max_raw", "string"), ("no_non_finite", "bigint"),
]

PROFILE_COLUMNS = [
    "table_schema", "table_name", "column_name", "column_data_length", "data_type",
    "type_class", "sql_type", "min_data_length", "max_data_length", "avg_data_length",
    "min_date", "max_date", "no_distinct", "no_nulls", "no_zero_length", "percentage_nulls",
    "percentage_zero_length", "no_date_with_hour_minute_second", "no_date_with_second",
    "no_is_numeric", "no_is_date", "no_at_limit", "is_fk", "row_count",
    "min_raw", "max_raw", "no_non_finite", "distinct_estimated",
    "data_type_comments", "comments",
]


@dataclass
class ProfileResult:
    profile: DataFrame
    domains: DataFrame
    unknown_columns: list


def _length_sql(pc: ProfileColumn) -> str:
    c = quote_ident(pc.name)
    return f"length({c})" if isinstance(pc.dtype, T.BinaryType) else f"length(rtrim({c}))"


def _finite_sql(c: str) -> str:
    """The value of a floating column, NULL for NaN (the greatest value) and infinities."""
    return f"CASE WHEN abs({c}) < CAST('Infinity' AS DOUBLE) THEN {c} END"


def _exact_cents_sql(c: str) -> tuple[str, str]:
    """Two per-row parts whose sums give SUM(CAST(c AS DECIMAL(36,2))) exactly for a
    floating column of finite values below 1e20, without a decimal cast (a costly text
    round trip) per row.

    When |c| < 1e13 and c*100 is within 1e-7 of an integer k, rounding c to two decimals
    gives exactly k/100, so k is summed as an integer; the other values take the cast.
    """
    fast = f"(abs({c}) < 1e13 AND abs({c} * 100 - rint({c} * 100)) < 1e-7)"
    cents = f"CASE WHEN {fast} THEN CAST(CAST(rint({c} * 100) AS BIGINT) AS DECIMAL(38,0)) END"
    slow = f"CASE WHEN NOT {fast} THEN try_cast({c} AS DECIMAL(36,2)) END"
    return cents, slow


def _mean_sql(high: str, low: str, exact_total: str, double_total: str, rows: str) -> str:
    """The mean over ``rows`` finite values: from exact decimals while all of them (``low`` to
    ``high``) lie below 1e20 in magnitude (so that no sum can overflow), else from doubles.
    Every value that the divisor counts is in the sum."""
    safe = (f"greatest(abs(CAST({high} AS DOUBLE)), abs(CAST({low} AS DOUBLE))) < 1e20"
            f" AND ({exact_total}) IS NOT NULL")
    return (f"CASE WHEN {rows} > 0 THEN CASE WHEN {safe} THEN CAST({exact_total} AS DOUBLE)"
            f" ELSE {double_total} END / {rows} END")


def _column_parts(i: int, pc: ProfileColumn, is_numeric=looks_numeric_sql, is_date=looks_date_sql):
    """(pre-projection expressions, named_struct SQL) for one column.

    Per-row work (lengths, pattern tests, time-of-day tests) is computed once in a
    projection; the aggregate then only folds those values. Both run in the same stage.
    """
    c = quote_ident(pc.name)
    pre: dict[str, str] = {}

    def col(tag: str, expr: str) -> str:
        name = f"_p{i}_{tag}"
        pre[name] = expr
        return name

    v = {name: "NULL" for name, _ in STAT_FIELDS}
    v["column_name"] = sql_str(pc.name)
    v["column_data_length"] = "NULL" if pc.declared_length is None else str(pc.declared_length)
    v["data_type"] = sql_str(pc.dtype.simpleString())
    v["type_class"] = sql_str(pc.type_class)
    v["sql_type"] = sql_str(pc.sql_type)
    v["no_nulls"] = f"count_if({col('null', f'{c} IS NULL')})"
    is_string = isinstance(pc.dtype, (T.StringType, T.VarcharType, T.CharType))
    ntz = isinstance(pc.dtype, T.TimestampNTZType)

    if pc.type_class in (TEXT, LOB, BINARY):
        ln = col("len", _length_sql(pc))
        v["max_data_length"] = f"max({ln})"
        v["min_data_length"] = f"min({ln})"
        # integer average, as the reference's AVG over an integer length
        v["avg_data_length"] = f"CAST(avg({ln}) AS BIGINT)"
    if pc.type_class == TEXT and is_string:
        v["no_is_numeric"] = f"count_if({col('num', is_numeric(c))})"
        v["no_is_date"] = f"count_if({col('date', is_date(c))})"
    if pc.type_class in (TEXT, LOB) and is_string:
        v["no_zero_length"] = f"count_if({col('blank', f'length(trim({c})) = 0')})"
    if pc.type_class == NUMERIC:
        floating = isinstance(pc.dtype, (T.FloatType, T.DoubleType))
        raw = col("v", _finite_sql(c) if floating else c)
        v["max_data_length"] = f"try_cast(max({raw}) AS {DEC})"
        v["min_data_length"] = f"try_cast(min({raw}) AS {DEC})"
        v["max_raw"] = f"CAST(max({raw}) AS STRING)"
        v["min_raw"] = f"CAST(min({raw}) AS STRING)"
        if floating:
            odd = col("odd", f"{c} IS NOT NULL AND ({_finite_sql(c)}) IS NULL")
            v["no_non_finite"] = f"count_if({odd})"
            cents_sql, slow_sql = _exact_cents_sql(f"({_finite_sql(c)})")
            cents, slow = col("cents", cents_sql), col("slow", slow_sql)
            total = (f"(coalesce(try_sum({cents}), 0) * CAST(0.01 AS DECIMAL(3,2))"
                     f" + coalesce(try_sum({slow}), 0))")
        else:
            total = f"try_sum({col('dec', f'try_cast({c} AS DECIMAL(36,2))')})"
        v["avg_data_length"] = _mean_sql(f"max({raw})", f"min({raw})", total, f"sum(CAST({raw} AS DOUBLE))", f"count({raw})")
    if pc.type_class == DATE:
        raw = col("v", c)
        v["max_date"] = f"CAST(max({raw}) AS TIMESTAMP_NTZ)"
        v["min_date"] = f"CAST(min({raw}) AS TIMESTAMP_NTZ)"
        if isinstance(pc.dtype, (T.TimestampType, T.TimestampNTZType)):
            tod = col("tod", time_of_day_nonzero_sql(c, ntz))
            sec = col("sec", seconds_nonzero_sql(c, ntz))
            v["no_date_with_hour_minute_second"] = f"count_if({tod})"
            v["no_date_with_second"] = f"count_if({sec})"
    struct = "named_struct(" + ", ".join(f"'{name}', CAST({v[name]} AS {t})"
                                         for name, t in STAT_FIELDS) + ")"
    return pre, struct


def column_stats(df: DataFrame, cols: list[ProfileColumn], **predicates) -> DataFrame:
    """Stage 1: one projection + one aggregate over ``df`` -> one row per column
    (+ row_count). A single scan, partial aggregation per task, one tiny shuffle."""
    pre: dict[str, str] = {}
    structs = []
    for i, pc in enumerate(cols):
        p, st = _column_parts(i, pc, **predicates)
        pre.update(p)
        structs.append(st)
    projected = df.select(*[F.expr(e).alias(n) for n, e in pre.items()])
    agg = projected.agg(F.expr(f"array({', '.join(structs)})").alias("cols"),
                        F.count(F.lit(1)).alias("row_count"))
    return agg.select(F.inline("cols"), "row_count")


@dataclass
class _Slot:
    """A typed column of the value counts: the columns (positions) that it holds."""
    name: str
    stat: str
    members: list


@dataclass
class _Counts:
    """Value counts of all columns: rows (_ci, one column per slot, count)."""
    frame: DataFrame
    slots: list
    cols: list


def _kind_of(pc: ProfileColumn, digest_lob: bool, collation: str | None):
    """(grouping bucket, statistics family, typed value). Values are grouped in their own
    type; long text as (digest, length, blank) so whole texts are never shuffled."""
    c = F.col(quote_ident(pc.name))
    dt = pc.dtype
    if pc.type_class == LOB and digest_lob:
        if isinstance(dt, T.BinaryType):
            v = F.struct(F.sha2(c, 256).alias("d"), F.length(c).alias("len"),
                         F.lit(None).cast("boolean").alias("blank"))
            return "lob_bin", "lob_bin", F.when(c.isNotNull(), v)
        s = c.cast("string")
        v = F.struct(F.sha2(s, 256).alias("d"), F.length(F.rtrim(s)).alias("len"),
                     (F.length(F.trim(s)) == 0).alias("blank"))
        return "lob_text", "lob_text", F.when(c.isNotNull(), v)
    if isinstance(dt, T.BinaryType):
        return "binary", "binary", c
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        if collation:
            # values equal under the collation (e.g. UTF8_LCASE: case-blind) form one group
            coll = F.expr(f"collate({quote_ident(pc.name)}, {sql_str(collation)})")
            return f"text:{collation}", "text_collated", coll
        return "text", "text", c.cast("string")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return dt.simpleString(), "exact_num", c
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return dt.simpleString(), "float_num", c
    if isinstance(dt, T.DateType):
        return "date", "date", c
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp_ntz", "ts_ntz", c
    if isinstance(dt, T.TimestampType):
        return "timestamp", "ts", c
    if isinstance(dt, T.BooleanType):
        return "boolean", "other", c
    return "other", "other", c.cast("string")


def _value_counts(df: DataFrame, cols: list[ProfileColumn], digest_lob: bool = True,
                  collation: str | None = None) -> _Counts:
    """One unpivot (Generate) of all columns feeding a partial aggregate per map task, then
    one shuffle on (column position, value). Every kind of value has a slot of its type."""
    slots: dict[str, _Slot] = {}
    values = []
    for i, pc in enumerate(cols):
        kind, stat, value = _kind_of(pc, digest_lob, collation)
        slot = slots.setdefault(kind, _Slot(f"_v{len(slots)}", stat, []))
        slot.members.append(i)
        values.append((slot.name, value))
    first = {slot.name: values[slot.members[0]][1] for slot in slots.values()}
    types = df.select(*[v.alias(n) for n, v in first.items()]).schema
    structs = [F.struct(F.lit(i).alias("_ci"), *[
        (value if f.name == own else F.lit(None)).cast(f.dataType).alias(f.name) for f in types.fields])
        for i, (own, value) in enumerate(values)]
    frame = (df.select(F.inline(F.array(*structs)))
               .groupBy("_ci", *first).agg(F.count(F.lit(1)).alias("count")))
    return _Counts(frame, list(slots.values()), cols)


@dataclass
class _Encoding:
    """How one kind of column is grouped: by words, with a typed ``slot`` (None: not needed)
    for what no word holds, or by values of the slot alone."""
    slot: str | None
    stat: str
    dtype: T.DataType
    words: bool
    members: list


@dataclass
class _Words:
    """Rows (_ci, _w, one column per slot, count, _bits, _low) of all columns."""
    frame: DataFrame
    slots: list
    cols: list


def _whole_of(pc: ProfileColumn) -> tuple[str, str] | None:
    """(whole number of a value, condition that it stands for the value) as SQL, where values
    of the column's type can be told by whole numbers: injective, and in the same order."""
    c, dt = quote_ident(pc.name), pc.dtype
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return f"CAST({c} AS BIGINT)", "true"
    if isinstance(dt, T.DecimalType) and dt.precision <= 17 and dt.scale <= 2:
        return f"CAST({c} * {10 ** dt.scale} AS BIGINT)", "true"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        fits = f"abs({c}) < 1e13 AND CAST(rint(CAST({c} AS DOUBLE) * 100) / 100 AS {dt.simpleString()}) = {c}"
        return f"CAST(CASE WHEN abs({c}) < 1e13 THEN rint(CAST({c} AS DOUBLE) * 100) END AS BIGINT)", fits
    if isinstance(dt, T.DateType):
        return f"CAST(unix_date({c}) AS BIGINT)", "true"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        late = time_of_day_nonzero_sql(c, isinstance(dt, T.TimestampNTZType))
        return (f"CAST(unix_date(CAST({c} AS DATE)) AS BIGINT)",
                f"NOT ({late}) AND CAST(CAST({c} AS DATE) AS {dt.simpleString()}) = {c}")
    return None


def _encoded_counts(df: DataFrame, cols: list[ProfileColumn], collation: str | None = None) -> _Words:
    """One unpivot (Generate) of all columns feeding a partial aggregate per map task, then
    one shuffle on (column position, word or value)."""
    encodings, slots, rows = {}, {}, []
    for i, pc in enumerate(cols):
        kind, stat, value = _kind_of(pc, True, collation)
        whole = _whole_of(pc)
        spare = None                                       # the slot of values that no word holds
        if whole is None or whole[1] != "true":
            spare = slots.setdefault(kind, f"_v{len(slots)}")
        enc = encodings.setdefault((kind, whole is not None), _Encoding(spare, stat, pc.dtype, whole is not None, []))
        enc.members.append(i)
        if whole is None:
            rows.append((None, spare, value))
        else:
            number, fits = whole
            u = F.expr(f"CASE WHEN {fits} THEN {number} END" if fits != "true" else number)
            rows.append((u, spare, F.when(~F.coalesce(F.expr(fits), F.lit(False)), value) if spare else None))
    firsts = {}
    for _, spare, value in rows:
        if spare is not None:
            firsts.setdefault(spare, value)
    types = df.select(*[v.alias(n) for n, v in firsts.items()]).schema.fields if firsts else []
    none = F.lit(None)
    structs = [F.struct(F.lit(i).alias("_ci"), (none.cast("bigint") if u is None else u).alias("_u"), *[
        (value if f.name == spare else none).cast(f.dataType).alias(f.name) for f in types])
        for i, (u, spare, value) in enumerate(rows)]
    flat = df.select(F.inline(F.array(*structs)))
    frame = flat.groupBy("_ci", F.shiftright("_u", 6).alias("_w"), *firsts).agg(
        F.count(F.lit(1)).alias("count"), F.expr("bit_or(shiftleft(1L, CAST(_u & 63 AS INT)))").alias("_bits"),
        F.sum(F.col("_u").bitwiseAND(F.lit(63))).alias("_low"))
    return _Words(frame, list(encodings.values()), cols)


def _text_of(slot: _Slot) -> Column:
    v = F.col(slot.name)
    if slot.stat in ("lob_text", "lob_bin"):
        return v.getField("d")
    if slot.stat == "binary":
        return F.hex(v)
    return v.cast("string")


def _weighted(pred: str) -> str:
    return f"coalesce(sum(CASE WHEN {pred} THEN count END), 0)"


def _slot_stats_sql(stat: str, value: str, is_numeric=looks_numeric_sql, is_date=looks_date_sql) -> dict[str, str]:
    """Statistics of one column from its (value, count) rows, as SQL text."""
    nn = f"sum(CASE WHEN {value} IS NOT NULL THEN count END)"
    out = {"row_count": "sum(count)", "no_nulls": _weighted(f"{value} IS NULL"),
           "no_distinct": f"count({value})"}

    def lengths(ln):
        out["max_data_length"] = f"max({ln})"
        out["min_data_length"] = f"min({ln})"
        # integer average of the lengths, as the reference's AVG over an integer
        out["avg_data_length"] = f"CAST(sum({ln} * count) / {nn} AS BIGINT)"

    if stat in ("text", "text_collated"):
        s = value if stat == "text" else f"CAST({value} AS STRING)"
        lengths(f"length(rtrim({s}))")
        out["no_is_numeric"] = _weighted(is_numeric(s))
        out["no_is_date"] = _weighted(is_date(s))
        out["no_zero_length"] = _weighted(f"length(trim({s})) = 0")
    elif stat == "lob_text":
        lengths(f"{value}.len")
        out["no_zero_length"] = _weighted(f"{value}.blank")
    elif stat == "lob_bin":
        lengths(f"{value}.len")
    elif stat == "binary":
        lengths(f"length({value})")
    elif stat == "exact_num":
        out["max_data_length"] = f"try_cast(max({value}) AS {DEC})"
        out["min_data_length"] = f"try_cast(min({value}) AS {DEC})"
        out["max_raw"] = f"CAST(max({value}) AS STRING)"
        out["min_raw"] = f"CAST(min({value}) AS STRING)"
        total = f"try_sum(try_multiply(try_cast({value} AS DECIMAL(36,2)), count))"
        out["avg_data_length"] = _mean_sql(f"max({value})", f"min({value})", total, f"sum(CAST({value} AS DOUBLE) * count)", nn)
    return out


def _word_stats_sql(enc: _Encoding) -> dict[str, str]:
    """Statistics of a column whose values are words, the ones that no word can hold being
    counted in the slot ``enc.slot``, as SQL text over (_w, _bits, _low, slot, count)."""
    rest = enc.slot
    some = "_w IS NOT NULL" + (f" OR {rest} IS NOT NULL" if rest else "")
    out = {"row_count": "sum(count)", "no_nulls": _weighted(f"NOT ({some})"),
           "no_distinct": "coalesce(sum(CAST(bit_count(_bits) AS BIGINT)), 0)" + (f" + count({rest})" if rest else "")}
    least, most = f"min(_w * 64 + {_FIRST_BIT})", f"max(_w * 64 + {_LAST_BIT})"
    total = "try_sum(try_add(try_multiply(CAST(_w * 64 AS DECIMAL(20,0)), CAST(count AS DECIMAL(18,0))), CAST(_low AS DECIMAL(20,0))))"
    if enc.stat == "exact_num":
        kind = enc.dtype.simpleString()
        unit = {0: "1", 1: "0.1BD", 2: "0.01BD"}[enc.dtype.scale if isinstance(enc.dtype, T.DecimalType) else 0]

        def number(u):
            return f"CAST({u} * {unit} AS {kind})"

        low, high = number(least), number(most)
        exact = f"{total} * {unit}"
        rows, double = _weighted("_w IS NOT NULL"), "sum(CAST(_w * 64 AS DOUBLE) * count + _low)"
    elif enc.stat == "float_num":
        kind, finite = enc.dtype.simpleString(), f"({_finite_sql(rest)})"

        def ends(f, u):
            return f"CAST({f}(CAST({u} AS DOUBLE) / 100, {'min' if f == 'least' else 'max'}({finite})) AS {kind})"

        low, high = ends("least", least), ends("greatest", most)
        cents, slow = _exact_cents_sql(finite)
        exact = (f"((coalesce({total}, 0) + coalesce(try_sum(try_multiply({cents}, count)), 0)) * CAST(0.01 AS DECIMAL(3,2))"
                 f" + coalesce(try_sum(try_multiply({slow}, count)), 0))")
        rows = _weighted(f"_w IS NOT NULL OR {finite} IS NOT NULL")
        double = (f"(coalesce(sum((CAST(_w * 64 AS DOUBLE) * count + _low) / 100), 0)"
                  f" + coalesce(sum({finite} * count), 0))")
        out["no_non_finite"] = _weighted(f"{rest} IS NOT NULL AND {finite} IS NULL")
    else:
        if enc.stat != "other":
            kind = enc.dtype.simpleString()

            def day(f, u):
                at = f"CAST(date_from_unix_date(CAST({u} AS INT)) AS {kind})"
                return f"CAST({f}({at}, {'min' if f == 'least' else 'max'}({rest})) AS TIMESTAMP_NTZ)" if rest else f"CAST({at} AS TIMESTAMP_NTZ)"

            out["min_date"], out["max_date"] = day("least", least), day("greatest", most)
        if enc.stat in ("ts", "ts_ntz"):       # a word holds midnights
            out["no_date_with_hour_minute_second"] = _weighted(time_of_day_nonzero_sql(rest, enc.stat == "ts_ntz"))
            out["no_date_with_second"] = _weighted(seconds_nonzero_sql(rest, enc.stat == "ts_ntz"))
        return out
    out["max_data_length"], out["min_data_length"] = f"try_cast({high} AS {DEC})", f"try_cast({low} AS {DEC})"
    out["max_raw"], out["min_raw"] = f"CAST({high} AS STRING)", f"CAST({low} AS STRING)"
    out["avg_data_length"] = _mean_sql(high, low, exact, double, rows)
    return out


#: Places (0 to 63) of the first and last bit of a word's row.
_FIRST_BIT = "CASE WHEN _bits = shiftleft(1L, 63) THEN 63 ELSE bit_count(~_bits & (_bits - 1)) END"
_LAST_BIT = ("CASE WHEN shiftrightunsigned(_bits, 32) > 0 THEN 32 + CAST(floor(log2(shiftrightunsigned(_bits, 32))) AS INT)"
             " ELSE CAST(floor(log2(_bits)) AS INT) END")


COUNTED_FIELDS = [(n, t) for n, t in STAT_FIELDS
                  if n not in ("column_name", "column_data_length", "data_type", "type_class",
                               "sql_type")] + [
    ("row_count", "bigint"), ("no_distinct", "bigint")]


def _per_slot(counts: _Words, expr_of) -> str:
    """SQL that picks, by the column position, the expression of the column's slot."""
    cases = [(slot.members, expr_of(slot)) for slot in counts.slots]
    cases = [f"WHEN _ci IN ({', '.join(map(str, m))}) THEN {e}" for m, e in cases if e is not None]
    return f"CASE {' '.join(cases)} END" if cases else "NULL"


def _names(counts: _Counts) -> Column:
    return F.element_at(F.array(*[F.lit(pc.name) for pc in counts.cols]), F.col("_ci") + 1).alias("column_name")


def _stats_from_counts(counts: _Words, with_limits: bool = False, **predicates) -> DataFrame:
    """Per column: every statistic folded from the rows of its words and values (one small
    aggregate), and with ``with_limits`` the rows at the smallest and largest length (D-16;
    those of numbers come from ``boundary_counts``)."""
    exprs = {id(e): _word_stats_sql(e) if e.words else _slot_stats_sql(e.stat, e.slot, **predicates) for e in counts.slots}
    aggs = [F.expr(f"CAST({_per_slot(counts, lambda e: exprs[id(e)].get(n))} AS {t})").alias(n)  # noqa: B023
            for n, t in COUNTED_FIELDS]
    names = [n for n, _ in COUNTED_FIELDS]
    stats = counts.frame.groupBy("_ci").agg(*aggs)
    if not with_limits:
        return stats.select(_names(counts), *names)
    lengthy = [i for e in counts.slots if e.stat in _LENGTH for i in e.members]
    numbers = [i for e in counts.slots if e.stat in ("exact_num", "float_num") for i in e.members]
    if not lengthy:
        at = F.when(F.col("_ci").isin(numbers), F.lit(0)) if numbers else F.lit(None)
        return stats.select(_names(counts), *names, at.cast("bigint").alias("no_at_limit"))
    # counts of equal length are summed first; the same shuffle is read again (an identical
    # exchange), one row per column comes out and is broadcast
    length = F.expr(_per_slot(counts, lambda e: _LENGTH[e.stat].format(v=e.slot) if e.stat in _LENGTH else None))
    by_length = counts.frame.groupBy("_ci", length.cast("bigint").alias("_m")).agg(F.sum("count").alias("count"))
    ends = by_length.groupBy("_ci").agg(F.expr(f"CAST({_ends_sql('_m')} AS BIGINT)").alias("_at_length"))
    at = F.when(F.col("_ci").isin(lengthy), F.coalesce("_at_length", F.lit(0)))
    at = at.when(F.col("_ci").isin(numbers), F.lit(0)) if numbers else at
    return stats.join(F.broadcast(ends), "_ci").select(_names(counts), *names, at.cast("bigint").alias("no_at_limit"))


_LENGTH = {"text": "length(rtrim({v}))", "text_collated": "length(rtrim(CAST({v} AS STRING)))",
           "binary": "length({v})", "lob_text": "{v}.len"}


def _ends_sql(m: str) -> str:
    """Rows at the smallest and largest measure, each measure standing in one row."""
    return (f"max_by(count, {m}) FILTER (WHERE {m} IS NOT NULL) + CASE WHEN min({m}) = max({m}) THEN 0"
            f" ELSE min_by(count, {m}) FILTER (WHERE {m} IS NOT NULL) END")


def _text_counts(counts: _Counts) -> DataFrame:
    return counts.frame.select(_names(counts), F.coalesce(*[_text_of(s) for s in counts.slots]).alias("value"), "count")


def value_counts(df: DataFrame, columns, *, lob_cols=(), digest_lob: bool = True,
                 collation: str | None = None) -> DataFrame:
    """(column_name, value, count) for every value of every listed column, NULL included.

    Values are grouped in their own type (one scan, one shuffle) and turned into text after
    aggregation: binary as hex, long text as its SHA-256 digest when ``digest_lob``.
    """
    from tablewright.operators.columns import classify
    cols = [item if isinstance(item, ProfileColumn) else classify(df.schema[item], lob_cols)
            for item in columns]
    return _text_counts(_value_counts(df, cols, digest_lob, collation))


def _distinct_from_counts(vc: DataFrame) -> DataFrame:
    """Per column: distinct non-null values and total rows (NULL group included)."""
    return vc.groupBy("column_name").agg(F.count("value").alias("no_distinct"),
                                         F.sum("count").cast("bigint").alias("row_total"))


def _length_of(pc: ProfileColumn) -> Column:
    return F.expr(_length_sql(pc))


def _count_if(pred: Column) -> Column:
    return F.count_if(F.coalesce(pred, F.lit(False)))


def boundary_counts(df: DataFrame, stats_rows, cols: list[ProfileColumn]) -> DataFrame:
    """Stage 3 (D-16): rows whose value (numerics) or length (text, binary) sits at the
    column's min or max; one aggregate, limits passed as literals."""
    by_name = {pc.name: pc for pc in cols}
    exprs = []
    for r in stats_rows:
        pc = by_name.get(r["column_name"])
        if pc is None:
            continue
        c = F.col(quote_ident(pc.name))
        if pc.type_class == NUMERIC and r["max_raw"] is not None:
            hi, lo = F.lit(r["max_raw"]).cast(pc.dtype), F.lit(r["min_raw"]).cast(pc.dtype)
            pred = (c == hi) | (c == lo)
        elif pc.type_class in (TEXT, BINARY) or (pc.type_class == LOB and pc.sql_type == "varchar"):
            if r["max_data_length"] is None:
                continue
            ln = _length_of(pc)
            pred = (ln == int(r["max_data_length"])) | (ln == int(r["min_data_length"]))
        else:
            continue
        exprs.append(F.struct(F.lit(pc.name).alias("column_name"),
                              _count_if(pred).alias("no_at_limit")))
    schema = "column_name string, no_at_limit bigint"
    if not exprs:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(F.array(*exprs).alias("a")).select(F.inline("a"))


def domain_analysis(vc: DataFrame, distinct: DataFrame | None = None,
                    distinct_min: int = 200) -> DataFrame:
    """D-17/D-18: value domains of the columns with fewer than ``distinct_min`` distinct
    values; the NULL group is kept; percent of the column's rows as decimal(7,4).

    ``vc`` is a value-count table; ``distinct`` its per-column summary (derived from ``vc``
    when not given), so no further scan of the table is needed.
    """
    if distinct is None:
        distinct = _distinct_from_counts(vc)
    low = (distinct.where(F.col("no_distinct") < distinct_min)
                   .select("column_name", "row_total"))
    # `low` has at most one row per profiled column: a proven size bound for broadcast.
    dom = vc.join(F.broadcast(low), "column_name")
    return dom.select(
        F.col("column_name").alias("domain_name"),
        F.col("value").alias("domain_element"),
        F.col("count").alias("domain_counter"),
        pct_of(F.col("count"), F.col("row_total"), scale=4, precision=7).alias("domain_percent"),
    )


def profile(df: DataFrame, *, columns=None, text=True, numeric=True, date=True, lob=True,
            lob_cols=(), advanced=False, distinct_min=200, boundary=0.57, null_pct=90.0,
            type_pct=2, fks=None, approx_distinct: float | None = None,
            table_schema: str | None = None, table_name: str | None = None,
            sparse_thresholds: DataFrame | None = None, collation: str | None = None,
            is_numeric=looks_numeric_sql, is_date=looks_date_sql,
            require_rows: bool = False) -> ProfileResult:
    """Profile every selected column of ``df``.

    Returns the profile (one row per column, suggestions included) and the domains (empty
    unless ``advanced``). ``fks``: names of foreign-key columns (list or DataFrame with
    ``column_name``). ``approx_distinct``: relative SD; high-cardinality columns then get
    HyperLogLog counts and only likely-low-cardinality columns are counted exactly.
    ``collation``: text compared under this collation for distinct counts and domains
    (e.g. ``"UTF8_LCASE"`` for case-blind, as a case-insensitive database collation would,
    or ``"UTF8_BINARY_RTRIM"`` to ignore trailing blanks); binary comparison by default.
    ``is_numeric`` and ``is_date`` turn the SQL text of a column into that of the test for
    numeric-looking and date-looking text. ``require_rows`` refuses an empty frame (reads
    one row at most).

    Floating columns: NaN and infinities are counted in ``no_non_finite`` and take no part
    in minimum, maximum and mean. ``min_raw`` and ``max_raw`` hold the limits as text, also
    where they are beyond the decimal of ``min_data_length`` and ``max_data_length``.
    ``distinct_estimated`` marks the columns whose distinct count is an estimate (they have
    no domains).
    """
    if require_rows and df.isEmpty():
        raise ValueError("There is no data in the table to analyse")
    from tablewright.operators.suggest import suggest

    cols, unknown = select_profile_columns(df.schema, columns, text=text, numeric=numeric,
                                           date=date, lob=lob, lob_cols=lob_cols)
    spark = df.sparkSession

    exact_cols, approx_cols, est = cols, [], {}
    if approx_distinct is not None:
        # HyperLogLog sketches in an aggregate of their own: an imperative aggregate in a
        # wide aggregate takes all of it off whole-stage codegen.
        # Bounded collect: one estimate per profiled column.
        first = df.agg(*[F.approx_count_distinct(F.col(quote_ident(pc.name)), approx_distinct)
                         .alias(f"_a{i}") for i, pc in enumerate(cols)]).first()
        est = {pc.name: int(first[i]) for i, pc in enumerate(cols)}
        margin = 1.0 + 4 * approx_distinct
        exact_cols = [pc for pc in cols if est[pc.name] < distinct_min * margin]
        approx_cols = [pc for pc in cols if pc not in exact_cols]

    predicates = {"is_numeric": is_numeric, "is_date": is_date}
    frames = []
    if exact_cols:
        counts = _encoded_counts(df, exact_cols, collation)
        frames.append(_stats_from_counts(counts, with_limits=advanced, **predicates))
    if approx_cols:
        # High-cardinality columns: statistics from one direct aggregate, distinct estimated.
        est_df = spark.createDataFrame([(pc.name, est[pc.name]) for pc in approx_cols],
                                       "column_name string, no_distinct bigint")
        direct = column_stats(df, approx_cols, **predicates).select(
            "column_name", *[n for n, _ in COUNTED_FIELDS if n != "no_distinct"])
        direct = direct.join(F.broadcast(est_df), "column_name")
        if advanced:      # filled in below, from a scan with the limits as literals
            direct = direct.withColumn("no_at_limit", F.lit(None).cast("bigint"))
        frames.append(direct)
    stats = reduce(DataFrame.unionByName, frames)
    rows = []
    if advanced:
        rows = stats.collect()          # one row per column: what the domains and limits need
        stats = spark.createDataFrame(rows, stats.schema)
    skeleton = spark.createDataFrame(
        [(pc.name, pc.declared_length, pc.dtype.simpleString(), pc.type_class, pc.sql_type)
         for pc in cols],
        "column_name string, column_data_length int, data_type string, type_class string, "
        "sql_type string")
    # one row per profiled column on both sides: bounded by the schema
    prof = (skeleton.join(F.broadcast(stats), "column_name", "left")
                    .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
                    .withColumn("no_nulls", F.coalesce("no_nulls", F.lit(0).cast("bigint")))
                    .withColumn("no_distinct", F.coalesce("no_distinct", F.lit(0).cast("bigint"))))
    is_fk = F.lit(False)
    if fks is not None:
        fk_df = fks if isinstance(fks, DataFrame) else spark.createDataFrame(
            [(n,) for n in fks], "column_name string")
        # one row per foreign-key column of the table: bounded by its width
        wanted = skeleton.select("column_name")
        fk_names = (fk_df.select("column_name").join(F.broadcast(wanted), "column_name", "left_semi")
                    .distinct().withColumn("_fk", F.lit(True)))
        prof = prof.join(F.broadcast(fk_names), "column_name", "left")
        is_fk = F.coalesce(F.col("_fk"), F.lit(False))

    domains = spark.createDataFrame(
        [], "domain_name string, domain_element string, domain_counter bigint, "
            "domain_percent decimal(7,4)")
    if advanced:
        scanned = approx_cols + [pc for pc in exact_cols if pc.type_class == NUMERIC]
        if scanned:
            # numbers, and columns without value counts: one more scan, their limits as literals
            own = [r for r in rows if r["column_name"] in {pc.name for pc in scanned}]
            found = boundary_counts(df, own, scanned).withColumnRenamed("no_at_limit", "_scanned_at")
            prof = prof.join(F.broadcast(found), "column_name", "left").withColumn(
                "no_at_limit", F.coalesce("_scanned_at", "no_at_limit")).drop("_scanned_at")
        exact = {pc.name: pc for pc in exact_cols}
        low = [exact[r["column_name"]] for r in rows
               if r["column_name"] in exact and r["no_distinct"] < distinct_min]
        if low:
            distinct = stats.select("column_name", "no_distinct", F.col("row_count").alias("row_total"))
            vc = _text_counts(_value_counts(df, low, False, collation))
            domains = domain_analysis(vc, distinct, distinct_min).orderBy(
                F.col("domain_name").asc(), F.col("domain_counter").desc())
    at_limit = F.col("no_at_limit") if advanced else F.lit(None).cast("bigint")

    keep = [c for c in PROFILE_COLUMNS if c not in (
        "table_schema", "table_name", "percentage_nulls",
        "percentage_zero_length", "no_at_limit", "is_fk", "data_type_comments", "comments",
        "distinct_estimated")]
    base = prof.select(
        F.lit(table_schema).cast("string").alias("table_schema"),
        F.lit(table_name).cast("string").alias("table_name"),
        *keep,
        pct_of("no_nulls", "row_count").alias("percentage_nulls"),
        pct_of("no_zero_length", "row_count").alias("percentage_zero_length"),
        at_limit.alias("no_at_limit"), is_fk.alias("is_fk"),
        F.col("column_name").isin([pc.name for pc in approx_cols]).alias("distinct_estimated"))
    out = suggest(base, distinct_min=distinct_min, null_pct=null_pct, type_pct=type_pct,
                  boundary=boundary if advanced else None, sparse_thresholds=sparse_thresholds)
    return ProfileResult(out.select(*PROFILE_COLUMNS), domains, unknown)


def profile_table(spark, name: str, *, require_rows: bool = True, **options) -> ProfileResult:
    """Profile a catalogue table by name (S-01/S-02 with the P-03 guards): the table must
    exist, and – unless ``require_rows=False`` – hold at least one row (checked by reading
    at most one row). ``options`` are those of :func:`profile`."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"The table does not exist: {name}")
    parts = name.split(".")
    schema = parts[-2] if len(parts) > 1 else spark.catalog.currentDatabase()
    return profile(spark.table(name), table_schema=schema, table_name=parts[-1],
                   require_rows=require_rows, **options)

