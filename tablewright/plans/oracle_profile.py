"""DuckDB SQL that states the profiler's rules column by column (the differential oracle).

It shares nothing with the Spark operator: one SELECT per column with plain aggregates and
COUNT(DISTINCT), joined by UNION ALL, then the rules as CASE expressions. Patterns, limits,
thresholds and texts are stated here once more as plain values.
"""

from __future__ import annotations

# --- fixed values, as the rules demand them ------------------------------------------------
NUMERIC_PATTERN = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_SHAPES = ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^[0-9]{8}$", "^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
               "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
SPARSE_PERCENT = {
    "tinyint": 86, "smallint": 76, "int": 64, "bigint": 52, "real": 64, "float": 52,
    "money": 64, "smallmoney": 64, "smalldatetime": 52, "datetime": 52, "uniqueidentifier": 43,
    "date": 69, "datetime2": 52, "decimal": 42, "numeric": 42, "char": 60, "varchar": 60,
    "nchar": 60, "nvarchar": 60, "binary": 60, "varbinary": 60, "xml": 60,
}
# -------------------------------------------------------------------------------------------
DUCK_DATE_FORMATS = ("%Y-%m-%d", "%Y%m%d", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S")


def sql_pct(n: str, total: str, scale: int = 4, precision: int = 9) -> str:
    factor = 2 * 100 * 10 ** scale
    step = "0." + "0" * (scale - 1) + "1"
    return (f"CAST(CAST(({n} * {factor} + {total}) // (2 * {total}) AS DECIMAL(38,0)) * {step}"
            f" AS DECIMAL({precision},{scale}))")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def column_select(source: str, table_name: str, col: str, cls: str, sql_type: str,
                  decl: str = "NULL", at_limit: bool = False) -> str:
    c = f'"{col}"'
    is_bytes = sql_type in ("binary", "varbinary")
    ln = f"octet_length({c})" if is_bytes else f"length(rtrim({c}))"
    null = "NULL"
    f = {k: null for k in ("min_l", "max_l", "avg_l", "min_d", "max_d", "zero", "tod", "sec",
                           "isnum", "isdate", "limit")}
    if cls in ("text", "lob", "binary"):
        f["min_l"] = f"CAST(MIN({ln}) AS DECIMAL(38,6))"
        f["max_l"] = f"CAST(MAX({ln}) AS DECIMAL(38,6))"
        f["avg_l"] = f"CAST(CAST(trunc(AVG({ln})) AS BIGINT) AS DOUBLE)"
        if not is_bytes:
            f["zero"] = f"COUNT(*) FILTER (WHERE length(trim({c})) = 0)"
        if at_limit:
            f["limit"] = (f"(SELECT COUNT({c}) FROM {source} WHERE {ln} = (SELECT MAX({ln}) "
                          f"FROM {source}) OR {ln} = (SELECT MIN({ln}) FROM {source}))")
    if cls == "text":
        f["isnum"] = f"COUNT(*) FILTER (WHERE regexp_matches(trim({c}), {_q(NUMERIC_PATTERN)}))"
        parsed = ", ".join(f"CASE WHEN regexp_matches(trim({c}), {_q(sh)}) THEN "
                           f"try_strptime(trim({c}), {_q(x)}) END"
                           for x, sh in zip(DUCK_DATE_FORMATS, DATE_SHAPES))
        f["isdate"] = f"COUNT(*) FILTER (WHERE coalesce({parsed}) IS NOT NULL)"
    if cls == "numeric":
        f["min_l"] = f"CAST(MIN({c}) AS DECIMAL(38,6))"
        f["max_l"] = f"CAST(MAX({c}) AS DECIMAL(38,6))"
        f["avg_l"] = (f"CASE WHEN COUNT({c}) > 0 THEN CAST(SUM(CAST({c} AS DECIMAL(36,2))) "
                      f"AS DOUBLE) / COUNT({c}) END")
        if at_limit:
            f["limit"] = (f"(SELECT COUNT({c}) FROM {source} WHERE {c} = (SELECT MAX({c}) "
                          f"FROM {source}) OR {c} = (SELECT MIN({c}) FROM {source}))")
    if cls == "date":
        f["min_d"] = f"CAST(MIN({c}) AS TIMESTAMP)"
        f["max_d"] = f"CAST(MAX({c}) AS TIMESTAMP)"
        if sql_type in ("datetime", "datetime2"):
            f["tod"] = f"COUNT(*) FILTER (WHERE date_trunc('day', {c}) <> {c})"
            f["sec"] = f"COUNT(*) FILTER (WHERE date_trunc('minute', {c}) <> {c})"
    distinct = (f"COUNT(DISTINCT {c})")
    return f"""SELECT {_q(table_name)} AS table_name, {_q(col)} AS column_name,
  {_q(sql_type)} AS sql_type, CAST({decl} AS INTEGER) AS column_data_length,
  {f['min_l']} AS min_data_length, {f['max_l']} AS max_data_length,
  CAST({f['avg_l']} AS DOUBLE) AS avg_data_length,
  CAST({f['min_d']} AS TIMESTAMP) AS min_date, CAST({f['max_d']} AS TIMESTAMP) AS max_date,
  COUNT(*) FILTER (WHERE {c} IS NULL) AS no_nulls, CAST({f['zero']} AS BIGINT) AS no_zero_length,
  CAST({f['tod']} AS BIGINT) AS no_date_with_hour_minute_second,
  CAST({f['sec']} AS BIGINT) AS no_date_with_second,
  CAST({f['isnum']} AS BIGINT) AS no_is_numeric, CAST({f['isdate']} AS BIGINT) AS no_is_date,
  CAST({f['limit']} AS BIGINT) AS no_at_limit,
  {distinct} AS no_distinct, COUNT(*) AS row_count
FROM {source}"""


def _type_rule_sql(type_pct: int) -> str:
    v = f"((row_count * {type_pct}) // 100)"
    near = lambda x: f"{x} BETWEEN row_count - {v} AND row_count + {v}"
    return f"""CASE
  WHEN no_date_with_hour_minute_second = 0 AND sql_type IN ('datetime','datetime2')
       THEN 'Possibly could be DATE type. '
  WHEN no_date_with_second = 0 AND min_date >= TIMESTAMP '1900-01-01'
       AND max_date <= TIMESTAMP '2079-06-06' AND sql_type IN ('datetime','datetime2')
       THEN 'Possibly could be SMALLDATE type. '
  WHEN sql_type = 'datetime2' AND min_date >= TIMESTAMP '1753-01-01'
       AND max_date <= TIMESTAMP '9999-12-31' THEN 'Possibly could be DATETIME type. '
  WHEN min_data_length >= 0 AND max_data_length <= 255
       AND sql_type IN ('bigint','int','smallint') THEN 'Possibly could be TINYINT type. '
  WHEN min_data_length >= -32768 AND max_data_length <= 32767
       AND sql_type IN ('bigint','int') THEN 'Possibly could be SMALLINT type. '
  WHEN min_data_length >= -2147483648 AND max_data_length <= 2147483647
       AND sql_type = 'bigint' THEN 'Possibly could be INT type. '
  WHEN {near('no_is_numeric')} AND sql_type IN ('varchar','nvarchar','char','nchar')
       THEN 'Possibly could be one of the NUMERIC types. '
  WHEN {near('no_is_date')} AND sql_type IN ('varchar','nvarchar','char','nchar')
       THEN 'Possibly could be one of the DATE types. '
END"""


def profile_sql(selects: list[str], *, fks=(), distinct_min=200, null_pct=90.0, type_pct=2,
                boundary: float | None = None) -> str:
    """Wrap per-column SELECTs with percentages and the suggestion rules."""
    fk_list = ", ".join(_q(x) for x in fks) or "NULL"
    sparse = " ".join(f"WHEN {_q(t)} THEN {p}" for t, p in SPARSE_PERCENT.items())
    few = (f"no_distinct < {distinct_min} AND row_count > {distinct_min} AND NOT is_fk")
    boundary_part = "''"
    if boundary is not None:
        boundary_part = (f"CASE WHEN CAST(no_at_limit AS DECIMAL(38,6)) >= "
                         f"CAST(row_count AS DECIMAL(38,6)) * {boundary} "
                         f"THEN 'Large numbers of data elements at the max/minvalues. ' ELSE '' END")
    union = "\nUNION ALL\n".join(selects)
    return f"""WITH s AS (
{union}
), p AS (
  SELECT *, coalesce(column_name IN ({fk_list}), false) AS is_fk,
    {sql_pct('no_nulls', 'row_count')} AS percentage_nulls,
    {sql_pct('no_zero_length', 'row_count')} AS percentage_zero_length
  FROM s
), c AS (
  SELECT *,
    CASE
      WHEN sql_type = 'varbinary' AND column_data_length = -1 AND avg_data_length >= 1000000
        THEN 'Possibly a good candidate for FILESTREAM.'
      WHEN sql_type = 'varbinary' AND column_data_length = -1 AND avg_data_length < 1000000
        THEN 'Possibly not a good candidate for FILESTREAM.'
      ELSE coalesce({_type_rule_sql(type_pct)}, '')
        || CASE WHEN (percentage_nulls = 100 OR percentage_zero_length = 100) AND NOT is_fk
                THEN 'Seems empty - is it required? ' ELSE '' END
        || CASE WHEN percentage_nulls >= {null_pct} THEN 'There is a large percentage of NULLs - attention may be required. ' ELSE '' END
        || CASE WHEN {few} AND percentage_nulls <> 100 AND no_nulls <> 0
                THEN 'Few distinct elements - potential for reference/lookup table (contains NULLs).' ELSE '' END
        || CASE WHEN {few} AND no_nulls = 0 AND lower(sql_type) NOT LIKE '%date%'
                AND lower(sql_type) <> 'time' THEN 'Few distinct elements - potential for Foreign Key.' ELSE '' END
    END
    || CASE WHEN percentage_nulls >= (CASE sql_type {sparse} END) THEN 'Could benefit from sparse columns. '
            ELSE '' END
    || {boundary_part} AS comments_text
  FROM p
)
SELECT * EXCLUDE (comments_text), NULLIF(comments_text, '') AS data_type_comments FROM c"""
