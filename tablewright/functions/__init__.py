from tablewright.functions.tsql import (
    decode_status,
    hhmmss_minutes,
    int_div,
    looks_date_sql,
    looks_numeric_sql,
    pct_of,
    quote_ident,
    second_boundaries,
    seconds_nonzero_sql,
    time_of_day_nonzero_sql,
)

__all__ = [
    "decode_status", "hhmmss_minutes", "int_div", "looks_date_sql", "looks_numeric_sql", "pct_of",
    "quote_ident", "second_boundaries", "seconds_nonzero_sql", "time_of_day_nonzero_sql",
]
