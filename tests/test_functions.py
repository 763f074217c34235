import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tablewright.functions import (
    decode_status, hhmmss_minutes, int_div, looks_date_sql, looks_numeric_sql, pct_of,
    quote_ident, second_boundaries,
)


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_hhmmss_minutes(spark):
    vals = [0, 28, 29, 30, 5959, 10129, 235959]
    got = one(spark, [(v,) for v in vals], "d int", hhmmss_minutes("d"))
    assert got == [0, 0, 1, 1, 60, 62, 1440]


def test_decode_status(spark):
    got = one(spark, [(0,), (1,), (2,), (3,), (4,), (9,), (None,)], "s int", decode_status("s"))
    assert got == ["Failed", "Succeeded", "Retry", "Canceled", "In Progress", "Unknown", "Unknown"]


def test_looks_numeric(spark):
    vals = ["12", "1e5", ".5", "NaN", "12f", "", " 7 ", "-3.5E-2", "1.2.3", None]
    got = one(spark, [(v,) for v in vals], "s string", F.expr(looks_numeric_sql("s")))
    assert got == [True, True, True, False, False, False, True, True, False, False]


def test_looks_date(spark):
    vals = ["2018-03-29", "20180329", "2018", "13/45/2018", "03/29/2018",
            "2018-03-29 10:11:12", "2018-02-30", None]
    got = one(spark, [(v,) for v in vals], "s string", F.expr(looks_date_sql("s")))
    assert got == [True, True, False, False, True, True, False, False]


def test_pct_of_multiplies_before_dividing(spark):
    got = one(spark, [(1, 3), (2, 3), (9, 10), (0, 5), (1, 0)], "n bigint, t bigint",
              pct_of("n", "t"))
    assert got == [Decimal("33.3333"), Decimal("66.6667"), Decimal("90.0000"),
                   Decimal("0.0000"), None]


def test_pct_of_beyond_bigint_products(spark):
    got = one(spark, [(5 * 10**12, 10**13), (9 * 10**18, 9 * 10**18)], "n bigint, t bigint", pct_of("n", "t"))
    assert got == [Decimal("50.0000"), Decimal("100.0000")]


def test_int_div_large_values(spark):
    got = one(spark, [(4_611_686_018_427_387_903, 7)], "a bigint, b bigint", int_div("a", "b"))
    assert got == [4_611_686_018_427_387_903 // 7]


def test_second_boundaries_counts_crossings(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0, 900000), dt.datetime(2024, 1, 1, 0, 0, 1, 0)),
            (dt.datetime(2024, 1, 1, 0, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 0, 0, 999999)),
            (dt.datetime(2024, 1, 1, 23, 59, 59), dt.datetime(2024, 1, 2, 0, 1, 0))]
    got = one(spark, rows, "a timestamp_ntz, b timestamp_ntz", second_boundaries("a", "b"))
    assert got == [1, 0, 61]


def test_quote_ident():
    assert quote_ident("a`b") == "`a``b`"
