import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright.operators import suggest as S
from tablewright.operators.columns import select_profile_columns
from tablewright.operators.profile import domain_analysis, profile, value_counts

EDGE_SCHEMA = ("id bigint, big bigint, big2 bigint, small int, txt string, ts timestamp, "
               "ts_min timestamp, ts_sec timestamp, ntz timestamp_ntz, empty int, "
               "mostly_null double, flag boolean")


def edge_rows():
    d = dt.datetime
    txt = ["12", "1e5", ".5", "NaN", "12f", "", "  ", "ab  ", None, "2018-03-29"]
    rows = []
    for i in range(10):
        rows.append((
            i, 2147483647 if i == 0 else i, 2147483648 if i == 0 else i,
            32767 if i == 0 else i, txt[i],
            d(2020, 1, 1 + i), d(2020, 1, 1 + i, 10, 30), d(2020, 1, 1, 10, 30, i + 1),
            d(2020, 1, 1 + i), None, 1.5 if i == 0 else None, i % 2 == 0))
    return rows


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


@pytest.fixture(scope="module")
def prof(edge):
    cols = [c for c in edge.columns if c != "flag"]
    return {r["column_name"]: r for r in profile(edge, columns=cols, table_name="edge")
            .profile.collect()}


def test_text_statistics(prof):
    r = prof["txt"]
    assert (r["no_nulls"], r["no_zero_length"], r["no_is_numeric"], r["no_is_date"]) == (1, 2, 3, 1)
    assert r["min_data_length"] == 0 and r["max_data_length"] == 10
    assert r["no_distinct"] == 9
    assert r["percentage_nulls"] == Decimal("10.0000")
    assert r["percentage_zero_length"] == Decimal("20.0000")


def test_integer_type_suggestions_last_rule_wins(prof):
    assert prof["id"]["data_type_comments"].startswith(S.TXT_TINYINT)
    assert prof["big"]["data_type_comments"].startswith(S.TXT_INT)   # 2147483647 fits INT
    assert not (prof["big2"]["data_type_comments"] or "").startswith("Possibly")  # one too high
    assert prof["small"]["data_type_comments"].startswith(S.TXT_SMALLINT)


def test_datetime_rules(prof):
    assert prof["ts"]["no_date_with_hour_minute_second"] == 0
    assert prof["ts"]["data_type_comments"].startswith(S.TXT_DATE)
    assert prof["ts_min"]["no_date_with_second"] == 0
    assert prof["ts_min"]["no_date_with_hour_minute_second"] == 10
    assert prof["ts_min"]["data_type_comments"].startswith(S.TXT_SMALLDATE)
    assert prof["ts_sec"]["no_date_with_second"] == 10
    assert prof["ts_sec"]["data_type_comments"] is None
    # timestamp without zone = datetime2: the narrowest type that holds all values wins
    assert prof["ntz"]["data_type_comments"].startswith(S.TXT_DATE)
    assert prof["ntz"]["min_date"] == dt.datetime(2020, 1, 1)


def test_empty_and_null_comments(prof):
    e = prof["empty"]["comments"]
    assert S.TXT_EMPTY in e and S.TXT_MANY_NULLS in e and S.TXT_SPARSE in e
    m = prof["mostly_null"]
    assert m["percentage_nulls"] == Decimal("90.0000")
    assert S.TXT_MANY_NULLS in m["comments"]          # exactly 90 % counts
    assert S.TXT_SPARSE in m["comments"]              # float threshold 52


def test_numeric_average_is_mean_of_two_decimal_values(prof):
    assert prof["mostly_null"]["avg_data_length"] == 1.5
    assert prof["id"]["avg_data_length"] == 4.5


def test_distinct_never_exceeds_non_null_rows(prof):
    for r in prof.values():
        assert r["no_distinct"] <= r["row_count"] - r["no_nulls"]


def test_lookup_and_fk_candidates(spark):
    rows = [(i % 3, None if i % 2 else "x" + str(i % 4)) for i in range(201)]
    df = spark.createDataFrame(rows, "k int, c string")
    p = {r["column_name"]: r for r in profile(df).profile.collect()}
    assert S.TXT_FK in p["k"]["comments"]
    assert S.TXT_LOOKUP in p["c"]["comments"]
    # with exactly 200 rows neither fires
    df200 = spark.createDataFrame(rows[:200], "k int, c string")
    p200 = {r["column_name"]: r for r in profile(df200).profile.collect()}
    assert S.TXT_FK not in p200["k"]["comments"]
    # a declared foreign key suppresses the candidate remark
    pf = {r["column_name"]: r for r in profile(df, fks=["k"]).profile.collect()}
    assert pf["k"]["is_fk"] and S.TXT_FK not in pf["k"]["comments"]


def test_advanced_boundary_and_domains(spark):
    rows = [(1 if i < 4 else (9 if i < 7 else 5), "a" * (1 + i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "v int, s string")
    res = profile(df, advanced=True)
    p = {r["column_name"]: r for r in res.profile.collect()}
    assert p["v"]["no_at_limit"] == 7
    assert S.TXT_AT_LIMIT in p["v"]["comments"]      # 0.7 >= 0.57
    assert p["s"]["no_at_limit"] == 10
    dom = res.domains.collect()
    by = {}
    for r in dom:
        by.setdefault(r["domain_name"], []).append(r)
    assert sum(r["domain_counter"] for r in by["v"]) == 10
    assert abs(sum(float(r["domain_percent"]) for r in by["v"]) - 100.0) < 0.001
    assert {r["domain_element"] for r in by["v"]} == {"1", "9", "5"}


def test_domains_keep_null_group(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "c string")
    dom = domain_analysis(value_counts(df, ["c"])).collect()
    assert sorted((r["domain_element"] or "∅", r["domain_counter"]) for r in dom) == [("a", 2), ("∅", 1)]


def test_unknown_columns_reported_and_no_columns_refused(spark, edge):
    res = profile(edge, columns="id, nope ,id")
    assert res.unknown_columns == ["nope"]
    assert [r["column_name"] for r in res.profile.collect()] == ["id"]
    with pytest.raises(ValueError):
        select_profile_columns(edge.schema, "nope")


def test_class_switches(edge):
    cols, _ = select_profile_columns(edge.schema, text=False, date=False, lob=False)
    assert {c.name for c in cols} == {"id", "big", "big2", "small", "empty", "mostly_null"}


def test_lob_columns_counted_by_digest(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long,), (long,), ("y",), ("",)], "doc string")
    r = profile(df, lob_cols=["doc"]).profile.collect()[0]
    assert (r["type_class"], r["column_data_length"], r["no_distinct"]) == ("lob", -1, 3)
    assert r["max_data_length"] == 5000 and r["no_zero_length"] == 1


def test_approx_distinct_keeps_low_cardinality_exact(spark):
    rows = [(i, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "hi bigint, lo int")
    p = {r["column_name"]: r for r in profile(df, approx_distinct=0.02).profile.collect()}
    assert p["lo"]["no_distinct"] == 7
    assert abs(p["hi"]["no_distinct"] - 5000) < 5000 * 0.1




def test_exact_cents_path_equals_decimal_cast(spark):
    from hypothesis import given, settings, strategies as st

    from tablewright.operators.columns import select_profile_columns
    from tablewright.operators.profile import column_stats

    special = [1.005, 0.125, 2.675, -1.005, 1e13, 9.999999999999e12, 123456789.125,
               0.0049999999, 1e-9, -0.0, 5e15 + 0.25, 33.333333333]
    values = st.lists(st.one_of(st.sampled_from(special),
                                st.floats(-1e16, 1e16, allow_nan=False, allow_infinity=False),
                                st.integers(-10**9, 10**9).map(lambda k: k / 100)),
                      min_size=1, max_size=40)

    @settings(max_examples=15, deadline=None)
    @given(values)
    def check(xs):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        cols, _ = select_profile_columns(df.schema)
        got = column_stats(df, cols).collect()[0]["avg_data_length"]
        want = df.selectExpr("CAST(sum(CAST(x AS DECIMAL(36,2))) AS DOUBLE) / count(x) AS a"
                             ).collect()[0]["a"]
        assert got == want

    check()


def test_case_blind_collation(spark):
    df = spark.createDataFrame([("a",), ("A",), ("b",), (None,)], "c string")
    assert profile(df).profile.collect()[0]["no_distinct"] == 3
    assert profile(df, collation="UTF8_LCASE").profile.collect()[0]["no_distinct"] == 2


def test_caller_sparse_thresholds(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (None,)], "c int")
    default = profile(df).profile.collect()[0]["comments"]
    assert S.TXT_SPARSE in default                      # 75 % >= 64 for int
    th = spark.createDataFrame([("int", 80.0)], "data_type string, threshold double")
    mine = profile(df, sparse_thresholds=th).profile.collect()[0]["comments"]
    assert S.TXT_SPARSE not in mine


def test_time_of_day_rules(spark):
    from tablewright.functions import tsql
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0),), (dt.datetime(2024, 1, 1, 0, 5),),
                                (dt.datetime(2024, 1, 1, 0, 5, 3),), (dt.datetime(2024, 1, 1, 0, 0, 0, 10),)],
                               "t timestamp_ntz")
    got = ts.select(F.expr(tsql.time_of_day_nonzero_sql("t", True)).alias("a"),
                    F.expr(tsql.seconds_nonzero_sql("t", True)).alias("c")).collect()
    assert [(r["a"], r["c"]) for r in got] == [(False, False), (True, False), (True, True), (True, True)]


def test_advanced_with_approx_columns_matches_exact_limits(spark):
    rows = [(i, i % 3, "x" * (1 + i % 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "hi bigint, lo int, s string")
    exact = {r["column_name"]: r for r in profile(df, advanced=True).profile.collect()}
    approx = {r["column_name"]: r for r in
              profile(df, advanced=True, approx_distinct=0.02).profile.collect()}
    for c in ("hi", "lo", "s"):
        assert approx[c]["no_at_limit"] == exact[c]["no_at_limit"]
    assert exact["hi"]["no_at_limit"] == 2 and exact["lo"]["no_at_limit"] == 2000
    assert approx["lo"]["no_distinct"] == 3


def test_empty_frame_profile(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = {r["column_name"]: r for r in profile(df).profile.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["row_count"] == 0 and rows["a"]["percentage_nulls"] is None


def test_declared_text_lengths_from_catalog(spark):
    from tablewright.operators.profile import profile_table
    spark.sql("CREATE TABLE tw_decl (code CHAR(3), name VARCHAR(25), note STRING) USING parquet")
    spark.sql("INSERT INTO tw_decl VALUES ('ab', 'alpha', 'x'), ('cd', 'beta', NULL)")
    rows = {r["column_name"]: r for r in profile_table(spark, "tw_decl").profile.collect()}
    assert (rows["code"]["sql_type"], rows["code"]["column_data_length"]) == ("char", 3)
    assert (rows["name"]["sql_type"], rows["name"]["column_data_length"]) == ("varchar", 25)
    assert rows["note"]["column_data_length"] is None
    assert rows["code"]["max_data_length"] == 2          # CHAR padding is not counted
    spark.sql("DROP TABLE tw_decl")


def test_column_list_frame(spark, edge):
    cl = spark.createDataFrame([(" id ",), ("txt",), ("missing",)], "column_name string")
    res = profile(edge, columns=cl)
    assert sorted(r["column_name"] for r in res.profile.collect()) == ["id", "txt"]
    assert res.unknown_columns == ["missing"]


def test_non_finite_and_huge_values_take_no_part_unseen(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0), (1e40, nan, -inf), (None, 3.0, inf), (3.0, 3.0, nan)], "huge double, odd double, wild double")
    for approx in (None, 0.05):
        rows = {r["column_name"]: r for r in profile(df, approx_distinct=approx, distinct_min=0 if approx else 200).profile.collect()}
        assert rows["huge"]["avg_data_length"] == pytest.approx(1e40 / 3)
        assert rows["huge"]["max_data_length"] is None and float(rows["huge"]["max_raw"]) == 1e40
        assert (rows["odd"]["avg_data_length"], rows["odd"]["no_non_finite"]) == (pytest.approx(7 / 3), 1)
        assert rows["odd"]["max_data_length"] == 3
        assert (rows["wild"]["avg_data_length"], rows["wild"]["no_non_finite"], rows["wild"]["max_raw"]) == (1.0, 3, "1.0")
        assert rows["odd"]["distinct_estimated"] is (approx is not None)
    big = spark.createDataFrame([(Decimal("9" * 38),), (Decimal(1),)], "d decimal(38,0)")
    assert profile(big).profile.first()["avg_data_length"] == pytest.approx(5e37)


def test_own_predicates_guards_and_case_blind_lists(spark):
    df = spark.createDataFrame([("$1,234.50", "a"), ("x", "a ")], "Price string, t string")
    got = profile(df, columns="PRICE, price, nope", is_numeric=lambda c: f"coalesce({c} LIKE '$%', false)",
                  is_date=lambda c: "false")
    assert got.unknown_columns == ["nope"]
    assert [(r["column_name"], r["no_is_numeric"]) for r in got.profile.collect()] == [("Price", 1)]
    assert profile(df, columns=["t"], collation="UTF8_BINARY_RTRIM").profile.first()["no_distinct"] == 1
    assert profile(df, columns=["t"]).profile.first()["no_distinct"] == 2
    with pytest.raises(ValueError):
        profile(df.limit(0), require_rows=True)
    twice = spark.createDataFrame([("varchar", 10), ("varchar", 20), ("blob", 1)], "data_type string, threshold int")
    assert profile(df, sparse_thresholds=twice).profile.count() == 2
