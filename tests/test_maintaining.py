"""Versions of many tables, footers, profile states, early end of a load, entitlements."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators.profile import profile
from tablewright.operators.reports import entitlement_matrix
from tablewright.operators.state import merge_states, profile_from_state, profile_state
from tablewright.sources import csv_loader
from tablewright.sources.csv_loader import ErrorBudgetExceeded, load_csv
from tablewright.sources.footers import footer_stats
from tablewright.sources.versions import MirrorFailed, current_version, mirror_version, version_reader


def _tables(spark, n):
    return lambda name: spark.range(n).select(F.lit(name).alias("t"), "id")


def test_versions_are_replaced_together(spark, tmpdir_path):
    target = f"{tmpdir_path}/m"
    with pytest.raises(ValueError):
        version_reader(spark, target)
    mirror_version(spark, _tables(spark, 3), ["a", "b"], target)
    first, opened = current_version(spark, target), version_reader(spark, target)

    def broken(name):            # one writer dies while it writes
        df = _tables(spark, 7)(name)
        return df.withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("disk full"))).otherwise(F.col("id"))) if name == "b" else df

    with pytest.raises(MirrorFailed, match="b: "):
        mirror_version(spark, broken, ["a", "b"], target)
    assert current_version(spark, target) == first
    assert [version_reader(spark, target)(n).count() for n in "ab"] == [3, 3]
    mirror_version(spark, _tables(spark, 7), ["a", "b"], target)
    assert [version_reader(spark, target)(n).count() for n in "ab"] == [7, 7]
    assert [opened(n).count() for n in "ab"] == [3, 3]              # still readable
    mirror_version(spark, _tables(spark, 9), ["a"], target)
    kept = sorted(x for x in os.listdir(target) if x.startswith("v-"))
    assert len(kept) == 2 and first not in kept and current_version(spark, target) == kept[-1]
    assert not [x for x in os.listdir(target) if x.startswith("_current-")]


def test_first_copy_that_fails_leaves_nothing(spark, tmpdir_path):
    def missing(name):
        raise FileNotFoundError(name)

    with pytest.raises(MirrorFailed):
        mirror_version(spark, missing, ["a"], f"{tmpdir_path}/m")
    assert current_version(spark, f"{tmpdir_path}/m") is None


def test_footers_read_no_column(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, cast(id as int) - 50) as n", "cast(id as string) as s",
                                 "date_add(DATE'2024-01-01', cast(id as int)) as d", "id / 3.0d as x", "array(id) as a",
                                 "id % 2 = 0 as b").repartition(3).write.parquet(path)
    got = footer_stats(spark, path)
    assert "PushedAggregation: [COUNT(*)" in got._jdf.queryExecution().toString()
    rows = {r.column_name: tuple(r)[1:] for r in got.collect()}
    assert rows == {"id": (1000, 0, "0", "999"), "n": (1000, 100, "-49", "949"), "s": (1000, 0, None, None),
                    "d": (1000, 0, "2024-01-01", "2026-09-26"), "x": (1000, 0, None, None), "b": (1000, 0, "false", "true")}
    assert [r.column_name for r in footer_stats(spark, path, ["n"]).collect()] == ["n"]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_merged_states_are_the_state_of_all(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", " a", "12", "2024-01-02", f"v{i % 700}"]), rng.choice([None, 1.5, 2.25, float("nan"), i / 7]),
             bytes([i % 5]) if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, s string, x double, b binary").withColumn(
        "ts", F.timestamp_seconds(F.col("id") * 1800)).withColumn("dc", (F.col("id") / 10).cast("decimal(10,1)"))
    whole = profile_from_state(profile_state(df)).collect()
    parts = [profile_state(df.where(F.col("id") % 3 == k)) for k in range(3)] + [profile_state(df.limit(0))]
    merged = profile_from_state(merge_states(merge_states(*parts[:2]), *parts[2:])).collect()
    exact = lambda r: repr({k: v for k, v in r.asDict().items() if k != "no_distinct" and not k.endswith("comments")})
    assert sorted(map(exact, whole)) == sorted(map(exact, merged))
    direct = {r.column_name: r for r in profile(df).profile.collect()}
    for r in merged:
        d = direct[r.column_name]
        for name in ("row_count", "no_nulls", "no_zero_length", "no_is_numeric", "no_is_date", "min_data_length", "max_data_length",
                     "avg_data_length", "min_date", "max_date", "no_date_with_second", "no_date_with_hour_minute_second",
                     "no_non_finite", "data_type"):
            assert r[name] == d[name] or (name == "avg_data_length" and abs(r[name] - d[name]) < 1e-9), (r.column_name, name)
        assert abs(r.no_distinct - d.no_distinct) <= max(1, 0.03 * d.no_distinct) and r.distinct_estimated


def test_state_of_columns_that_differ(spark):
    a, b = spark.range(5).withColumn("only", F.lit(1)), spark.range(7)
    rows = {r.column_name: r for r in merge_states(profile_state(a), profile_state(b)).collect()}
    assert rows["id"].row_count == 12 and rows["only"].row_count == 5
    with pytest.raises(ValueError):
        profile_state(a, columns="nothing")


def test_load_ends_at_the_budget(spark, tmpdir_path, monkeypatch):
    """A file of bad lines only: tasks leave off, the staging is cancelled, nothing reaches
    the target, the lines seen are kept."""
    path = f"{tmpdir_path}/in"
    spark.range(0, 400_000, 1, 1).selectExpr("concat(id, ',short') as value").write.text(path)
    target = csv_loader.T.StructType([csv_loader.T.StructField(c, csv_loader.T.StringType()) for c in "abc"])
    ends = []
    plain = csv_loader._watch_rejects
    monkeypatch.setattr(csv_loader, "_watch_rejects", lambda *a: ends.append(plain(*a)) or ends[-1])
    with pytest.raises(ErrorBudgetExceeded, match="ended early"):
        load_csv(spark, path, f"{tmpdir_path}/t", target, header=False, max_errors=25, error_path=f"{tmpdir_path}/err")
    assert not os.path.exists(f"{tmpdir_path}/t")
    lines = spark.read.text(f"{tmpdir_path}/err/rejects")
    assert 25 < lines.count() < 1000 and len(ends[0]) == lines.count()


def test_counts_of_a_task_that_runs_again():
    acc = csv_loader._PerTask()
    assert acc.addInPlace({0: ["a"], 1: []}, {0: ["a"], 2: ["b", "c"]}) == {0: ["a"], 1: [], 2: ["b", "c"]}


def test_entitlements(spark):
    users = spark.createDataFrame([(r"D\ann", "U"), (r"D\bob", "U"), (r"D\svc.x", "U"), (r"D\grp", "G"), ("E\\eve", "U")], "name string, type string")
    dbs = spark.createDataFrame([("sales",), ("hr",), ("master",), ("hr",)], "name string")
    got = entitlement_matrix(users, dbs, include=r"D\\%", exclude=r"D\\svc.%", exclude_names=[r"D\bob"])
    assert [tuple(r) for r in got.collect()] == [(r"D\ann", "hr", "db_datareader"), (r"D\ann", "sales", "db_datareader")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        entitlement_matrix(users, dbs, max_databases=1)
    assert entitlement_matrix(users, dbs.limit(0)).count() == 0
