"""Physical-plan checks: pushdown, pruning, no Expand in the profile aggregate, broadcast
of one-row sides, no windows in per-key reports."""

import datetime as dt

from pyspark.sql import functions as F

from tablewright.operators.profile import column_stats
from tablewright.operators.columns import select_profile_columns
from tablewright.operators.reports import open_runs, recent_queries
from tablewright.plans.profiling import q_profile_numeric

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_numeric_reads_only_numeric_columns(spark):
    plan = plan_of(q_profile_numeric(spark, SF))
    assert "l_returnflag" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "Expand" not in plan


def test_column_stats_single_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    cols, _ = select_profile_columns(df.schema)
    plan = plan_of(column_stats(df, cols))
    assert plan.count("FileScan parquet") == 1
    assert "Expand" not in plan


def test_recent_queries_day_filter_pushed(spark, tmpdir_path):
    p = tmpdir_path + "/stats"
    spark.createDataFrame([("h", dt.datetime(2018, 3, 29, 1))],
                          "sql_handle string, last_execution_time timestamp_ntz").write.parquet(p)
    texts = spark.createDataFrame([("h", "q")], "sql_handle string, text string")
    plan = plan_of(recent_queries(spark.read.parquet(p), texts, "2018-03-29", "db"))
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(last_execution_time" in pushed and "LessTh" in pushed


def test_open_runs_latest_session_is_broadcast(spark):
    jobs = spark.createDataFrame([("j", "a")], "job_id string, name string")
    sessions = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "session_id int, agent_start_date timestamp_ntz")
    act = spark.createDataFrame([(1, "j", dt.datetime(2024, 1, 1), None)],
                                "session_id int, job_id string, run_requested_date timestamp_ntz, stop_execution_date timestamp_ntz")
    plan = open_runs(jobs, act, sessions, "2024-01-02 00:00:00")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def one_scan(plan, kind="FileScan"):
    """One scan, one shuffle of words and values, hash aggregates alone."""
    return (plan.count(kind) == 1 and plan.count("Exchange hashpartitioning(_ci#") == 2
            and plan.count(", _w#") >= 1 and "SortAggregate" not in plan
            and "Window" not in plan and "Python" not in plan and "Union" not in plan)


def test_profile_is_one_scan_and_one_value_shuffle(spark, tmpdir_path):
    from tablewright.operators.profile import profile
    from tablewright.plans.profiling import NULLS_COLS, _nulls_input
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert one_scan(plan_of(profile(li).profile))
    li.limit(50).write.csv(tmpdir_path + "/csv", header=True)
    csv = spark.read.schema(li.schema).csv(tmpdir_path + "/csv", header=True)
    assert one_scan(plan_of(profile(csv).profile), "FileScan csv")
    dec = li.select(*[F.col("l_quantity").cast(f"decimal({p},2)").alias(f"d{p}") for p in range(10, 18)])
    assert one_scan(plan_of(profile(dec).profile))
    nulls = plan_of(profile(_nulls_input(spark, SF), columns=[c for c, _, _ in NULLS_COLS]).profile)
    assert nulls.count("FileScan") == 2 and nulls.count("Exchange hashpartitioning(_ci#") == 2


def test_orphans_read_the_child_once(spark):
    from tablewright.operators.checks import check_referential_integrity
    o, li = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    assert plan_of(check_referential_integrity(li, o, "l_orderkey", "o_orderkey")).count("FileScan parquet") == 2


def test_ids_over_many_partitions(spark):
    from tablewright.operators.reconcile import assign_sequential_ids
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").repartition(500)
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = assign_sequential_ids(df, "k", "n", start=10)
        plan = plan_of(out)
        rows = sorted((r["n"], r["k"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "map(" not in plan and "keys: [" not in plan
    assert [n for n, _ in rows] == list(range(10, 5010))
    assert [k for _, k in rows] == sorted(k for _, k in rows)


def test_job_history_step_filter_pushed(spark, tmpdir_path):
    from tablewright.operators.reports import job_history_report
    p = tmpdir_path + "/hist"
    spark.createDataFrame([("j", "h", 0, 1, 130, 1, dt.datetime(2024, 1, 1))],
                          "job_id string, server string, step_id int, run_status int, "
                          "run_duration int, run_id bigint, run_ts timestamp_ntz").write.parquet(p)
    jobs = spark.createDataFrame([("j", "n", "d", 1, dt.datetime(2023, 1, 1))],
                                 "job_id string, name string, description string, category_id int, date_created timestamp_ntz")
    cats = spark.createDataFrame([(1, "c")], "category_id int, name string")
    plan = plan_of(job_history_report(jobs, spark.read.parquet(p), cats))
    assert "EqualTo(step_id,0)" in plan
    assert "Window" not in plan


def test_per_key_reports_aggregate_before_the_shuffle(spark):
    from tablewright.operators.reports import latest_per_key
    from tablewright.plans.reports import q_job_history_report
    plan = plan_of(q_job_history_report(spark, SF))
    assert "partial_max_by" in plan and "partial_count" in plan
    ev = spark.read.parquet(f"{SF}/events.parquet")
    plan2 = plan_of(latest_per_key(ev, "user_id", ["ts", "event_id"]))
    assert "partial_max_by" in plan2 and "Window" not in plan2
