import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tablewright.operators.reports import (
    extract_messages, gather_across, job_history_report, latest_per_key, open_runs,
    recent_queries,
)

D = dt.datetime


def test_job_history_report_edges(spark):
    jobs = spark.createDataFrame(
        [("j1", "load", "d1", 1, D(2023, 1, 1)), ("j2", "never_ok", "d2", 1, D(2023, 1, 2)),
         ("j3", "single", "d3", 2, D(2023, 1, 3)), ("j4", "no_category", "d4", 9, D(2023, 1, 4))],
        "job_id string, name string, description string, category_id int, date_created timestamp_ntz")
    cats = spark.createDataFrame([(1, "etl"), (2, "report")], "category_id int, name string")
    hist = spark.createDataFrame([
        ("j1", "h1", 0, 1, 130, 1, D(2024, 1, 1, 1)),     # 1m30s -> 2
        ("j1", "h2", 0, 1, 10129, 2, D(2024, 1, 2, 1)),   # -> 62
        ("j1", "h1", 0, 0, 29, 3, D(2024, 1, 2, 1)),      # same time, higher run id wins
        ("j1", "h1", 1, 1, 5959, 4, D(2024, 1, 3, 1)),    # step 1: ignored
        ("j2", "h1", 0, 0, 0, 5, D(2024, 1, 1)),
        ("j2", "h1", 0, 9, 235959, 6, D(2024, 1, 2)),
        ("j3", "h3", 0, 4, 30, 7, D(2024, 1, 5)),
        ("j4", "h4", 0, 1, 30, 8, D(2024, 1, 5)),
    ], "job_id string, server string, step_id int, run_status int, run_duration int, "
       "run_id bigint, run_ts timestamp_ntz")
    rows = {r["job_id"]: r for r in job_history_report(jobs, hist, cats).collect()}
    assert set(rows) == {"j1", "j2", "j3"}                 # j4's category is missing
    j1 = rows["j1"]
    assert (j1["total_number_of_runs"], j1["total_number_of_successful_runs"]) == (3, 2)
    assert j1["job_outcome"] == "Failed" and j1["run_duration_minutes"] == 1
    assert j1["average_duration_of_successful_runs_minutes"] == 32   # (2 + 62) / 2
    assert j1["success_ratio"] == Decimal("0.67")
    j2 = rows["j2"]
    assert j2["job_outcome"] == "Unknown" and j2["run_duration_minutes"] == 1440
    assert j2["average_duration_of_successful_runs_minutes"] == 0
    assert j2["success_ratio"] == Decimal("0.00")
    assert rows["j3"]["job_outcome"] == "In Progress" and rows["j3"]["total_number_of_runs"] == 1


def test_job_history_report_plan_has_no_window(spark):
    jobs = spark.createDataFrame([("j", "n", "d", 1, D(2023, 1, 1))],
                                 "job_id string, name string, description string, category_id int, date_created timestamp_ntz")
    cats = spark.createDataFrame([(1, "c")], "category_id int, name string")
    hist = spark.createDataFrame([("j", "h", 0, 1, 1, 1, D(2024, 1, 1))],
                                 "job_id string, server string, step_id int, run_status int, run_duration int, run_id bigint, run_ts timestamp_ntz")
    plan = job_history_report(jobs, hist, cats)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_latest_per_key_breaks_ties(spark):
    df = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 5, 2), (2, "c", 1, 3)],
                               "k int, v string, t int, id int")
    got = sorted((r["k"], r["v"]) for r in latest_per_key(df, "k", ["t", "id"]).collect())
    assert got == [(1, "b"), (2, "c")]


def test_recent_queries_day_bounds_and_order(spark):
    stats = spark.createDataFrame([
        ("h1", D(2018, 3, 29, 0, 0)), ("h2", D(2018, 3, 29, 23, 59, 59)),
        ("h3", D(2018, 3, 30, 0, 0)), ("h4", D(2018, 3, 29, 12))],
        "sql_handle string, last_execution_time timestamp_ntz")
    texts = spark.createDataFrame([("h1", "select 1"), ("h2", "select 2"), ("h3", "select 3"),
                                   ("h4", "select 1")], "sql_handle string, text string")
    got = [tuple(r) for r in recent_queries(stats, texts, "2018-03-29", "db").collect()]
    assert got == [("db", "select 2", "2018-03-29 23:59:59"), ("db", "select 1", "2018-03-29 12:00:00")]


def test_open_runs_only_latest_session(spark):
    jobs = spark.createDataFrame([("j1", "a"), ("j2", "b")], "job_id string, name string")
    sessions = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 2))],
                                     "session_id int, agent_start_date timestamp_ntz")
    act = spark.createDataFrame([
        (1, "j1", D(2024, 1, 1, 1), None),                   # open, but older session
        (2, "j2", D(2024, 1, 2, 0, 0, 0), None),             # open in the latest
        (2, "j1", D(2024, 1, 2, 1), D(2024, 1, 2, 2)),       # stopped
        (2, "j1", None, None)],                              # never requested
        "session_id int, job_id string, run_requested_date timestamp_ntz, stop_execution_date timestamp_ntz")
    got = [(r["job_id"], r["elapsed_seconds"]) for r in
           open_runs(jobs, act, sessions, "2024-01-02 00:01:00").collect()]
    assert got == [("j2", 60)]


def test_extract_messages_filters_types(spark):
    ops = spark.createDataFrame([(1, "pkg", "me", "srv")],
                                "operation_id bigint, object_name string, caller_name string, server_name string")
    msgs = spark.createDataFrame([(1, 120, D(2024, 1, 1), "err"), (1, 70, D(2024, 1, 1), "info"),
                                  (2, 130, D(2024, 1, 1), "orphan")],
                                 "operation_id bigint, message_type int, message_time timestamp_ntz, message string")
    got = [(r["package_name"], r["message"]) for r in extract_messages(ops, msgs).collect()]
    assert got == [("pkg", "err")]


def test_gather_across_adds_source(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2,)], "x int")
    got = sorted(tuple(r) for r in gather_across({"a": a, "b": b}).collect())
    assert got == [(1, "a"), (2, "b")]


def test_xml_report_round_trip(spark, tmpdir_path):
    import glob
    from tablewright.sources.xml_sink import read_xml_report, write_xml_report
    df = spark.createDataFrame([("db", "select 1", "2018-03-29 12:00:00")],
                               "db string, script string, run_date string")
    path = write_xml_report(df, tmpdir_path + "/x", single_document=True)
    files = [f for f in glob.glob(path + "/part-*")]
    assert len(files) == 1
    text = open(files[0]).read()
    assert "<Queries>" in text and "<Query>" in text and "<script>select 1</script>" in text
    assert [tuple(r) for r in read_xml_report(spark, path, df.schema).collect()] == [
        ("db", "select 1", "2018-03-29 12:00:00")]


def test_open_runs_for_one_job_and_messages_of_one_operation(spark):
    jobs = spark.createDataFrame([("j1", "a"), ("j2", "b")], "job_id string, name string")
    sessions = spark.createDataFrame([(1, D(2024, 1, 1))], "session_id int, agent_start_date timestamp_ntz")
    act = spark.createDataFrame([(1, "j1", D(2024, 1, 1), None), (1, "j2", D(2024, 1, 1), None)],
                                "session_id int, job_id string, run_requested_date timestamp_ntz, stop_execution_date timestamp_ntz")
    got = [r["job_id"] for r in open_runs(jobs, act, sessions, "2024-01-01 00:00:05", job_name="b").collect()]
    assert got == ["j2"]
    ops = spark.createDataFrame([(1, "p1", "c", "s"), (2, "p2", "c", "s")],
                                "operation_id bigint, object_name string, caller_name string, server_name string")
    msgs = spark.createDataFrame([(1, 120, D(2024, 1, 1), "e1"), (2, 130, D(2024, 1, 1), "e2")],
                                 "operation_id bigint, message_type int, message_time timestamp_ntz, message string")
    assert [r["message"] for r in extract_messages(ops, msgs, operation_id=2).collect()] == ["e2"]
