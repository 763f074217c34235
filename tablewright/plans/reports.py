"""Report queries on the driver tables (events stand in for run logs and statement stats,
customer for jobs, nation for categories, conversations for operation messages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.tsql import int_div
from tablewright.operators.reports import (
    extract_messages, gather_across, job_history_report, latest_per_key, open_runs,
    recent_queries, status_counts,
)
from tablewright.plans import table
from tablewright.session import scratch_dir
from tablewright.sources.xml_sink import read_xml_report, write_xml_report

REPORT_DAY, REPORT_DB = "2024-01-15", "sales"
AS_OF = "2024-02-01 00:00:00"


def history(spark, d):
    e = table(spark, d, "events")
    secs = F.floor(F.col("value") * 60).cast("bigint")
    hhmmss = int_div(secs, F.lit(3600)) * 10000 + (int_div(secs, F.lit(60)) % 60) * 100 + secs % 60
    status = (F.when(F.col("event_type") == "error", 0)
               .when(F.col("event_type").isin("purchase", "signup"), 1)
               .when(F.col("event_type") == "click", 2)
               .when(F.col("event_id") % 2 == 0, 3).otherwise(9))
    return e.select(F.col("user_id").cast("string").alias("job_id"),
                    F.concat(F.lit("host"), (F.col("event_id") % 4).cast("string")).alias("server"),
                    (F.col("event_id") % 3).cast("int").alias("step_id"),
                    status.cast("int").alias("run_status"),
                    hhmmss.cast("int").alias("run_duration"),
                    F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"))


def jobs(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("job_id"),
                    F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
                    F.col("c_nationkey").alias("category_id"),
                    F.make_timestamp_ntz(F.lit(2023), 1 + F.col("c_custkey") % 12,
                                         1 + F.col("c_custkey") % 28, F.lit(0), F.lit(0), F.lit(0))
                    .alias("date_created"))


def categories(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("category_id"),
                                            F.col("n_name").alias("name"))


def q_job_history_report(spark, d):
    return job_history_report(jobs(spark, d), history(spark, d), categories(spark, d))


def q_decode_status(spark, d):
    return status_counts(history(spark, d))


def _stats_texts(spark, d):
    e = table(spark, d, "events")
    stats = e.select(F.col("event_id").cast("string").alias("sql_handle"),
                     F.col("ts").alias("last_execution_time"))
    texts = e.select(F.col("event_id").cast("string").alias("sql_handle"),
                     F.col("props").alias("text"))
    return stats, texts


def q_recent_queries(spark, d):
    stats, texts = _stats_texts(spark, d)
    return recent_queries(stats, texts, REPORT_DAY, REPORT_DB)


def q_write_xml_report(spark, d):
    df = q_recent_queries(spark, d)
    path = write_xml_report(df, scratch_dir(spark) + "/recent_queries_xml")
    return read_xml_report(spark, path, df.schema)


def q_latest_per_key(spark, d):
    return latest_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"])


def q_open_runs(spark, d):
    e = table(spark, d, "events")
    sessions = (e.groupBy(F.dayofyear("ts").alias("session_id"))
                 .agg(F.min("ts").alias("agent_start_date")))
    activity = e.select(F.dayofyear("ts").alias("session_id"),
                        F.col("user_id").cast("string").alias("job_id"),
                        F.col("ts").alias("run_requested_date"),
                        F.when(F.col("event_type") != "error", F.col("ts"))
                         .alias("stop_execution_date"))
    return open_runs(jobs(spark, d), activity, sessions, AS_OF)


def q_extract_messages(spark, d):
    c = table(spark, d, "conversations")
    msgs = c.select(F.col("conv_id").alias("operation_id"),
                    F.when(F.col("role") == "user", 120).when(F.col("role") == "assistant", 130)
                     .otherwise(110).alias("message_type"),
                    F.timestamp_add("MINUTE", F.col("turn"),
                                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                     .alias("message_time"),
                    F.col("text").alias("message"))
    ops = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("operation_id"),
        F.concat(F.lit("package-"), F.col("conv_id").cast("string")).alias("object_name"),
        F.concat(F.lit("caller-"), (F.col("conv_id") % 7).cast("string")).alias("caller_name"),
        F.concat(F.lit("server-"), (F.col("conv_id") % 3).cast("string")).alias("server_name"))
    return extract_messages(ops, msgs)


def q_gather_across(spark, d):
    cust = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_key"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("balance"))
    supp = table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_key"),
        F.col("s_acctbal").cast("decimal(15,2)").alias("balance"))
    return gather_across({"customer": cust, "supplier": supp})


HISTORY_SQL = """(SELECT CAST(user_id AS VARCHAR) AS job_id,
    'host' || CAST(event_id % 4 AS VARCHAR) AS server, CAST(event_id % 3 AS INTEGER) AS step_id,
    CAST(CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('purchase','signup') THEN 1
         WHEN event_type = 'click' THEN 2 WHEN event_id % 2 = 0 THEN 3 ELSE 9 END AS INTEGER)
      AS run_status,
    CAST((s // 3600) * 10000 + ((s // 60) % 60) * 100 + s % 60 AS INTEGER) AS run_duration,
    event_id AS run_id, ts AS run_ts
  FROM (SELECT *, CAST(floor(value * 60) AS BIGINT) AS s FROM events) e)"""
JOBS_SQL = """(SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS name,
    c_mktsegment AS description, c_nationkey AS category_id,
    make_timestamp(2023, CAST(1 + c_custkey % 12 AS BIGINT), CAST(1 + c_custkey % 28 AS BIGINT),
                   0, 0, 0) AS date_created FROM customer)"""
STATUS_CASE = """CASE {c} WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry'
    WHEN 3 THEN 'Canceled' WHEN 4 THEN 'In Progress' ELSE 'Unknown' END"""

RECENT_SQL = f"""SELECT '{REPORT_DB}' AS db, props AS script,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_date
FROM events WHERE CAST(ts AS DATE) = DATE '{REPORT_DAY}' GROUP BY props"""

ORACLE = {
    "job_history_report": f"""WITH b AS (
  SELECT *, CAST((run_duration // 10000 * 3600 + (run_duration // 100) % 100 * 60
                  + run_duration % 100 + 31) // 60 AS INTEGER) AS minutes
  FROM {HISTORY_SQL} h WHERE step_id = 0),
agg AS (SELECT job_id, COUNT(*) AS n, SUM(CASE WHEN run_status = 1 THEN 1 ELSE 0 END) AS s,
          AVG(CASE WHEN run_status = 1 THEN minutes END) AS a FROM b GROUP BY job_id),
last AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY job_id
           ORDER BY run_ts DESC, run_id DESC) AS rn FROM b) x WHERE rn = 1)
SELECT l.job_id, j.name AS job_name, n.n_name AS job_category, j.description AS job_description,
  l.server AS server_name, j.date_created, l.run_ts AS most_recent_run,
  {STATUS_CASE.format(c='l.run_status')} AS job_outcome,
  a.n AS total_number_of_runs, CAST(a.s AS BIGINT) AS total_number_of_successful_runs,
  l.minutes AS run_duration_minutes,
  COALESCE(CAST(trunc(a.a) AS INTEGER), 0) AS average_duration_of_successful_runs_minutes,
  CAST(CAST((a.s * 200 + a.n) // (2 * a.n) AS DECIMAL(38,0)) * 0.01 AS DECIMAL(5,2))
    AS success_ratio
FROM last l JOIN agg a ON l.job_id = a.job_id JOIN {JOBS_SQL} j ON j.job_id = l.job_id
JOIN nation n ON n.n_nationkey = j.category_id""",
    "decode_status": f"""SELECT run_status, COUNT(*) AS runs, {STATUS_CASE.format(c='run_status')}
  AS outcome FROM {HISTORY_SQL} h GROUP BY run_status""",
    "recent_queries": RECENT_SQL,
    "write_xml_report": RECENT_SQL,
    "latest_per_key": """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) x WHERE rn = 1""",
    "open_runs": f"""WITH s AS (SELECT CAST(dayofyear(ts) AS INTEGER) AS session_id,
    min(ts) AS agent_start_date FROM events GROUP BY 1),
latest AS (SELECT session_id FROM s WHERE agent_start_date = (SELECT max(agent_start_date) FROM s))
SELECT CAST(e.user_id AS VARCHAR) AS job_id, c.c_name AS job_name,
  CAST(dayofyear(e.ts) AS INTEGER) AS session_id, e.ts AS run_requested_date,
  date_diff('second', e.ts, TIMESTAMP '{AS_OF}') AS elapsed_seconds
FROM events e JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type = 'error' AND CAST(dayofyear(e.ts) AS INTEGER) IN (SELECT session_id FROM latest)""",
    "extract_messages": """SELECT conv_id AS operation_id, 'package-' || CAST(conv_id AS VARCHAR)
  AS package_name, CASE role WHEN 'user' THEN 120 WHEN 'assistant' THEN 130 ELSE 110 END
  AS message_type, TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 MINUTE AS message_time,
  text AS message, 'caller-' || CAST(conv_id % 7 AS VARCHAR) AS caller_name,
  'server-' || CAST(conv_id % 3 AS VARCHAR) AS server_name
FROM conversations WHERE role IN ('user', 'assistant')""",
    "gather_across": """SELECT c_name AS name, c_nationkey AS nation_key,
  CAST(c_acctbal AS DECIMAL(15,2)) AS balance, 'customer' AS source FROM customer
UNION ALL SELECT s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(15,2)), 'supplier' FROM supplier""",
}

QUERIES = {
    "job_history_report": q_job_history_report,
    "decode_status": q_decode_status,
    "recent_queries": q_recent_queries,
    "write_xml_report": q_write_xml_report,
    "latest_per_key": q_latest_per_key,
    "open_runs": q_open_runs,
    "extract_messages": q_extract_messages,
    "gather_across": q_gather_across,
}
