"""Run-log reports (R-01 … R-06, W-06, A-11).

Per-key results are computed with grouped aggregates only (``count``, ``sum``, ``avg``,
``max_by`` over a struct ordering), never with windows partitioned by the key: partial
aggregation runs map-side, so a key that holds a third of all rows costs one buffer per
task instead of one giant task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import decode_status, hhmmss_minutes, int_div, second_boundaries


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (a column list; later columns
    break ties), as ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order DESC) = 1."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def success_ratio(successes, total) -> Column:
    """ROUND(successes / total, 2) as an exact decimal(5,2) (half up)."""
    s, t = F.col(successes) if isinstance(successes, str) else successes, \
        F.col(total) if isinstance(total, str) else total
    q = F.when(t > 0, int_div(s * 200 + t, t * 2))
    return (q.cast("decimal(38,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(5,2)")


def job_history_report(jobs: DataFrame, history: DataFrame, categories: DataFrame,
                       step_id: int = 0) -> DataFrame:
    """R-01: per job, its latest run (outcome, server, duration) with run totals, success
    count, mean duration of successful runs (whole minutes) and success ratio.

    jobs(job_id, name, description, category_id, date_created);
    history(job_id, server, step_id, run_status, run_duration HHMMSS, run_id, run_ts);
    categories(category_id, name).
    """
    h = (history.where(F.col("step_id") == step_id)
                .withColumn("_minutes", hhmmss_minutes("run_duration"))
                .withColumn("_ok", (F.col("run_status") == 1).cast("int")))
    last = F.max_by(F.struct("server", "run_status", "_minutes", "run_ts", "run_id"),
                    F.struct("run_ts", "run_id"))
    per_job = h.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_number_of_runs"),
        F.sum("_ok").cast("bigint").alias("total_number_of_successful_runs"),
        F.avg(F.when(F.col("_ok") == 1, F.col("_minutes"))).alias("_avg_ok"),
        last.alias("_last"))
    j = jobs.select("job_id", F.col("name").alias("job_name"),
                    F.col("description").alias("job_description"), "category_id",
                    "date_created")
    c = categories.select("category_id", F.col("name").alias("job_category"))
    out = per_job.join(j, "job_id").join(c, "category_id")
    return out.select(
        "job_id", "job_name", "job_category", "job_description",
        F.col("_last.server").alias("server_name"), "date_created",
        F.col("_last.run_ts").alias("most_recent_run"),
        decode_status(F.col("_last.run_status")).alias("job_outcome"),
        "total_number_of_runs", "total_number_of_successful_runs",
        F.col("_last._minutes").alias("run_duration_minutes"),
        F.coalesce(F.col("_avg_ok").cast("int"), F.lit(0))
         .alias("average_duration_of_successful_runs_minutes"),
        success_ratio("total_number_of_successful_runs", "total_number_of_runs")
        .alias("success_ratio"))


def recent_queries(stats: DataFrame, texts: DataFrame, day: str, db: str) -> DataFrame:
    """R-02: statements run on ``day``, one row per text with its latest run, newest first.

    stats(sql_handle, last_execution_time); texts(sql_handle, text). The day test is a
    half-open range on the timestamp so that it reaches the scan as a pushed filter.
    """
    start = F.lit(day).cast("timestamp_ntz")
    end = F.lit(day).cast("date") + F.expr("INTERVAL 1 DAY")
    s = stats.where((F.col("last_execution_time") >= start)
                    & (F.col("last_execution_time") < end.cast("timestamp_ntz")))
    # Pre-aggregate per handle before the join: a statement run a million times that day
    # is one row per task, then one row, before it meets its text.
    per_handle = s.groupBy("sql_handle").agg(F.max("last_execution_time").alias("_last"))
    runs = per_handle.join(texts, "sql_handle")
    latest = runs.groupBy("text").agg(F.max("_last").alias("_last"))
    return (latest.orderBy(F.desc("_last"))
                  .select(F.lit(db).alias("db"), F.col("text").alias("script"),
                          F.date_format("_last", "yyyy-MM-dd HH:mm:ss").alias("run_date")))


def open_runs(jobs: DataFrame, activity: DataFrame, sessions: DataFrame, as_of,
              job_name: str | None = None) -> DataFrame:
    """R-04: runs of the latest agent session that were requested and have not stopped,
    with the whole seconds elapsed until ``as_of`` (optionally for one job by name: "is
    this job running now?").

    The latest session is found by a one-row aggregate joined on equality (never a
    cross join); that one-row side is broadcast, a proven size bound.
    """
    newest = sessions.agg(F.max("agent_start_date").alias("agent_start_date"))
    latest = sessions.join(F.broadcast(newest), "agent_start_date").select("session_id")
    act = (activity.where(F.col("run_requested_date").isNotNull()
                          & F.col("stop_execution_date").isNull())
                   .join(latest, "session_id", "left_semi"))
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else F.lit(as_of)
    named = jobs.select("job_id", F.col("name").alias("job_name"))
    if job_name is not None:
        named = named.where(F.col("job_name") == job_name)
    return (act.join(named, "job_id")
               .select("job_id", "job_name", "session_id", "run_requested_date",
                       second_boundaries("run_requested_date", as_of_col)
                       .alias("elapsed_seconds")))


def extract_messages(operations: DataFrame, messages: DataFrame, types=(120, 130),
                     operation_id=None) -> DataFrame:
    """R-05: messages of the given types with their operation's package, caller, server
    (optionally of one operation, e.g. one validation run)."""
    m = messages.where(F.col("message_type").isin(list(types)))
    if operation_id is not None:
        m = m.where(F.col("operation_id") == operation_id)
    o = operations.select("operation_id", F.col("object_name").alias("package_name"),
                          "caller_name", "server_name")
    return m.join(o, "operation_id").select(
        "operation_id", "package_name", "message_type", "message_time", "message",
        "caller_name", "server_name")


def gather_across(sources: dict, source_col: str = "source", fill_missing: bool = False) -> DataFrame:
    """M-03/R-06: the same report from several sources as one frame with a source column.
    Sources whose columns differ are refused, unless ``fill_missing`` asks for NULLs."""
    frames = [df.withColumn(source_col, F.lit(name)) for name, df in sources.items()]
    shapes = {frozenset(df.columns) for df in frames}
    if len(shapes) > 1 and not fill_missing:
        differ = sorted(frozenset.union(*shapes) - frozenset.intersection(*shapes))
        raise ValueError(f"The sources do not all have the columns {', '.join(differ)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames)


PERMISSION_COLUMNS = ["owner", "object", "grantee", "grantor", "protect_type", "action", "column"]


def permission_report(per_database: dict) -> DataFrame:
    """R-06: the permission listing of every database as one frame with a ``database``
    column (each input has the seven permission columns)."""
    frames = {db: df.select(*PERMISSION_COLUMNS) for db, df in per_database.items()}
    return gather_across(frames, source_col="database")


def entitlement_matrix(principals: DataFrame, databases: DataFrame, *, role: str = "db_datareader",
                       principal_type: str = "U", include: str = "%", exclude=(), exclude_names=(),
                       exclude_databases=("master", "model", "msdb", "tempdb", "distribution"),
                       max_databases: int = 10_000) -> DataFrame:
    """J-08/M-07: (user_name, database_name, role_name) for every principal of the wanted type
    whose name is LIKE ``include`` and none of ``exclude`` (LIKE patterns) or
    ``exclude_names``, and every database that is not excluded.

    principals(name, type), databases(name). No join: the databases left after the filter are
    the short side; their names are counted first and refused beyond ``max_databases``, then
    each principal's row is exploded by them. So the work is spread as the principals are,
    and no row is made that a filter would drop.
    """
    left = databases.where(~F.col("name").isin(list(exclude_databases))).select("name").distinct()
    names = sorted(r["name"] for r in left.limit(max_databases + 1).collect())
    if len(names) > max_databases:
        raise ValueError(f"More than {max_databases} databases: name those to leave out")
    keep = (F.col("type") == principal_type) & F.col("name").like(include) & ~F.col("name").isin(list(exclude_names))
    for pattern in [exclude] if isinstance(exclude, str) else exclude:
        keep = keep & ~F.col("name").like(pattern)
    return principals.where(keep).select(
        F.col("name").alias("user_name"),
        F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("database_name"),
        F.lit(role).alias("role_name")).orderBy("user_name", "database_name")


def status_counts(history: DataFrame, status_col: str = "run_status") -> DataFrame:
    """P-09 applied: runs per status code with the decoded label."""
    return (history.groupBy(status_col)
                   .agg(F.count(F.lit(1)).alias("runs"))
                   .withColumn("outcome", decode_status(status_col)))
