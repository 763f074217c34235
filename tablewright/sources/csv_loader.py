"""Staged CSV loading (S-03 … S-08, L-01 … L-12).

Steps, each a Spark job over file splits (nothing passes through the driver):

1. ``read_csv_staged``: every field read as text into the target's column order; a line
   with too few or too many fields (or, with CSV quoting off, a quoted comma) is a reject
   and keeps its raw text.
2. ``stage``: the parsed lines are written once to a staging folder under the cluster's
   checkpoint location (cuts lineage; a lost executor re-runs only its own tasks), while
   ``observe`` counts rows and rejects in the same job.
3. The error budget is checked before anything reaches the target; rejects go to an
   error folder. With a budget a second job reads the malformed lines alone while the first
   one stages; its tasks add to an accumulator, and both jobs are cancelled as soon as it is
   past the budget, so a faulty file is not read to its end.
4. ``strip_quotes``, then ``cast_to_target``: checked casts (``try_cast``); a value that
   is present but does not convert is a cast error. A lenient load diverts such rows, with
   their source text and the failing columns, to the error folder.
5. ``move_to_target``: ONE append job; its output committer makes it all-or-nothing.
6. The staging folder is removed; the error folder stays.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid

from pyspark import AccumulatorParam, InheritableThread, TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import quote_ident
from tablewright.session import remove_scratch, scratch_dir

BAD = "_bad_record"
log = logging.getLogger("tablewright.loader")
QUOTED_SPLIT = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


class ErrorBudgetExceeded(RuntimeError):
    pass


class CastErrors(RuntimeError):
    pass


def staging_schema(target: T.StructType) -> T.StructType:
    """L-01: the target's columns in the same order, all text."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in target.fields])


def parse_csv(spark: SparkSession, path, target: T.StructType, *, header: bool = True,
              sep: str = ",", quoting: str = "csv", line_sep: str | None = "\n") -> DataFrame:
    """S-03: the files parsed into the target's columns as text plus ``_bad_record`` (the
    raw line of a line that does not have exactly one field per column). Blank lines are
    skipped; an empty field reads as NULL."""
    schema = T.StructType(staging_schema(target).fields + [T.StructField(BAD, T.StringType())])
    reader = (spark.read.schema(schema).option("header", header).option("sep", sep)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
              .option("quote", '"' if quoting == "csv" else ""))
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.csv(path)


def split_rejects(parsed: DataFrame, target: T.StructType, *, sep: str = ",",
                  quoting: str = "csv"):
    """(good, rejects) of a parsed frame; rejects carry ``raw_line`` and ``reason``."""
    names = [f.name for f in target.fields]
    # Keeps every column in the scan whatever the caller projects (even a bare count()):
    # the CSV reader checks a line's field count only over the columns it reads, and it
    # refuses a plan that reads the corrupt-record column alone. Always true.
    all_read = F.length(F.concat_ws(sep, *[F.col(quote_ident(c)) for c in names], F.col(BAD))) >= 0
    good = (parsed.where(F.col(BAD).isNull() & all_read)
                  .select(*[F.col(quote_ident(c)) for c in names]))
    pattern = _re_escape(sep) + (QUOTED_SPLIT[1:] if quoting == "csv" else "")
    fields = F.size(F.split(F.col(BAD), pattern))
    n = len(names)
    reason = (F.when(fields < n, "too few fields").when(fields > n, "too many fields")
               .otherwise("malformed"))
    rejects = (parsed.where(F.col(BAD).isNotNull() & all_read)
                     .select(F.col(BAD).alias("raw_line"), reason.alias("reason")))
    return good, rejects


def read_csv_staged(spark: SparkSession, path, target: T.StructType, *, header: bool = True,
                    sep: str = ",", quoting: str = "csv", line_sep: str | None = "\n"):
    """L-02/L-03: (good, rejects) — ``good`` has the target's columns as text in target
    order; ``rejects`` has ``raw_line`` and ``reason``."""
    parsed = parse_csv(spark, path, target, header=header, sep=sep, quoting=quoting,
                       line_sep=line_sep)
    return split_rejects(parsed, target, sep=sep, quoting=quoting)


def _re_escape(sep: str) -> str:
    import re
    return re.escape(sep)


def strip_quotes(df: DataFrame, quote: str = '"') -> DataFrame:
    """L-04: remove every quote character from every text column (one projection)."""
    return df.select(*[F.replace(F.col(quote_ident(f.name)), F.lit(quote), F.lit("")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(quote_ident(f.name))
                       for f in df.schema.fields])


def cast_to_target(df: DataFrame, target: T.StructType, keep_source: bool = False):
    """L-06: (good, bad). Each column is cast with ``try_cast``; a row is bad when some
    column holds a value that does not convert (``cast_errors`` lists them in order)."""
    typed, errs = [], []
    for f in target.fields:
        src = F.col(quote_ident(f.name))
        val = src.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else src
        typed.append(val.alias(f.name))
        errs.append(F.when(src.isNotNull() & val.isNull(), F.lit(f.name)))
    extra = [F.col(quote_ident(f.name)).alias(f"_src_{f.name}") for f in target.fields] if keep_source else []
    marked = df.select(*typed, *extra, F.array_compact(F.array(*errs)).alias("cast_errors"))
    good = marked.where(F.size("cast_errors") == 0).select(*[f.name for f in target.fields])
    bad = marked.where(F.size("cast_errors") > 0)
    return good, bad


def move_to_target(df: DataFrame, target: str, *, fmt: str = "parquet", mode: str = "append",
                   is_table: bool = False) -> int:
    """L-07: one append job of the already-validated rows; returns rows written (counted by
    ``observe`` during the write, not by a second scan)."""
    obs = Observation("move")
    counted = df.observe(obs, F.count(F.lit(1)).alias("written"))
    if is_table:
        counted.write.mode(mode).format(fmt).saveAsTable(target)
    else:
        counted.write.mode(mode).format(fmt).save(target)
    return int(obs.get.get("written", 0))


class _PerTask(AccumulatorParam):
    """Malformed lines by partition: a partition that runs again counts once."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        return {**a, **{k: v for k, v in b.items() if len(v) > len(a.get(k, ()))}}


def _watch_rejects(rejects: DataFrame, budget: int, group: str, staging) -> list | None:
    """Read the malformed lines while ``staging`` (a thread) runs. Past ``budget`` all jobs of
    ``group`` are cancelled and the lines seen so far returned (a task leaves off on its own
    once it has more than the budget, so they are few); otherwise None."""
    sc = rejects.sparkSession.sparkContext
    seen = sc.accumulator({}, _PerTask())

    def collect(batches):
        lines = []
        for batch in batches:
            lines += batch.column("raw_line").to_pylist()[:budget + 1 - len(lines)]
            if len(lines) > budget:
                break
        seen.add({TaskContext.get().partitionId(): lines})
        yield from ()

    def read():
        sc.setJobGroup(group, "read malformed lines", interruptOnCancel=True)
        try:
            rejects.select("raw_line").mapInArrow(collect, "raw_line string").write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 – cancelled, or failed as the staging will
            log.info("The reading of malformed lines was ended")

    def over():
        return sum(map(len, seen.value.values())) > budget

    reader = InheritableThread(target=read)
    reader.start()
    while reader.is_alive() and not over():
        reader.join(0.05)
    if not over():
        return None
    while reader.is_alive() or staging.is_alive():      # also a job that starts only now
        sc.cancelJobGroup(group)
        reader.join(0.05)
        staging.join(0.05)
    return [line for lines in seen.value.values() for line in lines]


def _stage(spark, parsed: DataFrame, rejects: DataFrame, budget: int | None, path: str, error_path: str) -> dict:
    """Write the parsed lines to ``path``; returns the counts of rows and rejects. Raises
    :class:`ErrorBudgetExceeded` as soon as more than ``budget`` lines are known to be bad."""
    obs = Observation("stage")
    counted = parsed.observe(obs, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(BAD).isNotNull()).alias("rejected"))
    if budget is None:
        counted.write.mode("overwrite").parquet(path)
        return obs.get
    group, failure = f"load-{uuid.uuid4().hex}", []

    def write():
        spark.sparkContext.setJobGroup(group, "stage", interruptOnCancel=True)
        try:
            counted.write.mode("overwrite").parquet(path)
        except Exception as e:  # noqa: BLE001 – raised below unless it was cancelled
            failure.append(e)

    writer = InheritableThread(target=write)
    writer.start()
    lines = _watch_rejects(rejects, budget, group, writer)
    if lines is not None:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{error_path}/rejects")
        raise ErrorBudgetExceeded(f"More than {budget} rejected rows: the load was ended early")
    writer.join()
    if failure:
        raise failure[0]
    return obs.get


def load_csv(spark: SparkSession, path, target: str, target_schema: T.StructType, *,
             header: bool = True, sep: str = ",", quoting: str = "csv", max_errors: int | None = 100,
             error_path: str | None = None, strict: bool = True, strip: bool = True,
             is_table: bool = False, fmt: str = "parquet") -> DataFrame:
    """The whole staged load, Spark-first. Returns a one-row status frame:
    rows_read, rejected, cast_errors, written, error_path.

    Raises :class:`ErrorBudgetExceeded` past ``max_errors`` rejects (as soon as they are seen,
    without reading on) and, when ``strict``, :class:`CastErrors` on any cast error – in both
    cases before the target is touched. The rejects seen until then are in the error folder.
    A lenient load writes the rows that do not convert as JSON (source text of every column
    and ``cast_errors``) to ``<error_path>/cast_errors``; malformed lines are text files in
    ``<error_path>/rejects``. So read = rejected + cast errors + written, each of them on disk.
    """
    base = scratch_dir(spark)
    parsed = parse_csv(spark, path, target_schema, header=header, sep=sep, quoting=quoting)
    # Stage once: the parsed text with the reject marker, counted in the same job.
    staged_path = f"{base}/staging"
    if error_path is None:
        stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
        error_path = f"{base}/Error{stamp}"
    try:
        counts = _stage(spark, parsed, split_rejects(parsed, target_schema, sep=sep, quoting=quoting)[1],
                        max_errors, staged_path, error_path)
        log.info("A total of %s line(s) staged in %s (%s rejected)", counts.get("rows"),
                 staged_path, counts.get("rejected"))
        staged = spark.read.parquet(staged_path)
        good, rejects = split_rejects(staged, target_schema, sep=sep, quoting=quoting)
        n_rejected = int(counts.get("rejected", 0))
        if n_rejected:
            rejects.select("raw_line").write.mode("overwrite").text(f"{error_path}/rejects")
        if max_errors is not None and n_rejected > max_errors:
            raise ErrorBudgetExceeded(f"{n_rejected} rejected rows exceed the budget of {max_errors}")
        rows = strip_quotes(good) if strip else good
        typed, bad = cast_to_target(rows, target_schema, keep_source=True)
        n_bad = bad.count() if strict else _divert(bad, target_schema, f"{error_path}/cast_errors")
        if strict and n_bad:
            raise CastErrors(f"{n_bad} rows hold values that do not convert to the target types")
        written = move_to_target(typed, target, fmt=fmt, is_table=is_table)
    finally:
        remove_scratch(spark, staged_path)
    log.info("A total of %s new record(s) appended to %s", written, target)
    return spark.createDataFrame(
        [(int(counts.get("rows", 0)), n_rejected, n_bad, written, error_path)],
        "rows_read bigint, rejected bigint, cast_errors bigint, written bigint, error_path string")


def _divert(bad: DataFrame, target: T.StructType, path: str) -> int:
    """Write the rows that do not convert, as they came, with the names of the failing
    columns; returns their number (counted during the write)."""
    obs = Observation("divert")
    source = [F.col(quote_ident(f"_src_{f.name}")).alias(f.name) for f in target.fields]
    (bad.select(F.struct(*source).alias("source"), "cast_errors")
        .observe(obs, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite").option("ignoreNullFields", "false").json(path))
    return int(obs.get.get("rows", 0))


def read_diverted(spark: SparkSession, error_path: str, target: T.StructType) -> DataFrame:
    """The diverted rows of a lenient load: ``source`` (text of every column), ``cast_errors``."""
    schema = T.StructType([T.StructField("source", staging_schema(target)),
                           T.StructField("cast_errors", T.ArrayType(T.StringType()))])
    return spark.read.schema(schema).json(f"{error_path}/cast_errors")


def clear_tables(spark: SparkSession, names) -> list[str]:
    """S-18/L-11: empty each named table (``TRUNCATE TABLE``), over an explicit list only."""
    done = []
    for name in names:
        spark.sql(f"TRUNCATE TABLE {'.'.join(quote_ident(p) for p in name.split('.'))}")
        done.append(name)
    return done


def drop_staging(spark: SparkSession, name: str) -> None:
    """L-12: drop a staging table of the caller's own (``load_csv`` removes its staging folder)."""
    spark.sql(f"DROP TABLE IF EXISTS {'.'.join(quote_ident(p) for p in name.split('.'))}")
