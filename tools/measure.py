"""
rows/s, cores, and shuffle bytes written (from Spark's event log, written to a scratch
folder; the UI stays off).

    python tools/measure.py [sf_dir]   -> prints a markdown table
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cases(spark, d):
    from tablewright.operators.profile import profile
    from tablewright.plans import loading, profiling, reconciling, reports, table

    li = lambda: table(spark, d, "lineitem")

    def advanced():
        r = profile(li(), advanced=True)
        r.domains.write.format("noop").mode("overwrite").save()
        out = r.profile
        return out

    return [
        ("profile_table basic (lineitem, 11 cols)", "lineitem",
         lambda: profile(li()).profile),
        ("profile_table advanced (lineitem)", "lineitem", advanced),
        ("exact distinct (lineitem)", "lineitem", lambda: profile(li()).profile),
        ("approximate distinct rsd 0.05 (lineitem)", "lineitem",
         lambda: profile(li(), approx_distinct=0.05).profile),
        ("LOB profile (documents.text, pages.html)", "documents+pages",
         lambda: profiling.q_profile_lob(spark, d)),
        ("job_history_report (events)", "events", lambda: reports.q_job_history_report(spark, d)),
        ("CSV load with faults (orders as CSV)", "orders",
         lambda: loading.q_csv_load_status(spark, d)),
        ("reconcile_actions (supplier)", "supplier",
         lambda: reconciling.q_reconcile_actions(spark, d)),
        ("referential_orphans (orders, lineitem, customer)", "orders",
         lambda: loading.q_referential_orphans(spark, d)),
    ]


def main():
    d = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    logdir = tempfile.mkdtemp(prefix="tw-eventlog-")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tw-measure")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", str(cpus * 2))
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tablewright.plans import table
    from tablewright.session import scratch_dir
    scratch_dir(spark)
    rows_of = {}
    results = []
    for _, _, fn in cases(spark, d):      # global warm-up: JIT and file metadata for all
        fn().write.format("noop").mode("overwrite").save()
    for i, (name, src, fn) in enumerate(cases(spark, d)):
        if src not in rows_of:
            rows_of[src] = sum(table(spark, d, t).count() for t in src.split("+"))
        group = f"case{i}"
        spark.sparkContext.setJobGroup(group, name)
        times = []
        start_ms = int(time.time() * 1000)
        for r in range(4):
            t0 = time.perf_counter()
            fn().write.format("noop").mode("overwrite").save()
            if r:
                times.append(time.perf_counter() - t0)
        results.append((group, name, src, statistics.median(times), start_ms,
                        int(time.time() * 1000)))
    spark.sparkContext.setJobGroup("done", "done")
    spark.stop()

    finished = []
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if not os.path.isfile(path) or "events_" not in os.path.basename(path) and \
                not os.path.basename(path).startswith("local-"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    finished.append(((ev.get("Task Info") or {}).get("Finish Time", 0),
                                     m.get("Shuffle Bytes Written", 0)))
    # Cases run one after the other: a task belongs to the case whose time window holds
    # its finish time (AQE submits stage jobs from other threads, so job groups miss some).
    shuffle = {}
    for group, _, _, _, t0, t1 in results:
        shuffle[group] = sum(b for t, b in finished if t0 <= t <= t1)
    print(f"| Case | Input rows | Median wall (s) | Rows/s | Shuffle written per run |")
    print(f"| --- | --- | --- | --- | --- |")
    for group, name, src, med, _, _ in results:
        per_run = shuffle.get(group, 0) / 4
        print(f"| {name} | {rows_of[src]:,} | {med:.2f} | {rows_of[src] / med:,.0f} | "
              f"{per_run / 1024:,.0f} KiB |")
    print(f"\nlocal[{cpus}], data {d}, median of 3 after a warm-up pass over all cases"
          " and one more warm-up run per case.")


if __name__ == "__main__":
    main()
