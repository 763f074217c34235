from pyspark.sql import functions as F

from tablewright.operators.checks import check_referential_integrity, parameter_rules, row_checks
from tablewright.operators.reconcile import (
    get_or_assign_ids, insert_if_absent, reconcile, render_template, upsert_by_key,
)

SCHEMA = "k int, v string, w int"


def test_reconcile_actions_null_safe(spark):
    desired = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (4, "d", 4)], SCHEMA)
    actual = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (5, "e", 5)], SCHEMA)
    got = dict((r["k"], r["action"]) for r in
               reconcile(desired, actual, "k", ["v", "w"], report_extra=True).collect())
    assert got == {1: "keep", 2: "replace", 3: "keep", 4: "create", 5: "extra"}


def test_reconcile_apply_then_reconcile_keeps_all(spark):
    desired = spark.createDataFrame([(1, "x", None), (2, "b", 2), (7, "n", 7)], SCHEMA)
    actual = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], SCHEMA)
    after = upsert_by_key(actual, desired, "k")
    assert sorted(tuple(r) for r in after.collect()) == [(1, "x", None), (2, "b", 2), (3, "c", 3), (7, "n", 7)]
    again = {r["action"] for r in reconcile(desired, after, "k", ["v", "w"]).collect()}
    assert again == {"keep"}


def test_insert_if_absent_leaves_existing(spark):
    actual = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    desired = spark.createDataFrame([(1, "changed", 9), (2, "b", 2)], SCHEMA)
    got = sorted(tuple(r) for r in insert_if_absent(actual, desired, "k").collect())
    assert got == [(1, "a", 1), (2, "b", 2)]


def test_get_or_assign_ids(spark):
    actual = spark.createDataFrame([("b", 10), ("d", 3)], "name string, id bigint")
    desired = spark.createDataFrame([(n,) for n in ["e", "a", "b", "a", "c"]], "name string")
    got = dict((r["name"], r["id"]) for r in get_or_assign_ids(desired, actual, "name", "id").collect())
    assert got == {"b": 10, "a": 11, "c": 12, "e": 13}


def test_get_or_assign_ids_many_partitions(spark):
    actual = spark.createDataFrame([(0, 5)], "key int, id bigint")
    desired = spark.range(1, 2001).select(F.col("id").cast("int").alias("key")).repartition(7)
    got = get_or_assign_ids(desired, actual, "key", "id").collect()
    ids = {r["key"]: r["id"] for r in got}
    assert len(ids) == 2000 and all(ids[k] == 5 + k for k in ids)


def test_render_template_missing_reference(spark):
    steps = spark.createDataFrame([(1, "e1", "run {{EnvRefId}}"), (2, "e2", "run {{EnvRefId}}")],
                                  "step_id int, env string, command string")
    refs = spark.createDataFrame([("e1", 42), ("e2", None)], "env string, reference_id bigint")
    got = {r["step_id"]: (r["command"], r["error"]) for r in render_template(steps, refs, "env").collect()}
    assert got[1] == ("run 42", None)
    assert got[2][0] is None and got[2][1].startswith("no reference")   # NULL id is an error too


def test_parameter_row_checks(spark):
    df = spark.createDataFrame([
        (20, "f", "p", "x", None, "R"), (30, "f", "p", "x", None, "R"),
        (40, "f", "p", "x", "pkg", "Z"), (20, None, "p", "x", None, "V")],
        "parameter_type int, folder_name string, project_name string, parameter_name string, "
        "package_name string, reference_type string")
    good, bad = row_checks(df, parameter_rules())
    assert good.count() == 1
    fails = sorted(r["failed_rules_text"] for r in bad.collect())
    assert fails == ["folder_name_not_null", "package_null_iff_project",
                     "parameter_type_in_20_30,reference_type_in_R_V"]


def test_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "pid int, x string")
    got = [tuple(r) for r in check_referential_integrity(child, parent, "pid", "id").collect()]
    assert got == [(3, "b")]


def test_upsert_by_any_key_matches_id_or_name(spark):
    from tablewright.operators.reconcile import upsert_by_any_key
    actual = spark.createDataFrame([(1, "load", "a"), (2, "check", "b"), (3, "send", "c")],
                                   "step_id int, step_name string, command string")
    desired = spark.createDataFrame([(1, "load v2", "x"), (9, "check", "y")],
                                    "step_id int, step_name string, command string")
    got = sorted(tuple(r) for r in upsert_by_any_key(actual, desired, [["step_id"], ["step_name"]]).collect())
    assert got == [(1, "load v2", "x"), (3, "send", "c"), (9, "check", "y")]


def test_reconcile_duplicates_and_ambiguous(spark):
    desired = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 2), (3, "c", 3)], SCHEMA)
    actual = spark.createDataFrame([(2, "b", 2), (2, "x", 9), (3, "c", 3)], SCHEMA)
    got = dict((r["k"], r["action"]) for r in reconcile(desired, actual, "k", ["v", "w"]).collect())
    assert got == {1: "duplicate", 2: "ambiguous", 3: "keep"}


def test_orphans_with_hot_key(spark):
    parent = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(7, i) for i in range(300)] + [(1, 0)], "pid int, n int")
    assert check_referential_integrity(child, parent, "pid", "id").count() == 300


def test_sequential_ids_with_hot_order_value(spark):
    from tablewright.operators.reconcile import assign_sequential_ids
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)], "o int, v int").repartition(5)
    ids = [r["rid"] for r in assign_sequential_ids(df, ["o"], "rid", 1).collect()]
    assert sorted(ids) == list(range(1, 3001))
    by_o = assign_sequential_ids(df, ["o"], "rid", 1).where("o > 0").orderBy("o").collect()
    assert [r["rid"] for r in by_o] == sorted(r["rid"] for r in by_o)


def test_apply_then_reconcile_keeps_everything_with_null_and_repeated_keys(spark):
    rows = [(None, "a", 1), (None, "b", 2), (1, "x", None), (1, "x", None), (2, "y", 5), (3, None, None)]
    desired = spark.createDataFrame(rows, "k int, v string, w int")
    actual = spark.createDataFrame([(None, "old", 0), (2, "old", 0), (9, "extra", 1)], "k int, v string, w int")
    after = upsert_by_key(actual, desired, "k")
    got = sorted(map(tuple, after.collect()), key=str)
    assert got == sorted([(None, "a", 1), (1, "x", None), (2, "y", 5), (3, None, None), (9, "extra", 1)], key=str)
    one = desired.groupBy("k").agg(F.min(F.struct("v", "w")).alias("s")).select("k", "s.*")
    actions = {r["action"] for r in reconcile(one, after, "k", ["v", "w"]).collect()}
    assert actions == {"keep"}
    once = insert_if_absent(actual, desired, "k")
    assert once.count() == 5 and insert_if_absent(once, desired, "k").count() == 5
    ids = get_or_assign_ids(desired, actual.select("k", "w"), "k", "w").collect()
    assert sorted((str(r["k"]), r["w"]) for r in ids) == [("1", 2), ("2", 0), ("3", 3), ("None", 0)]
