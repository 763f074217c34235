import pytest
import os

from pyspark.sql import functions as F

from tablewright.operators.catalog import (
    column_catalog, fk_constraints, insert_rows, insertable_columns, ordered_concat,
)
from tablewright.sources.mirror import (
    expose_views, list_source_columns, mirror_tables, parquet_folder_reader,
)


def test_fk_constraints_composite_order_and_system_tables(spark):
    fk = spark.createDataFrame([
        ("fk_a", "s", "child", "c2", "s", "parent", "p2", 2, False),
        ("fk_a", "s", "child", "c1", "s", "parent", "p1", 1, False),
        ("fk_sys", "sys", "t", "x", "sys", "u", "y", 1, True)],
        "fk_name string, child_schema string, child_table string, child_column string, "
        "parent_schema string, parent_table string, parent_column string, position int, "
        "system_shipped boolean")
    got = {r["fk_name"]: r for r in fk_constraints(fk).collect()}
    assert got["fk_a"]["drop_script"] == "ALTER TABLE `s`.`child` DROP CONSTRAINT `fk_a`;"
    assert got["fk_a"]["create_script"] == ("ALTER TABLE `s`.`child` ADD CONSTRAINT `fk_a` FOREIGN KEY "
                                            "(`c1`,`c2`) REFERENCES `s`.`parent`(`p1`,`p2`);")
    assert got["fk_sys"]["create_script"] is None


def _catalog(spark):
    cols = spark.createDataFrame([
        ("dbo", 1, "t", "id", 1, "bigint", 8, 19, 0, False, True, False, None),
        ("dbo", 1, "t", "code", 2, "string", 10, 0, 0, False, False, False, None),
        ("dbo", 1, "t", "status", 3, "string", 1, 0, 0, False, False, True, "'N'"),
        ("dbo", 1, "t", "parent", 4, "bigint", 8, 19, 0, True, False, False, None)],
        "schema_name string, table_object_id int, table_name string, column_name string, "
        "column_id int, data_type string, max_length int, precision int, scale int, "
        "is_nullable boolean, is_identity boolean, has_default boolean, default_definition string")
    fks = spark.createDataFrame([("fk_parent", 1, 4, "p", "pid")],
                                "fk_name string, table_object_id int, column_id int, "
                                "referenced_table_name string, referenced_column_name string")
    keys = spark.createDataFrame([(1, "id", 1, 0), (1, "code", 0, 1)],
                                 "table_object_id int, column_name string, is_primary_key int, is_unique_key int")
    return column_catalog(cols, fks, keys)


def test_column_catalog_and_insertable(spark):
    cat = _catalog(spark)
    rows = {r["column_name"]: r for r in cat.collect()}
    assert rows["parent"]["referenced_table_name"] == "p"
    assert rows["id"]["is_primary_key"] and rows["code"]["is_unique_key"]
    ins = {r["column_name"]: r for r in insertable_columns(cat).collect()}
    assert not ins["id"]["given"] and ins["status"]["optional"] and ins["parent"]["optional"]
    assert [c for c in ("id", "code", "status", "parent") if ins[c]["inserted"]] == ["parent"]


def test_insert_rows_defaults_ids_and_not_null(spark):
    cat = [r.asDict() for r in _catalog(spark).collect()]
    batch = spark.createDataFrame([("b", 7), ("a", None), (None, 3)], "code string, parent bigint")
    rows, bad = insert_rows(batch, cat, order=["code"], start_id=100)
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [(100, "a", "N", None), (101, "b", "N", 7)]
    assert [r["failed_rules_text"] for r in bad.collect()] == ["code_not_null"]


def test_ordered_concat(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "z", 1)], "k int, v string, o int")
    got = {r["k"]: r["vals"] for r in ordered_concat(df, "k", "v", "o", alias="vals").collect()}
    assert got == {1: "a,b", 2: "z"}


def test_mirror_goes_on_after_failure(spark, tmpdir_path):
    src = tmpdir_path + "/src"
    spark.range(5).write.parquet(src + "/a.parquet")
    spark.range(3).write.parquet(src + "/b.parquet")
    status = {r["table_name"]: r for r in mirror_tables(
        spark, parquet_folder_reader(spark, src), ["a", "missing", "b", "a"],
        tmpdir_path + "/dst").collect()}
    assert status["a"]["status"] == "copied" and status["a"]["rows"] == 5
    assert status["b"]["rows"] == 3
    assert status["missing"]["status"] == "failed" and status["missing"]["error"]
    assert spark.read.parquet(tmpdir_path + "/dst/b").count() == 3


def test_expose_views_and_listing(spark, tmpdir_path):
    src = tmpdir_path + "/src"
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(src + "/t.parquet")
    reader = parquet_folder_reader(spark, src)
    out = expose_views(reader, ["t", "nope"], prefix="tw_v_", columns={"t": ["b", "a"]})
    assert out[0][1] == "created" and out[1][1] == "failed"
    assert spark.table("tw_v_t").columns == ["b", "a"]
    cols = list_source_columns(spark, reader, ["t"]).collect()
    assert [(r["column_name"], r["ordinal_position"], r["type_name"]) for r in cols] == [
        ("a", 1, "int"), ("b", 2, "string")]


def test_foreign_key_columns_feed_profile(spark):
    from tablewright.operators.catalog import foreign_key_columns
    from tablewright.operators.profile import profile
    tc = spark.createDataFrame([("fk1", "s", "orders", "FOREIGN KEY"), ("pk1", "s", "orders", "PRIMARY KEY"),
                                ("fk2", "s", "other", "FOREIGN KEY")],
                               "constraint_name string, table_schema string, table_name string, constraint_type string")
    cu = spark.createDataFrame([("fk1", "s", "orders", "cust"), ("pk1", "s", "orders", "id"),
                                ("fk2", "s", "other", "id")],
                               "constraint_name string, table_schema string, table_name string, column_name string")
    fks = foreign_key_columns(tc, cu, "s", "orders")
    assert [r["column_name"] for r in fks.collect()] == ["cust"]
    df = spark.createDataFrame([(1, 5), (2, 5)], "id int, cust int")
    flags = {r["column_name"]: r["is_fk"] for r in profile(df, fks=fks).profile.collect()}
    assert flags == {"id": False, "cust": True}


def test_permission_report(spark):
    from tablewright.operators.reports import permission_report
    cols = "owner string, object string, grantee string, grantor string, protect_type string, action string, column string"
    a = spark.createDataFrame([("dbo", "t", "u1", "dbo", "Grant", "Select", "(All)")], cols)
    b = spark.createDataFrame([("dbo", "v", "u2", "dbo", "Deny", "Insert", ".")], cols)
    got = sorted((r["database"], r["grantee"]) for r in permission_report({"sales": a, "hr": b}).collect())
    assert got == [("hr", "u2"), ("sales", "u1")]


def test_profile_table_guards(spark):
    import pytest
    from tablewright.operators.profile import profile_table
    with pytest.raises(ValueError):
        profile_table(spark, "tw_no_such_table")
    spark.createDataFrame([], "a int").createOrReplaceTempView("tw_empty_t")
    with pytest.raises(ValueError):
        profile_table(spark, "tw_empty_t")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("tw_one_t")
    r = profile_table(spark, "tw_one_t").profile.collect()[0]
    assert (r["table_name"], r["row_count"]) == ("tw_one_t", 1)


def test_jdbc_options_split_a_remote_scan():
    from tablewright.sources.mirror import jdbc_options
    assert jdbc_options("jdbc:x", "t", {"user": "u"}) == {"url": "jdbc:x", "dbtable": "t", "user": "u"}
    split = jdbc_options("jdbc:x", "t", partition={"column": "id", "lower": 1, "upper": 9, "parts": 4})
    assert split == {"url": "jdbc:x", "dbtable": "t", "partitionColumn": "id", "lowerBound": "1",
                     "upperBound": "9", "numPartitions": "4"}


def test_insert_keeps_given_ids_and_refuses_unknown_columns(spark):
    from tablewright.operators.catalog import insert_rows
    cat = [{"column_id": 1, "column_name": "id", "data_type": "bigint", "is_nullable": False, "is_identity": True,
            "default_definition": None},
           {"column_id": 2, "column_name": "v", "data_type": "string", "is_nullable": True, "is_identity": False,
            "default_definition": None}]
    batch = spark.createDataFrame([(7, "a"), (None, "b"), (None, "c")], "id long, v string")
    old = spark.createDataFrame([(20, "z")], "id long, v string")
    rows, bad = insert_rows(batch, cat, existing=old)
    assert sorted((r["id"], r["v"]) for r in rows.collect()) == [(7, "a"), (21, "b"), (22, "c")]
    assert bad.count() == 0
    with pytest.raises(ValueError):
        insert_rows(batch.withColumn("extra", F.lit(1)), cat)


def test_gather_refuses_sources_that_differ(spark):
    from tablewright.operators.reports import gather_across
    a, b = spark.range(1), spark.range(1).withColumn("x", F.lit(1))
    with pytest.raises(ValueError):
        gather_across({"a": a, "b": b})
    assert gather_across({"a": a, "b": b}, fill_missing=True).count() == 2
