"""Queries of tables kept over time: keys enforced on append, foreign keys restored after a
load, loads that end early, versions replaced at once, states of file sets, file footers, and
who may read which database."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tablewright.operators.catalog import append_rows
from tablewright.operators.keys import ForeignKey, check_foreign_keys
from tablewright.operators.reports import entitlement_matrix
from tablewright.operators.state import merge_states, profile_from_state, profile_state
from tablewright.plans import table
from tablewright.plans.loading import FAULT_FREE, ORDERS_TARGET, write_orders_csv
from tablewright.session import materialize, scratch_dir
from tablewright.sources.csv_loader import ErrorBudgetExceeded, load_csv
from tablewright.sources.footers import footer_stats
from tablewright.sources.mirror import parquet_folder_reader
from tablewright.sources.versions import MirrorFailed, mirror_version, version_reader

# Catalogue of the table of first lines (metadata, one row per column).
LINES_CATALOG = [
    {"column_id": i, "column_name": name, "data_type": kind, "is_nullable": name != "order_key", "is_identity": False,
     "default_definition": None, "is_primary_key": name == "order_key", "is_unique_key": False}
    for i, (name, kind) in enumerate([("order_key", "bigint"), ("line", "int"), ("supplier", "bigint"), ("price", "double")])]


def q_append_keyed_rows(spark, d):
    """A table keyed by order takes the finished orders, then all lines: a line is refused
    when its order is there already or an earlier line of the batch has brought it."""
    target = scratch_dir(spark) + "/lines"
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'")
    append_rows(orders.select(F.col("o_orderkey").alias("order_key"), F.lit(0).alias("line"),
                              F.col("o_totalprice").alias("price")), LINES_CATALOG, target)
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("price"))
    _, refused = append_rows(lines, LINES_CATALOG, target, order=["line", "supplier", "price"])
    kept = spark.read.parquet(target).select("*", F.lit("target").alias("place"), F.lit(None).cast("string").alias("failed_rules"))
    return kept.unionByName(refused.drop("failed_rules").withColumnRenamed("failed_rules_text", "failed_rules")
                            .withColumn("place", F.lit("refused")))


def q_restore_foreign_keys(spark, d):
    """Lines that break one of three constraints, from one reading of the lines."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    broken = check_foreign_keys(lines, [
        ForeignKey("fk_order", ("l_orderkey",), table(spark, d, "orders").where("o_orderstatus <> 'P'"), ("o_orderkey",)),
        ForeignKey("fk_part", ("l_partkey",), table(spark, d, "part").where("p_size < 45"), ("p_partkey",)),
        ForeignKey("fk_supplier", ("l_suppkey",), table(spark, d, "supplier").where("s_acctbal >= 0"), ("s_suppkey",))])
    return broken.withColumn("broken_constraints", F.array_join("broken_constraints", ","))


def q_csv_budget_stop(spark, d):
    """A load whose rejects pass its budget ends before the target is touched."""
    base = scratch_dir(spark)
    try:
        load_csv(spark, write_orders_csv(spark, d), f"{base}/target", ORDERS_TARGET, header=False, max_errors=10,
                 strict=False, error_path=f"{base}/errors")
        stopped, rows = False, spark.read.parquet(f"{base}/target").count()
    except ErrorBudgetExceeded:
        stopped, rows = True, 0
        rejects = spark.read.text(f"{base}/errors/rejects")
        if rejects.count() <= 10:
            raise
    return spark.createDataFrame([(stopped, rows)], "stopped boolean, target_rows bigint")


def q_mirror_versions(spark, d):
    """Two versions of three tables with a failed copy between them: after each step, what a
    reader of the current version sees."""
    target = scratch_dir(spark) + "/versions"
    source, names = parquet_folder_reader(spark, d), ["nation", "supplier", "orders"]

    def early(name):
        return source(name).where("o_orderstatus = 'F'") if name == "orders" else source(name).where(F.lit(name != "supplier"))

    def broken(name):
        df = source(name)
        return df.withColumn("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.raise_error(F.lit("lost")))
                             .otherwise(F.col("o_orderkey"))) if name == "orders" else df

    seen = []
    for step, reader in enumerate((early, broken, source), start=1):
        try:
            mirror_version(spark, reader, names, target)
        except MirrorFailed:
            pass
        current = version_reader(spark, target)
        seen += [current(n).groupBy().agg(F.lit(step).alias("step"), F.lit(n).alias("table_name"),
                                          F.count(F.lit(1)).alias("row_count")) for n in names]
    out = seen[0]
    for df in seen[1:]:
        out = out.unionByName(df)
    return out


def q_profile_merged_state(spark, d):
    """States of two file sets of lines (order dates apart), written and merged: the exact
    part of the profile, and whether the estimated distinct counts are within 3 %."""
    lines = table(spark, d, "lineitem")
    parts = [materialize(profile_state(lines.where(p)), "state") for p in ("l_orderkey % 2 = 0", "l_orderkey % 2 = 1")]
    merged = profile_from_state(merge_states(*parts), table_name="lineitem")
    exact = lines.agg(F.expr("array({})".format(", ".join(
        f"named_struct('column_name', '{c}', 'n', count(DISTINCT {c}))" for c in lines.columns))).alias("a")).select(F.inline("a"))
    return merged.join(exact, "column_name").select(
        "column_name", "row_count", "no_nulls", F.col("min_data_length").cast("double").alias("min_value"),
        F.col("max_data_length").cast("double").alias("max_value"), F.round("avg_data_length", 4).alias("mean_value"),
        (F.abs(F.col("no_distinct") - F.col("n")) <= F.greatest(F.lit(1), F.col("n") * 0.03)).alias("distinct_near"))


def q_footer_stats(spark, d):
    """Counts and limits of orders from the files' footers."""
    return footer_stats(spark, os.path.join(d, "orders.parquet"))


def q_entitlement_matrix(spark, d):
    """Customers as principals (one market segment is not of the wanted type), nations as
    databases."""
    principals = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "R").otherwise("U").alias("type"))
    databases = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return entitlement_matrix(principals, databases, include="Customer#%", exclude="%7",
                              exclude_names=["Customer#000000001", "Customer#000000002"],
                              exclude_databases=["NATION_3", "NATION_7", "master"])


REJECTED = "COUNT(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '1-URGENT')) > 10"

ORACLE = {
    "append_keyed_rows": """WITH t AS (SELECT o_orderkey AS order_key, 0 AS line, CAST(NULL AS BIGINT) AS supplier,
  o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_suppkey AS supplier, l_extendedprice AS price,
  l_orderkey IN (SELECT order_key FROM t) OR
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) > 1 AS refused FROM lineitem)
SELECT order_key, line, supplier, price, 'target' AS place, CAST(NULL AS VARCHAR) AS failed_rules FROM t
UNION ALL SELECT order_key, line, supplier, price, CASE WHEN refused THEN 'refused' ELSE 'target' END,
  CASE WHEN refused THEN 'primary_key' END FROM b""",
    "restore_foreign_keys": """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  concat_ws(',', CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'fk_order' END,
    CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) THEN 'fk_part' END,
    CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) THEN 'fk_supplier' END)
  AS broken_constraints FROM lineitem) x WHERE broken_constraints <> ''""",
    "csv_budget_stop": f"""SELECT {REJECTED} AS stopped,
  CASE WHEN {REJECTED} THEN 0 ELSE COUNT(*) FILTER (WHERE {FAULT_FREE}) END AS target_rows FROM orders""",
    "mirror_versions": " UNION ALL ".join(
        f"SELECT {step} AS step, '{t}' AS table_name, COUNT(*) AS row_count FROM {t} WHERE {where}"
        for step in (1, 2, 3) for t, where in (
            ("nation", "TRUE"), ("supplier", "TRUE" if step == 3 else "FALSE"),
            ("orders", "TRUE" if step == 3 else "o_orderstatus = 'F'"))),
    "entitlement_matrix": """SELECT c_name AS user_name, n_name AS database_name, 'db_datareader' AS role_name
FROM customer, nation WHERE c_mktsegment <> 'BUILDING' AND c_name LIKE 'Customer#%' AND c_name NOT LIKE '%7'
  AND c_name NOT IN ('Customer#000000001', 'Customer#000000002') AND n_name NOT IN ('NATION_3', 'NATION_7', 'master')""",
}

_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE["profile_merged_state"] = " UNION ALL ".join(
    [f"""SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS no_nulls, CAST(MIN({c}) AS DOUBLE) AS min_value,
  CAST(MAX({c}) AS DOUBLE) AS max_value, ROUND(CAST(SUM(CAST({c} AS DECIMAL(36,2))) AS DOUBLE) / COUNT({c}), 4) AS mean_value,
  TRUE AS distinct_near FROM lineitem""" for c in _NUMBERS]
    + [f"""SELECT '{c}', COUNT(*), COUNT(*) - COUNT({c}), CAST(MIN(length(rtrim({c}))) AS DOUBLE), CAST(MAX(length(rtrim({c}))) AS DOUBLE),
  CAST(SUM(length(rtrim({c}))) // COUNT({c}) AS DOUBLE), TRUE FROM lineitem""" for c in ("l_returnflag", "l_linestatus")]
    + ["SELECT 'l_shipdate', COUNT(*), COUNT(*) - COUNT(l_shipdate), NULL, NULL, NULL, TRUE FROM lineitem"])
ORACLE["footer_stats"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS no_nulls,
  {f"CAST(MIN({c}) AS VARCHAR)" if c.endswith("key") else "CAST(NULL AS VARCHAR)"} AS min_raw,
  {f"CAST(MAX({c}) AS VARCHAR)" if c.endswith("key") else "CAST(NULL AS VARCHAR)"} AS max_raw FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))

QUERIES = {
    "append_keyed_rows": q_append_keyed_rows,
    "restore_foreign_keys": q_restore_foreign_keys,
    "csv_budget_stop": q_csv_budget_stop,
    "mirror_versions": q_mirror_versions,
    "profile_merged_state": q_profile_merged_state,
    "footer_stats": q_footer_stats,
    "entitlement_matrix": q_entitlement_matrix,
}
