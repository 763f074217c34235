"""CSV loader queries. The input file is derived from ``orders`` by Spark: each order is
written as one text line, with faults planted by content rules (short line, long line,
quoted comma, quoted value, unconvertible number, impossible date)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.checks import check_referential_integrity
from tablewright.plans import table
from tablewright.session import scratch_dir
from tablewright.sources.csv_loader import (
    cast_to_target, load_csv, read_csv_staged, read_diverted, strip_quotes,
)

ORDERS_TARGET = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])


def write_orders_csv(spark, d) -> str:
    """Write orders as header-less CSV lines with planted faults; returns the folder."""
    o = table(spark, d, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.when((st == "F") & (pr == "3-MEDIUM"), F.lit("n/a")).otherwise(
        F.col("o_totalprice").cast("string"))
    date = F.when((st == "F") & (pr == "4-NOT SPECIFIED"), F.lit("2024-13-45 00:00:00")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    prio = (F.when((st == "O") & (pr == "2-HIGH"), F.lit('"2-HIGH, rush"'))
             .when((st == "O") & (pr == "3-MEDIUM"), F.lit('"3-MEDIUM"'))
             .otherwise(pr))
    head = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), st, price]
    line = (F.when((st == "P") & (pr == "5-LOW"), F.concat_ws(",", *head, date))
             .when((st == "P") & (pr == "1-URGENT"), F.concat_ws(",", *head, date, prio, F.lit("x")))
             .otherwise(F.concat_ws(",", *head, date, prio)))
    path = scratch_dir(spark) + "/orders_csv"
    o.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def q_csv_staged_load(spark, d):
    good, _ = read_csv_staged(spark, write_orders_csv(spark, d), ORDERS_TARGET, header=False)
    typed, _ = cast_to_target(good, ORDERS_TARGET)
    return typed


def q_csv_rejects(spark, d):
    _, rejects = read_csv_staged(spark, write_orders_csv(spark, d), ORDERS_TARGET, header=False)
    return rejects


def q_cast_errors(spark, d):
    good, _ = read_csv_staged(spark, write_orders_csv(spark, d), ORDERS_TARGET, header=False)
    _, bad = cast_to_target(good, ORDERS_TARGET)
    return bad.select("o_orderkey", F.array_join("cast_errors", ",").alias("cast_errors"))


def q_strip_quotes(spark, d):
    good, _ = read_csv_staged(spark, write_orders_csv(spark, d), ORDERS_TARGET, header=False,
                              quoting="none")
    typed, _ = cast_to_target(strip_quotes(good), ORDERS_TARGET)
    return typed


def q_csv_load_status(spark, d):
    target = scratch_dir(spark) + "/orders_target"
    return load_csv(spark, write_orders_csv(spark, d), target, ORDERS_TARGET, header=False,
                    max_errors=None, strict=False).drop("error_path")


def q_csv_cast_rejects(spark, d):
    """Rows of a lenient load that did not convert, read back from the error folder, and the
    rows that did, read back from the target: every line read is found on disk."""
    base = scratch_dir(spark)
    status = load_csv(spark, write_orders_csv(spark, d), f"{base}/target", ORDERS_TARGET, header=False,
                      max_errors=None, strict=False, error_path=f"{base}/errors").first()
    bad = read_diverted(spark, status["error_path"], ORDERS_TARGET).select(
        F.col("source.o_orderkey").cast("bigint").alias("o_orderkey"), F.lit("diverted").alias("place"),
        F.array_join("cast_errors", ",").alias("cast_errors"),
        F.when(F.array_contains("cast_errors", "o_totalprice"), F.col("source.o_totalprice"))
         .otherwise(F.col("source.o_orderdate")).alias("bad_text"))
    good = spark.read.parquet(f"{base}/target").select(
        "o_orderkey", F.lit("target").alias("place"), F.lit(None).cast("string").alias("cast_errors"),
        F.lit(None).cast("string").alias("bad_text"))
    lines = spark.read.text(f"{base}/errors/rejects").select(
        F.split("value", ",")[0].cast("bigint").alias("o_orderkey"), F.lit("rejects").alias("place"),
        F.lit(None).cast("string").alias("cast_errors"), F.lit(None).cast("string").alias("bad_text"))
    return bad.unionByName(good).unionByName(lines)


def q_referential_orphans(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    lineitem = table(spark, d, "lineitem")
    # orders without any line (parent side seen as child), and orders whose customer is
    # missing from the customers that have a non-negative balance
    no_lines = check_referential_integrity(orders, lineitem, "o_orderkey", "l_orderkey")
    no_cust = check_referential_integrity(
        orders, customer.where(F.col("c_acctbal") >= 0), "o_custkey", "c_custkey")
    return (no_lines.select("o_orderkey", F.lit("lineitem").alias("missing_parent"))
            .unionByName(no_cust.select("o_orderkey", F.lit("customer").alias("missing_parent"))))


LINES_SQL = """(SELECT *,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN 'n/a'
       ELSE CAST(o_totalprice AS VARCHAR) END AS price_t,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN '2024-13-45 00:00:00'
       ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_t FROM orders)"""
FAULT_FREE = """NOT (o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '1-URGENT'))
  AND NOT (o_orderstatus = 'F' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED'))"""
GOOD_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN {{rush}}
       WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN {{quoted}}
       ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE {FAULT_FREE} {{extra}}"""

ORACLE = {
    "csv_staged_load": GOOD_SQL.format(rush="'2-HIGH, rush'", quoted="'3-MEDIUM'", extra=""),
    "csv_rejects": f"""SELECT CASE WHEN o_orderpriority = '5-LOW'
    THEN concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
                   price_t, date_t)
    ELSE concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
                   price_t, date_t, o_orderpriority, 'x') END AS raw_line,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'too few fields' ELSE 'too many fields' END AS reason
FROM {LINES_SQL} l WHERE o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '1-URGENT')""",
    "cast_errors": """SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'o_totalprice'
  ELSE 'o_orderdate' END AS cast_errors FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')""",
    "strip_quotes": GOOD_SQL.format(rush="NULL", quoted="'3-MEDIUM'",
                                    extra="AND NOT (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')"),
    "csv_load_status": f"""SELECT COUNT(*) AS rows_read,
  COUNT(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '1-URGENT')) AS rejected,
  COUNT(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED'))
    AS cast_errors,
  COUNT(*) FILTER (WHERE {FAULT_FREE}) AS written FROM orders""",
    "csv_cast_rejects": """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '1-URGENT') THEN 'rejects'
       WHEN o_orderstatus = 'F' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'diverted'
       ELSE 'target' END AS place,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN 'o_totalprice'
       WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'o_orderdate' END AS cast_errors,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN 'n/a'
       WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN '2024-13-45 00:00:00'
  END AS bad_text FROM orders""",
    "referential_orphans": """SELECT o_orderkey, 'lineitem' AS missing_parent FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL
SELECT o_orderkey, 'customer' FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)""",
}

QUERIES = {
    "csv_staged_load": q_csv_staged_load,
    "csv_rejects": q_csv_rejects,
    "cast_errors": q_cast_errors,
    "strip_quotes": q_strip_quotes,
    "csv_load_status": q_csv_load_status,
    "csv_cast_rejects": q_csv_cast_rejects,
    "referential_orphans": q_referential_orphans,
}
