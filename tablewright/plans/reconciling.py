"""Reconciliation and row-check queries (supplier/customer/nation stand in for the
desired and actual catalogues; lineitem for rule checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.checks import row_checks
from tablewright.operators.reconcile import (
    get_or_assign_ids, insert_if_absent, reconcile, render_template, upsert_by_any_key,
    upsert_by_key,
)
from tablewright.plans import table

SUPPLIER_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def desired_suppliers(spark, d):
    s = table(spark, d, "supplier")
    return s.where(F.col("s_nationkey") != 7).select(
        "s_suppkey",
        F.when(F.col("s_nationkey").isin(1, 2), F.upper("s_name")).otherwise(F.col("s_name"))
         .alias("s_name"),
        "s_nationkey",
        F.when(F.col("s_nationkey") == 4, F.lit(None).cast("double"))
         .otherwise(F.col("s_acctbal")).alias("s_acctbal"))


def actual_suppliers(spark, d):
    s = table(spark, d, "supplier")
    return s.where(F.col("s_acctbal") > 500).select(
        "s_suppkey", "s_name",
        F.when(F.col("s_nationkey") == 3, F.lit(99)).otherwise(F.col("s_nationkey"))
         .alias("s_nationkey"), "s_acctbal")


D_SQL = """(SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 2) THEN upper(s_name) ELSE s_name END
  AS s_name, s_nationkey, CASE WHEN s_nationkey = 4 THEN NULL ELSE s_acctbal END AS s_acctbal
  FROM supplier WHERE s_nationkey <> 7)"""
A_SQL = """(SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN 99 ELSE s_nationkey END
  AS s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 500)"""


def q_reconcile_actions(spark, d):
    return reconcile(desired_suppliers(spark, d), actual_suppliers(spark, d), "s_suppkey",
                     ["s_name", "s_nationkey", "s_acctbal"], report_extra=True)


def q_upsert_by_key(spark, d):
    return upsert_by_key(actual_suppliers(spark, d), desired_suppliers(spark, d), "s_suppkey")


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def q_insert_if_absent(spark, d):
    c = _customers(spark, d)
    actual = table(spark, d, "customer").where(F.col("c_acctbal") >= 0).select(*c.columns)
    desired = c.withColumn("c_name", F.when(F.col("c_nationkey") == 5, F.upper("c_name"))
                           .otherwise(F.col("c_name")))
    return insert_if_absent(actual, desired, "c_custkey")


def q_get_or_assign_ids(spark, d):
    cust = table(spark, d, "customer")
    actual = cust.where(F.col("c_acctbal") >= 0).select(F.col("c_name").alias("name"),
                                                        F.col("c_custkey").alias("id"))
    desired = cust.select(F.col("c_name").alias("name")).unionByName(
        table(spark, d, "supplier").select(F.col("s_name").alias("name")))
    return get_or_assign_ids(desired, actual, "name", "id")


def q_render_template(spark, d):
    c = table(spark, d, "customer")
    steps = c.select(F.col("c_custkey").alias("step_id"),
                     F.concat(F.lit("env-"), F.col("c_nationkey").cast("string")).alias("environment_name"),
                     F.lit("Warehouse").alias("project_name"), F.lit("Nightly").alias("folder_name"),
                     F.concat(F.lit("load --customer "), F.col("c_custkey").cast("string"),
                              F.lit(" --ref {{EnvRefId}}")).alias("command"))
    refs = table(spark, d, "nation").where(F.col("n_regionkey") != 4).select(
        F.concat(F.lit("env-"), F.col("n_nationkey").cast("string")).alias("environment_name"),
        F.lit("Warehouse").alias("project_name"), F.lit("Nightly").alias("folder_name"),
        (F.col("n_nationkey").cast("bigint") + 1000).alias("reference_id"))
    out = render_template(steps, refs, ["environment_name", "project_name", "folder_name"])
    return out.select("step_id", "command", "error")


def q_upsert_by_any_key(spark, d):
    """Job steps stand-in: actual = part (id, name, size); desired rows either keep an
    existing id under a new name, or keep an existing name under a new id."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("step_id"),
                                       F.col("p_name").alias("step_name"),
                                       F.col("p_size").alias("command_size"))
    renamed = (p.where(F.col("command_size") < 10)
                .withColumn("step_name", F.concat(F.col("step_name"), F.lit(" v2"))))
    moved = (p.where(F.col("command_size") > 45)
              .withColumn("step_id", F.col("step_id") + 100000))
    return upsert_by_any_key(p, renamed.unionByName(moved), [["step_id"], ["step_name"]])


def _keyed_customers(spark, d):
    """Customers under keys that are NULL in places and repeat: (key, name, balance)."""
    c = table(spark, d, "customer")
    key = F.when(F.col("c_nationkey") == 3, F.lit(None)).otherwise(F.col("c_custkey") % 40)
    return c.select(key.alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def q_reconcile_null_keys(spark, d):
    """Apply, then reconcile again: every key is kept (NULL keys and repeats included)."""
    every = _keyed_customers(spark, d)
    desired = every.groupBy("key").agg(F.min("name").alias("name"), F.max("balance").alias("balance"))
    actual = every.where(F.col("balance") > 5000).dropDuplicates(["key"]).select("key", "name", "balance")
    after = upsert_by_key(actual, desired, "key")
    return reconcile(desired, after, "key", ["name", "balance"], report_extra=True)


def q_insert_if_absent_duplicates(spark, d):
    """Repeated and NULL desired keys add one row each, and none on a second run."""
    every = _keyed_customers(spark, d)
    actual = every.where(F.col("key") < 10).groupBy("key").agg(
        F.min("name").alias("name"), F.min("balance").alias("balance"))
    once = insert_if_absent(actual, every, "key")
    return insert_if_absent(once, every, "key")


def q_ids_null_keys(spark, d):
    """One id per key, NULL key included, where the existing table repeats keys."""
    every = _keyed_customers(spark, d)
    actual = every.where(F.col("key") < 10).select("key", F.length("name").cast("bigint").alias("id")).unionByName(
        every.where(F.col("key") < 5).select("key", (F.col("key") + 100).cast("bigint").alias("id")))
    return get_or_assign_ids(every, actual, "key", "id").select("key", "id")


def q_render_template_mixed(spark, d):
    """Steps with and without the placeholder, NULL commands and NULL lookup keys."""
    c = table(spark, d, "customer")
    nation = F.when(F.col("c_nationkey") == 2, F.lit(None)).otherwise(F.col("c_nationkey"))
    steps = c.select(F.col("c_custkey").alias("step_id"), nation.alias("nation"),
                     F.when(F.col("c_custkey") % 3 == 0, F.lit("run {{EnvRefId}} twice {{EnvRefId}}"))
                      .when(F.col("c_custkey") % 3 == 1, F.lit("plain command")).alias("command"))
    n = table(spark, d, "nation").where(F.col("n_nationkey") < 20)
    refs = n.select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") + 500).cast("bigint").alias("reference_id"))
    refs = refs.unionByName(refs.where(F.col("nation") == 5).withColumn("reference_id", F.col("reference_id") + 1))
    return render_template(steps, refs, ["nation"]).select("step_id", "command", "error")


LINEITEM_RULES_SQL = [
    ("quantity_positive", "l_quantity > 0"),
    ("discount_at_most_0_08", "l_discount <= 0.08"),
    ("quantity_below_50", "l_quantity < 50"),
    ("returnflag_known", "l_returnflag IN ('A', 'N', 'R')"),
    ("linenumber_1_to_7", "l_linenumber BETWEEN 1 AND 7"),
    ("shipdate_not_null", "l_shipdate IS NOT NULL"),
]


def q_row_checks(spark, d):
    li = table(spark, d, "lineitem")
    rules = {name: F.expr(pred) for name, pred in LINEITEM_RULES_SQL}
    _, bad = row_checks(li, rules)
    return bad.select("l_orderkey", "l_linenumber", "failed_rules_text")


_fails = ", ".join(f"CASE WHEN NOT coalesce({p}, true) THEN '{n}' END"
                   for n, p in LINEITEM_RULES_SQL)

ORACLE = {
    "reconcile_actions": f"""SELECT coalesce(d.s_suppkey, a.s_suppkey) AS s_suppkey,
  CASE WHEN a.s_suppkey IS NULL THEN 'create' WHEN d.s_suppkey IS NULL THEN 'extra'
       WHEN d.s_name IS DISTINCT FROM a.s_name OR d.s_nationkey IS DISTINCT FROM a.s_nationkey
         OR d.s_acctbal IS DISTINCT FROM a.s_acctbal THEN 'replace' ELSE 'keep' END AS action
FROM {D_SQL} d FULL OUTER JOIN {A_SQL} a ON d.s_suppkey = a.s_suppkey""",
    "upsert_by_key": f"""SELECT * FROM {A_SQL} a WHERE s_suppkey NOT IN (SELECT s_suppkey FROM {D_SQL} d)
UNION ALL SELECT * FROM {D_SQL} d""",
    "insert_if_absent": """SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
  WHERE c_acctbal >= 0
UNION ALL
SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN upper(c_name) ELSE c_name END, c_nationkey,
  c_mktsegment FROM customer WHERE c_acctbal < 0""",
    "get_or_assign_ids": """WITH a AS (SELECT c_name AS name, c_custkey AS id FROM customer
    WHERE c_acctbal >= 0),
w AS (SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer
      UNION ALL SELECT s_name FROM supplier) u)
SELECT w.name, a.id FROM w JOIN a ON w.name = a.name
UNION ALL
SELECT name, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY name) AS id
FROM w WHERE name NOT IN (SELECT name FROM a)""",
    "render_template": """SELECT c.c_custkey AS step_id,
  CASE WHEN r.reference_id IS NULL THEN NULL ELSE replace('load --customer '
    || CAST(c.c_custkey AS VARCHAR) || ' --ref {{EnvRefId}}', '{{EnvRefId}}',
    CAST(r.reference_id AS VARCHAR)) END AS command,
  CASE WHEN r.reference_id IS NULL THEN 'no reference for env-' || CAST(c.c_nationkey AS VARCHAR)
    || '/Warehouse/Nightly' END AS error
FROM customer c LEFT JOIN (SELECT n_nationkey, CAST(n_nationkey AS BIGINT) + 1000 AS reference_id
  FROM nation WHERE n_regionkey <> 4) r ON c.c_nationkey = r.n_nationkey""",
    "reconcile_null_keys": """SELECT DISTINCT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_custkey % 40 END AS key,
  'keep' AS action FROM customer""",
    "insert_if_absent_duplicates": """WITH e AS (SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_custkey % 40 END AS key,
    c_name AS name, c_acctbal AS balance FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY name, balance) AS n FROM e)
SELECT key, MIN(name) AS name, MIN(balance) AS balance FROM e WHERE key < 10 GROUP BY key
UNION ALL SELECT key, name, balance FROM r WHERE n = 1 AND (key >= 10 OR key IS NULL)""",
    "ids_null_keys": """WITH e AS (SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_custkey % 40 END AS key,
    c_name AS name FROM customer),
a AS (SELECT key, length(name) AS id FROM e WHERE key < 10 UNION ALL SELECT key, key + 100 FROM e WHERE key < 5)
SELECT key, MIN(id) AS id FROM a GROUP BY key
UNION ALL SELECT key, (SELECT MAX(id) FROM a) + row_number() OVER (ORDER BY key NULLS FIRST) AS id
FROM (SELECT DISTINCT key FROM e WHERE key >= 10 OR key IS NULL) n""",
    "render_template_mixed": """WITH s AS (SELECT c_custkey AS step_id,
    CASE WHEN c_nationkey = 2 THEN NULL ELSE c_nationkey END AS nation,
    CASE c_custkey % 3 WHEN 0 THEN 'run {{EnvRefId}} twice {{EnvRefId}}' WHEN 1 THEN 'plain command' END AS command
  FROM customer)
SELECT step_id,
  CASE WHEN command LIKE '%{{EnvRefId}}%' THEN
    CASE WHEN nation < 20 AND nation <> 5 THEN replace(command, '{{EnvRefId}}', CAST(nation + 500 AS VARCHAR)) END
    ELSE command END AS command,
  CASE WHEN command LIKE '%{{EnvRefId}}%' THEN
    CASE WHEN nation = 5 THEN 'several references for 5'
         WHEN nation IS NULL THEN 'no reference for '
         WHEN nation >= 20 THEN 'no reference for ' || CAST(nation AS VARCHAR) END END AS error FROM s""",
    "upsert_by_any_key": """WITH a AS (SELECT p_partkey AS step_id, p_name AS step_name,
    p_size AS command_size FROM part),
d AS (SELECT step_id, step_name || ' v2' AS step_name, command_size FROM a WHERE command_size < 10
      UNION ALL
      SELECT step_id + 100000, step_name, command_size FROM a WHERE command_size > 45)
SELECT * FROM a WHERE step_id NOT IN (SELECT step_id FROM d)
  AND step_name NOT IN (SELECT step_name FROM d)
UNION ALL SELECT * FROM d""",
    "row_checks": f"""SELECT l_orderkey, l_linenumber, failed_rules_text FROM (
  SELECT l_orderkey, l_linenumber, concat_ws(',', {_fails}) AS failed_rules_text FROM lineitem) x
WHERE failed_rules_text <> ''""",
}

QUERIES = {
    "reconcile_actions": q_reconcile_actions,
    "upsert_by_key": q_upsert_by_key,
    "insert_if_absent": q_insert_if_absent,
    "get_or_assign_ids": q_get_or_assign_ids,
    "render_template": q_render_template,
    "row_checks": q_row_checks,
    "upsert_by_any_key": q_upsert_by_any_key,
    "reconcile_null_keys": q_reconcile_null_keys,
    "insert_if_absent_duplicates": q_insert_if_absent_duplicates,
    "ids_null_keys": q_ids_null_keys,
    "render_template_mixed": q_render_template_mixed,
}
