"""Many-table and metadata-driven queries: mirror the driver folder, expose it as views,
ordered concatenation per order, and the generated-insert behaviour on orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.catalog import append_rows, insert_rows, ordered_concat
from tablewright.plans import table
from tablewright.session import scratch_dir
from tablewright.sources.mirror import expose_views, mirror_tables, parquet_folder_reader

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Catalogue of the archive table the generated insert routine writes to (metadata, one row
# per column).
ARCHIVE_CATALOG = [
    {"column_id": 1, "column_name": "archive_id", "data_type": "bigint", "is_nullable": False,
     "is_identity": True, "default_definition": None},
    {"column_id": 2, "column_name": "o_orderkey", "data_type": "bigint", "is_nullable": False,
     "is_identity": False, "default_definition": None},
    {"column_id": 3, "column_name": "o_custkey", "data_type": "bigint", "is_nullable": True,
     "is_identity": False, "default_definition": None},
    {"column_id": 4, "column_name": "o_totalprice", "data_type": "double", "is_nullable": True,
     "is_identity": False, "default_definition": None},
    {"column_id": 5, "column_name": "status", "data_type": "string", "is_nullable": False,
     "is_identity": False, "default_definition": "'N'"},
    {"column_id": 6, "column_name": "loaded_on", "data_type": "date", "is_nullable": True,
     "is_identity": False, "default_definition": "DATE'2024-01-01'"},
]


def q_mirror_tables(spark, d):
    status = mirror_tables(spark, parquet_folder_reader(spark, d), TABLES,
                           scratch_dir(spark) + "/mirror")
    return status.select("table_name", "status", "rows")


def q_expose_views(spark, d):
    views = expose_views(parquet_folder_reader(spark, d), TABLES, prefix="tw_view_")
    parts = [f"SELECT '{v[len('tw_view_'):]}' AS table_name, COUNT(*) AS row_count FROM {v}"
             for v, st, _ in views if st == "created"]
    return spark.sql(" UNION ALL ".join(parts))


def q_ordered_concat(spark, d):
    li = table(spark, d, "lineitem")
    return ordered_concat(li, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"],
                          alias="part_keys")


def q_insert_rows(spark, d):
    batch = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows, _ = insert_rows(batch, ARCHIVE_CATALOG, order=["o_orderkey"], start_id=1)
    return rows


def q_append_rows(spark, d):
    """Two appends: one that brings identity values for some rows, one that continues from
    the largest id of the target; the target is read back."""
    target = scratch_dir(spark) + "/archive"
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    given = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 10)
    append_rows(o.where(F.col("o_orderkey") % 5 != 0).withColumn("archive_id", given), ARCHIVE_CATALOG, target, order=["o_orderkey"])
    append_rows(o.where(F.col("o_orderkey") % 5 == 0), ARCHIVE_CATALOG, target, order=["o_orderkey"])
    return spark.read.parquet(target)


def q_mirror_contents(spark, d):
    """Three mirrored tables read back: their values, not their sizes alone."""
    target = scratch_dir(spark) + "/mirror"
    mirror_tables(spark, parquet_folder_reader(spark, d), ["nation", "supplier", "orders"], target)
    nation, supplier, orders = (spark.read.parquet(f"{target}/{t}") for t in ("nation", "supplier", "orders"))
    frames = [nation.select(F.lit("nation").alias("t"), F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("v")),
              supplier.select(F.lit("supplier").alias("t"), F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_name").alias("v")),
              orders.select(F.lit("orders").alias("t"), F.col("o_orderkey").cast("bigint").alias("k"),
                            F.date_format("o_orderdate", "yyyy-MM-dd").alias("v"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def q_view_contents(spark, d):
    """A view over chosen columns in a given order, read back."""
    expose_views(parquet_folder_reader(spark, d), ["customer"], prefix="tw_part_",
                 columns={"customer": ["c_name", "c_custkey", "c_acctbal"]})
    return spark.sql("SELECT * FROM tw_part_customer")


ORACLE = {
    "append_rows": """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0),
top AS (SELECT MAX(o_orderkey * 10) AS m FROM a WHERE o_orderkey % 2 = 0),
one AS (SELECT o_orderkey * 10 AS archive_id, o_orderkey, o_custkey, o_totalprice FROM a WHERE o_orderkey % 2 = 0
  UNION ALL SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY o_orderkey), o_orderkey, o_custkey, o_totalprice
  FROM a WHERE o_orderkey % 2 <> 0),
two AS (SELECT (SELECT MAX(archive_id) FROM one) + row_number() OVER (ORDER BY o_orderkey) AS archive_id, o_orderkey,
  o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0)
SELECT archive_id, o_orderkey, o_custkey, o_totalprice, 'N' AS status, DATE '2024-01-01' AS loaded_on
FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x""",
    "mirror_contents": """SELECT 'nation' AS t, CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation
UNION ALL SELECT 'supplier', CAST(s_suppkey AS BIGINT), s_name FROM supplier
UNION ALL SELECT 'orders', CAST(o_orderkey AS BIGINT), strftime(o_orderdate, '%Y-%m-%d') FROM orders""",
    "view_contents": "SELECT c_name, c_custkey, c_acctbal FROM customer",
    "mirror_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 'copied' AS status, COUNT(*) AS rows FROM {t}" for t in TABLES),
    "expose_views": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES),
    "ordered_concat": """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ','
  ORDER BY l_linenumber, l_partkey) AS part_keys FROM lineitem GROUP BY l_orderkey""",
    "insert_rows": """SELECT row_number() OVER (ORDER BY o_orderkey) AS archive_id, o_orderkey,
  o_custkey, o_totalprice, 'N' AS status, DATE '2024-01-01' AS loaded_on FROM orders""",
}

QUERIES = {
    "mirror_tables": q_mirror_tables,
    "expose_views": q_expose_views,
    "ordered_concat": q_ordered_concat,
    "insert_rows": q_insert_rows,
    "append_rows": q_append_rows,
    "mirror_contents": q_mirror_contents,
    "view_contents": q_view_contents,
}
