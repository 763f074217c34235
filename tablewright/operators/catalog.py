"""Column catalogue and metadata-driven operators (M-04 … M-06, L-08, A-13).

Catalogue frames (columns, defaults, keys, foreign keys) have one row per column or
constraint: they are small and bounded by the schema, not by the data. The data-side
operators (``insert_rows``, ``ordered_concat``) stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import quote_ident
from tablewright.operators.checks import row_checks
from tablewright.operators.keys import enforce_keys, key_constraints
from tablewright.operators.reconcile import assign_sequential_ids


def ordered_concat(df: DataFrame, keys, value_col: str, order, sep: str = ",",
                   alias: str = "values") -> DataFrame:
    """A-13: per key, the values joined by ``sep`` in ``order_col`` order
    (LISTAGG … WITHIN GROUP). Meant for groups of bounded size (columns of a constraint,
    lines of an order): the joined text of a group is one value."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    sep_sql = sep.replace("'", "''")
    agg = F.expr(f"listagg(CAST({quote_ident(value_col)} AS STRING), '{sep_sql}') "
                 f"WITHIN GROUP (ORDER BY {', '.join(quote_ident(c) for c in order)})")
    return df.groupBy(*keys).agg(agg.alias(alias))


def _qualified(schema_col, table_col):
    return F.concat(F.lit("`"), F.replace(F.col(schema_col), F.lit("`"), F.lit("``")), F.lit("`.`"),
                    F.replace(F.col(table_col), F.lit("`"), F.lit("``")), F.lit("`"))


def _quoted(col):
    return F.concat(F.lit("`"), F.replace(F.col(col), F.lit("`"), F.lit("``")), F.lit("`"))


def fk_constraints(fk_columns: DataFrame) -> DataFrame:
    """L-08: one drop text and one create text per foreign key, composite columns in
    position order; constraints on system-shipped tables get no create text.

    fk_columns(fk_name, child_schema, child_table, child_column, parent_schema,
    parent_table, parent_column, position, system_shipped)."""
    g = ["fk_name", "child_schema", "child_table", "parent_schema", "parent_table"]
    agg = fk_columns.withColumn("_cq", _quoted("child_column")).withColumn(
        "_pq", _quoted("parent_column")).groupBy(*g).agg(
        F.expr("listagg(_cq, ',') WITHIN GROUP (ORDER BY position)").alias("_child_cols"),
        F.expr("listagg(_pq, ',') WITHIN GROUP (ORDER BY position)").alias("_parent_cols"),
        F.max(F.coalesce(F.col("system_shipped"), F.lit(False))).alias("_system"))
    child = _qualified("child_schema", "child_table")
    parent = _qualified("parent_schema", "parent_table")
    drop = F.concat(F.lit("ALTER TABLE "), child, F.lit(" DROP CONSTRAINT "), _quoted("fk_name"),
                    F.lit(";"))
    create = F.when(~F.col("_system"), F.concat(
        F.lit("ALTER TABLE "), child, F.lit(" ADD CONSTRAINT "), _quoted("fk_name"),
        F.lit(" FOREIGN KEY ("), F.col("_child_cols"), F.lit(") REFERENCES "), parent,
        F.lit("("), F.col("_parent_cols"), F.lit(");")))
    return agg.select(*g, drop.alias("drop_script"), create.alias("create_script"))


def foreign_key_columns(table_constraints: DataFrame, column_usage: DataFrame,
                        table_schema: str, table_name: str) -> DataFrame:
    """J-02: names of the columns of one table that take part in a FOREIGN KEY – the
    constraint catalogue joined with its column usage on (name, schema, table), filtered
    to the table. The result feeds ``profile(..., fks=...)``."""
    tc = table_constraints.where((F.col("table_schema") == table_schema)
                                 & (F.col("table_name") == table_name)
                                 & (F.col("constraint_type") == "FOREIGN KEY"))
    keys = ["constraint_name", "table_schema", "table_name"]
    return (tc.select(*keys).join(column_usage.select(*keys, "column_name"), keys)
              .select("column_name").distinct())


def column_catalog(columns: DataFrame, fks: DataFrame, keys: DataFrame) -> DataFrame:
    """M-04: one row per column with its foreign-key target and primary/unique flags.

    columns(schema_name, table_object_id, table_name, column_name, column_id, data_type,
    max_length, precision, scale, is_nullable, is_identity, has_default,
    default_definition); fks(fk_name, table_object_id, column_id, referenced_table_name,
    referenced_column_name, …); keys(table_object_id, column_name, constraint_name,
    is_primary_key, is_unique_key)."""
    fk = fks.select("table_object_id", "column_id", F.col("fk_name").alias("foreign_key_name"),
                    "referenced_table_name", "referenced_column_name")
    kc = (keys.groupBy("table_object_id", "column_name")
              .agg(F.max(F.col("is_primary_key").cast("int")).alias("is_primary_key"),
                   F.max(F.col("is_unique_key").cast("int")).alias("is_unique_key")))
    out = (columns.join(fk, ["table_object_id", "column_id"], "left")
                  .join(kc, ["table_object_id", "column_name"], "left"))
    return (out.withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(0)) == 1)
               .withColumn("is_unique_key", F.coalesce("is_unique_key", F.lit(0)) == 1))


def insertable_columns(catalog: DataFrame) -> DataFrame:
    """M-05: per column of the catalogue: ``given`` (not identity: the batch may bring it),
    ``optional`` (nullable or defaulted), ``inserted`` (no default, not a key column)."""
    return catalog.select(
        "schema_name", "table_name", "column_name", "column_id", "data_type",
        (~F.col("is_identity")).alias("given"),
        (F.col("is_nullable") | F.col("has_default")).alias("optional"),
        (~F.col("has_default") & ~F.col("is_primary_key") & ~F.col("is_unique_key"))
        .alias("inserted"))


def insert_rows(batch: DataFrame, catalog_rows, *, order=None, start_id: int = 1,
                existing: DataFrame | None = None, keys=None):
    """M-06: the rows the generated insert routine would write: given columns from the
    batch, defaults for missing ones, NOT NULL and keys checked. Returns (rows, errors).

    Keys are those flagged in the catalogue (``is_primary_key``, ``is_unique_key``) or
    ``keys``, a list of :class:`KeyConstraint`. Rows that repeat a key of the target or of an
    earlier row (in ``order``) are refused with the names of the constraints.

    Identity values that the batch brings are kept (S-08); rows without one get the next
    values in ``order``, after the largest of ``start_id - 1``, the ids of the target
    (``existing``) and those supplied. Batch columns that the table lacks are refused.

    ``catalog_rows``: collected catalogue rows of ONE table (bounded by its column count)
    with column_name, data_type, is_nullable, is_identity, default_definition.
    """
    cols = sorted(catalog_rows, key=lambda r: r["column_id"])
    names = [r["column_name"] for r in cols]
    unknown = [c for c in batch.columns if c not in names]
    if unknown:
        raise ValueError(f"The table has no column {', '.join(unknown)}")
    identity = next((r for r in cols if r["is_identity"]), None)
    out = batch
    for r in cols:
        name = r["column_name"]
        if name in batch.columns:
            out = out.withColumn(name, F.col(quote_ident(name)).cast(r["data_type"]))
        elif not r["is_identity"]:
            dflt = r["default_definition"]
            val = F.expr(dflt) if dflt is not None else F.lit(None)
            out = out.withColumn(name, val.cast(r["data_type"]))
    rules = {f"{r['column_name']}_not_null": F.col(quote_ident(r["column_name"])).isNotNull()
             for r in cols if not r["is_nullable"] and not r["is_identity"]}
    good, bad = row_checks(out, rules) if rules else (out, out.where(F.lit(False)))
    if identity is not None:
        good = _identified(good, identity, batch.columns, order, start_id, existing)
    good = good.select(*[quote_ident(n) for n in names])
    keys = key_constraints(cols) if keys is None else keys
    if not keys:
        return good, bad
    good, clashing = enforce_keys(good, keys, order=order, existing=existing)
    return good, bad.unionByName(clashing, allowMissingColumns=True)


def _identified(rows, identity, given, order, start_id, existing):
    """``rows`` with an identity value each: supplied ones kept, the others numbered on."""
    name, kind = identity["column_name"], identity["data_type"]
    col = F.col(quote_ident(name))
    top = [start_id - 1]
    if existing is not None:
        top.append(existing.agg(F.max(col)).first()[0] or 0)        # one scalar
    order = order or [c for c in given if c != name][:1]
    if name not in given:
        return assign_sequential_ids(rows, order, name, max(top) + 1, kind)
    top.append(rows.agg(F.max(col)).first()[0] or 0)                # one scalar
    new = assign_sequential_ids(rows.where(col.isNull()).drop(name), order, name, max(top) + 1, kind)
    return rows.where(col.isNotNull()).unionByName(new)


def append_rows(batch: DataFrame, catalog_rows, target: str, *, order=None, start_id: int = 1,
                fmt: str = "parquet", keys=None):
    """M-06 with the append itself: ``insert_rows`` numbered on from the ids of the table at
    path ``target`` (none yet: from ``start_id``), written in one append job. Returns
    (rows written, errors)."""
    from tablewright.sources.csv_loader import move_to_target
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    existing = spark.read.format(fmt).load(target) if there else None
    rows, bad = insert_rows(batch, catalog_rows, order=order, start_id=start_id, existing=existing, keys=keys)
    return move_to_target(rows, target, fmt=fmt), bad
