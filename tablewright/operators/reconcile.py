"""Desired-vs-actual reconciliation (C-01 … C-08).

Everything is a keyed join (shuffle on the keys; AQE broadcasts a side only when its
runtime size is under the broadcast threshold). ``MERGE INTO`` is not used: file tables do
not support it, and the result of an upsert is written as one new table version instead.

Two rules hold for all of them. Keys are compared null-safe: a NULL key equals a NULL key.
A key repeated in ``desired`` stands for one row, the first by the order of all its other
columns (NULLs first); where ``actual`` repeats a key, every such row counts as that key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import quote_ident
from tablewright.session import materialize, scratch_dir

CREATE, REPLACE, KEEP, EXTRA = "create", "replace", "keep", "extra"
DUPLICATE, AMBIGUOUS = "duplicate", "ambiguous"


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def _differs(compare) -> Column:
    """Any compared column differs, NULLs compared as values (null-safe)."""
    parts = [~F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}")) for c in compare]
    return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)


def _one_row_per_key(df: DataFrame, keys, compare, flag: str) -> DataFrame:
    """Collapse ``df`` to one row per key (count + values), with partial aggregation, so a
    key repeated in a third of all rows costs one row per task and joins stay 1:1."""
    return (df.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias(f"_n_{flag}"),
                   *[F.max(F.col(c)).alias(c) for c in compare]))


def reconcile(desired: DataFrame, actual: DataFrame, keys, compare=(),
              report_extra: bool = False) -> DataFrame:
    """(keys…, action): create when the key is absent from ``actual``; replace when any
    ``compare`` column differs (null-safe); keep otherwise. With ``report_extra`` the keys
    only present in ``actual`` are listed as 'extra'. A key given more than once in
    ``desired`` is reported once as 'duplicate'; a key held more than once by ``actual``
    as 'ambiguous' (neither is compared). Both sides are reduced to one row per key before
    the join, so the join is one-to-one whatever the key distribution."""
    keys, compare = _keys(keys), list(compare)
    d = _one_row_per_key(desired, keys, compare, "d").alias("d")
    a = _one_row_per_key(actual, keys, compare, "a").alias("a")
    how = "full" if report_extra else "left"
    j = d.join(a, [F.col(f"d.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys], how)
    action = (F.when(F.col("d._n_d") > 1, F.lit(DUPLICATE))
               .when(F.col("a._n_a") > 1, F.lit(AMBIGUOUS))
               .when(F.col("a._n_a").isNull(), F.lit(CREATE))
               .when(F.col("d._n_d").isNull(), F.lit(EXTRA))
               .when(_differs(compare), F.lit(REPLACE))
               .otherwise(F.lit(KEEP)))
    key_cols = [F.coalesce(F.col(f"d.{k}"), F.col(f"a.{k}")).alias(k) for k in keys]
    return j.select(*key_cols, action.alias("action"))


def _same_keys(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """``left`` joined to ``right`` on null-safe equality of ``keys`` (left side kept as it
    is; for inner and outer joins the right side brings its other columns only)."""
    r = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(r[f"_k_{k}"]) for k in keys]
    out = left.join(r, on, how)
    return out.drop(*[f"_k_{k}" for k in keys])


def _first_per_key(df: DataFrame, keys) -> DataFrame:
    """One row per key: the smallest by the other columns in order, a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return (df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
              .select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]))


def upsert_by_key(actual: DataFrame, desired: DataFrame, keys) -> DataFrame:
    """C-04/C-07 (apply): rows of ``actual`` whose key is not desired, plus one desired row
    per key – the table after replacing by key."""
    keys = _keys(keys)
    desired = _first_per_key(desired.select(*actual.columns), keys)
    kept = _same_keys(actual, desired.select(*keys), keys, "left_anti")
    return kept.unionByName(desired)


apply_reconcile = upsert_by_key


def upsert_by_any_key(actual: DataFrame, desired: DataFrame, key_sets) -> DataFrame:
    """C-06 (N-26 fixed): an actual row is replaced when it matches a desired row on ANY of
    the key sets (for job steps: the step id, or the step name); all desired rows are
    then added. One anti join per key set. A key with a NULL part identifies no step and
    matches nothing here."""
    kept = actual
    for keys in key_sets:
        keys = _keys(keys)
        given = desired.select(*keys).where(
            reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])).distinct()
        kept = _same_keys(kept, given, keys, "left_anti")
    return kept.select(*actual.columns).unionByName(desired.select(*actual.columns).distinct())


def insert_if_absent(actual: DataFrame, desired: DataFrame, keys) -> DataFrame:
    """C-01/C-03/C-08: the existing rows stay as they are; of the desired rows whose key is
    absent one per key is added."""
    keys = _keys(keys)
    desired = _first_per_key(desired.select(*actual.columns), keys)
    new = _same_keys(desired, actual.select(*keys).distinct(), keys, "left_anti")
    return actual.unionByName(new)


def assign_sequential_ids(df: DataFrame, order, id_col: str, start: int = 1,
                          id_type: str = "bigint") -> DataFrame:
    """Number the rows of ``df`` start, start+1, … in ``order`` without a global window.

    The rows are range-sorted, ties in the order of a hash of the whole row, and written
    once to the shared checkpoint folder (lineage cut; the stored partition ids and
    positions stay fixed). A task that is retried sorts the same rows the same way, and a
    value repeated in a third of all rows is spread over several ranges. Per-partition
    counts – one row per partition – give each partition its offset, joined back by
    broadcast (bounded by the number of partitions of the sort), and
    ``monotonically_increasing_id`` gives the position inside it.
    """
    order = _keys(order)
    spark = df.sparkSession
    scratch_dir(spark)  # makes sure a checkpoint location is registered
    tie = F.xxhash64(*[F.col(quote_ident(c)) for c in df.columns])
    ranked = materialize(df.orderBy(*order, tie)
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    counts = sorted((r["_pid"], r["n"]) for r in
                    ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for pid, n in counts:
        offsets.append((pid, run))
        run += n
    starts = spark.createDataFrame(offsets, "_pid int, _offset bigint")
    in_part = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranked.join(F.broadcast(starts), "_pid")
                  .withColumn(id_col, (F.lit(start) + F.col("_offset") + in_part).cast(id_type))
                  .drop("_pid", "_mid", "_offset"))


def get_or_assign_ids(desired: DataFrame, actual: DataFrame, keys, id_col: str) -> DataFrame:
    """C-05: (keys…, id_col), one row per key: the existing id when the key exists (the
    smallest, if ``actual`` repeats the key), else the next free ids (max existing id + 1,
    + 2, … in key order). A NULL key is a key. See :func:`assign_sequential_ids`."""
    keys = _keys(keys)
    existing = actual.groupBy(*keys).agg(F.min(id_col).alias(id_col))
    wanted = desired.select(*keys).distinct()
    found = _same_keys(wanted, existing, keys, "inner").select(*keys, id_col)
    new = _same_keys(wanted, existing.select(*keys), keys, "left_anti")
    max_id = actual.agg(F.max(id_col)).first()[0] or 0  # one scalar
    dtype = actual.schema[id_col].dataType.simpleString()
    return found.unionByName(assign_sequential_ids(new, keys, id_col, max_id + 1, dtype))


def render_template(steps: DataFrame, references: DataFrame, lookup_keys, *,
                    template_col: str = "command", placeholder: str = "{{EnvRefId}}",
                    value_col: str = "reference_id") -> DataFrame:
    """C-06: fill ``placeholder`` in ``template_col`` with the value found by looking the
    step's ``lookup_keys`` up in ``references``. A step whose text does not hold the
    placeholder stays as it is. One that does, without exactly one reference (or with a
    NULL id), gets a NULL command and an error text."""
    lookup_keys = _keys(lookup_keys)
    # one row per lookup key: a step never pairs with several references
    ref = references.groupBy(*lookup_keys).agg(F.count(F.lit(1)).alias("_refs"),
                                               F.max(value_col).alias("_value"))
    j = _same_keys(steps, ref, lookup_keys, "left")
    asks = F.coalesce(F.contains(F.col(template_col), F.lit(placeholder)), F.lit(False))
    ambiguous = F.coalesce(F.col("_refs") > 1, F.lit(False))
    missing = asks & (F.col("_value").isNull() | ambiguous)
    rendered = F.replace(F.col(template_col), F.lit(placeholder), F.col("_value").cast("string"))
    return (j.withColumn("error", F.when(missing, F.concat_ws(
                 "", F.when(ambiguous, F.lit("several references for "))
                      .otherwise(F.lit("no reference for ")),
                 F.concat_ws("/", *[F.col(k).cast("string") for k in lookup_keys]))))
             .withColumn(template_col, F.when(missing, F.lit(None).cast("string"))
                                         .when(asks, rendered).otherwise(F.col(template_col)))
             .withColumn(value_col, F.when(asks, F.col("_value")))
             .drop("_refs", "_value"))
