"""Row checks (P-10, C-09) and referential-integrity (orphan) reports (L-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(df: DataFrame, rules: dict[str, Column]):
    """Split ``df`` by named boolean rules: (good, bad). ``bad`` carries ``failed_rules``
    (array, rule order) and ``failed_rules_text`` (comma list). As with CHECK constraints a
    rule that evaluates to NULL passes; write ``c.isNotNull()`` for NOT NULL."""
    fails = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    marked = (df.withColumn("failed_rules", F.array_compact(F.array(*fails)))
                .withColumn("failed_rules_text", F.array_join("failed_rules", ",")))
    good = marked.where(F.size("failed_rules") == 0).drop("failed_rules", "failed_rules_text")
    bad = marked.where(F.size("failed_rules") > 0)
    return good, bad


def parameter_rules() -> dict[str, Column]:
    """The parameter table's constraints: type in (20, 30); reference type in (R, V);
    package name NULL exactly when type = 20; NOT NULL columns."""
    t, pkg = F.col("parameter_type"), F.col("package_name")
    return {
        "parameter_type_in_20_30": t.isin(20, 30),
        "reference_type_in_R_V": F.col("reference_type").isin("R", "V"),
        "package_null_iff_project": pkg.isNull() == (t == 20),
        "folder_name_not_null": F.col("folder_name").isNotNull(),
        "project_name_not_null": F.col("project_name").isNotNull(),
        "parameter_name_not_null": F.col("parameter_name").isNotNull(),
        "parameter_type_not_null": t.isNotNull(),
    }


def check_referential_integrity(child: DataFrame, parent: DataFrame, keys,
                                parent_keys=None) -> DataFrame:
    """L-10: child rows whose key has no parent row (what re-enabling a foreign key would
    reject). Child rows with a NULL key are not orphans. One anti join of the child, read
    once, against the distinct parent keys; a hot child key is split by the skew join."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    parent_keys = keys if parent_keys is None else (
        [parent_keys] if isinstance(parent_keys, str) else list(parent_keys))
    p = parent.select(*[F.col(pk).alias(f"_p{i}") for i, pk in enumerate(parent_keys)]).distinct()
    candidates = child.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]))
    return candidates.join(p, [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(keys)], "left_anti")
