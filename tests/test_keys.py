"""Key constraints: what inserting row by row would keep, and foreign keys in one reading."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import keys as K
from tablewright.operators.catalog import append_rows, insert_rows
from tablewright.operators.checks import check_referential_integrity
from tablewright.operators.keys import ForeignKey, KeyConstraint, check_foreign_keys, enforce_keys, key_constraints


def one_by_one(batch, existing, constraints):
    """Insert row by row; (accepted, [(row, names of the keys that were taken)])."""
    held = {c.name: {tuple(r[x] for x in c.columns) for r in existing} for c in constraints}
    there = {n: set(v) for n, v in held.items()}
    good, bad = [], []
    for r in batch:
        key = {c.name: tuple(r[x] for x in c.columns) for c in constraints}
        target = [c.name for c in constraints if key[c.name] in there[c.name] or (c.primary and None in key[c.name])]
        earlier = [c.name for c in constraints if key[c.name] in held[c.name]]
        if target or earlier:
            bad.append((r["n"], target or earlier))
        else:
            good.append(r["n"])
            for c in constraints:
                held[c.name].add(key[c.name])
    return sorted(good), sorted(bad)


@pytest.mark.parametrize("seed", range(4))
def test_keys_as_inserted_one_by_one(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, *range(9)])
    rows = [{"n": i, "a": pick(), "b": pick(), "c": rng.randrange(25)} for i in range(120)]
    old = [{"n": -i, "a": pick(), "b": pick(), "c": 100 + i} for i in range(1, 6)]
    constraints = [KeyConstraint("pk", ("c",), True), KeyConstraint("ab", ("a", "b")), KeyConstraint("bc", ("b", "c"))][:1 + seed % 3]
    schema = "n int, a int, b int, c int"
    good, bad = enforce_keys(spark.createDataFrame(rows, schema).repartition(3), constraints, order="n",
                             existing=spark.createDataFrame(old, schema))
    want = one_by_one(rows, old, constraints)
    assert sorted(r.n for r in good.collect()) == want[0]
    assert sorted((r.n, r.failed_rules) for r in bad.collect()) == want[1]
    assert bad.columns[-2:] == ["failed_rules", "failed_rules_text"]


def test_chain_of_refusals(spark):
    """A refused row stands in nobody's way: 0 blocks 1, so 2 stays, and 2 blocks 3."""
    rows = [(i, i // 2, (i + 1) // 2) for i in range(11)]
    good, bad = enforce_keys(spark.createDataFrame(rows, "n int, a int, b int"),
                             [KeyConstraint("ua", ("a",)), KeyConstraint("ub", ("b",))], order="n")
    assert sorted(r.n for r in good.collect()) == [0, 2, 4, 6, 8, 10]
    assert {r.n: r.failed_rules for r in bad.collect()} == {1: ["ua"], 3: ["ua"], 5: ["ua"], 7: ["ua"], 9: ["ua"]}


def test_equal_rows_other_types_and_empty(spark):
    batch = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (3000000000, "q")], "k long, v string")
    pk = [KeyConstraint("pk", ("k",), True)]
    old = spark.createDataFrame([(2,)], "k int")          # a narrower type than the batch's
    good, bad = enforce_keys(batch, pk, existing=old)
    assert sorted(r.k for r in good.collect()) == [1, 3000000000]
    assert sorted((r.v, r.failed_rules_text) for r in bad.collect()) == [("x", "pk"), ("y", "pk"), ("z", "pk")]
    good, bad = enforce_keys(batch.limit(0), pk, existing=old)
    assert good.count() == bad.count() == 0
    good, bad = enforce_keys(batch, [])
    assert good.count() == 5 and bad.count() == 0


CATALOG = [
    {"column_id": 1, "column_name": "id", "data_type": "bigint", "is_nullable": False, "is_identity": True,
     "default_definition": None, "is_primary_key": True, "is_unique_key": False},
    {"column_id": 2, "column_name": "code", "data_type": "string", "is_nullable": False, "is_identity": False,
     "default_definition": None, "is_primary_key": False, "is_unique_key": True},
]


def test_append_rows_enforces_the_flagged_keys(spark, tmpdir_path):
    assert key_constraints(CATALOG) == [KeyConstraint("primary_key", ("id",), True), KeyConstraint("unique_code", ("code",))]
    target = f"{tmpdir_path}/codes"
    first = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "code string")
    written, bad = append_rows(first, CATALOG, target, order=["code"])
    assert written == 2
    assert sorted(r.failed_rules_text for r in bad.collect()) == ["code_not_null", "unique_code"]
    again = spark.createDataFrame([("b", 1), ("c", 3), ("d", 77)], "code string, id long")
    written, bad = append_rows(again, CATALOG, target)
    assert written == 1 and {r.code: r.failed_rules for r in bad.collect()} == {
        "b": ["primary_key", "unique_code"], "c": ["primary_key"]}
    assert sorted(r.code for r in spark.read.parquet(target).collect()) == ["a", "b", "d"]


def test_composite_keys_from_the_key_catalogue():
    rows = [{"constraint_name": "uq", "column_name": "x", "is_primary_key": False},
            {"constraint_name": "pk", "column_name": "id", "is_primary_key": True},
            {"constraint_name": "uq", "column_name": "y", "is_primary_key": False}]
    assert key_constraints([], rows) == [KeyConstraint("uq", ("x", "y")), KeyConstraint("pk", ("id",), True)]


def test_insert_rows_without_keys_is_as_before(spark):
    plain = [{k: v for k, v in r.items() if not k.endswith("_key")} for r in CATALOG]
    rows, bad = insert_rows(spark.createDataFrame([("a",), ("a",)], "code string"), plain)
    assert rows.count() == 2 and bad.count() == 0


def _orphan_case(spark, n=400):
    rng = random.Random(1)
    child = spark.createDataFrame(
        [(i, rng.choice([None, *range(60)]), rng.randrange(40), rng.choice(["u", "v", None]), rng.randrange(3)) for i in range(n)]
        + [(7, 1, 1, "u", 1)] * 3, "n int, a int, b long, c string, d int")
    pa = spark.createDataFrame([(i,) for i in range(0, 55)] * 2, "ka long")
    pb = spark.createDataFrame([(i, x) for i in range(38) for x in "uv"], "kb int, kc string")
    pd = spark.createDataFrame([(0,), (1,)], "kd int")
    return child, [ForeignKey("fa", ("a",), pa, ("ka",)), ForeignKey("fbc", ("b", "c"), pb, ("kb", "kc")),
                   ForeignKey("fd", ("d",), pd, ("kd",))]


@pytest.mark.parametrize("bits", [K.SCREEN_BITS, 15])
def test_foreign_keys_against_one_anti_join_each(spark, monkeypatch, bits):
    """With a screen of one row many orphan keys pass it; the result is the same."""
    monkeypatch.setattr(K, "SCREEN_BITS", bits)
    if bits == 15:      # keys fall on three bits
        monkeypatch.setattr(K, "_spot", lambda cols: F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(3)))
    child, fks = _orphan_case(spark)
    want = {}
    for fk in fks:
        for r in check_referential_integrity(child, fk.parent, list(fk.columns), list(fk.parent_columns)).collect():
            want.setdefault(tuple(r), []).append(fk.name)
    got = check_foreign_keys(child, fks)
    assert got.columns == child.columns + ["broken_constraints"]
    rows = got.collect()
    assert {tuple(r)[:-1]: r.broken_constraints for r in rows} == {
        k: [f.name for f in fks if f.name in v] for k, v in want.items()}
    orphans = child.where(F.col("n").isin([k[0] for k in want])).collect()
    assert len(rows) == len([r for r in orphans if tuple(r) in want])


def test_three_constraints_read_the_child_once(spark, tmpdir_path):
    child, fks = _orphan_case(spark)
    child.write.parquet(f"{tmpdir_path}/child")
    seen = K._screened(spark.read.parquet(f"{tmpdir_path}/child"), fks)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/child") == 1 or plan.count("FileScan parquet") == 1
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3 and "Python" not in plan


def test_empty_sides_of_a_foreign_key(spark):
    child, fks = _orphan_case(spark)
    assert check_foreign_keys(child.limit(0), fks).count() == 0
    nothing = ForeignKey("none", ("d",), fks[2].parent.limit(0), ("kd",))
    assert check_foreign_keys(child, [nothing]).count() == child.count()
    assert check_foreign_keys(child, []).count() == 0
