"""Property tests: invariants that must hold for any input."""

import os
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tablewright.operators.profile import domain_analysis, profile, value_counts
from tablewright.operators.reconcile import reconcile, upsert_by_key
from tablewright.sources.csv_loader import read_csv_staged

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

small_text = st.one_of(st.none(), st.sampled_from(["", " ", "a", "A", "b ", "12", "x,y"]))
small_int = st.one_of(st.none(), st.integers(-3, 3))


@SETTINGS
@given(st.lists(st.tuples(small_text, small_int), min_size=1, max_size=30))
def test_profile_and_domain_invariants(spark, rows):
    df = spark.createDataFrame(rows, "t string, i int")
    res = profile(df)
    for r in res.profile.collect():
        assert r["no_distinct"] <= r["row_count"] - r["no_nulls"]
        assert r["row_count"] == len(rows)
    dom = domain_analysis(value_counts(df, ["t", "i"])).collect()
    for name in ("t", "i"):
        part = [r for r in dom if r["domain_name"] == name]
        assert sum(r["domain_counter"] for r in part) == len(rows)
        total = sum(float(r["domain_percent"]) for r in part)
        assert abs(total - 100.0) <= 0.00005 * len(part) + 1e-9


keyed = st.dictionaries(st.integers(0, 20), st.tuples(small_text, small_int), max_size=15)


@SETTINGS
@given(keyed, keyed)
def test_reconcile_apply_reconcile_keeps(spark, desired, actual):
    schema = "k int, v string, w int"
    d = spark.createDataFrame([(k, *v) for k, v in desired.items()], schema)
    a = spark.createDataFrame([(k, *v) for k, v in actual.items()], schema)
    after = upsert_by_key(a, d, "k")
    actions = {r["action"] for r in reconcile(d, after, "k", ["v", "w"]).collect()}
    assert actions <= {"keep"}
    assert after.count() == len(set(desired) | set(actual))


line = st.lists(st.sampled_from(["1", "x", "", "2.5", "ab"]), min_size=1, max_size=5).map(",".join)


@SETTINGS
@given(st.lists(line, min_size=0, max_size=25))
def test_csv_read_plus_rejected_is_lines(spark, lines):
    target = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b", "c")])
    folder = tempfile.mkdtemp(prefix="tw-prop-")
    with open(os.path.join(folder, "f.csv"), "w") as fh:
        fh.write("a,b,c\n" + "".join(x + "\n" for x in lines))
    good, rejects = read_csv_staged(spark, folder, target)
    n_good, n_bad = good.count(), rejects.count()
    kept = [x for x in lines if x != ""]          # blank lines are skipped by the reader
    assert n_good + n_bad == len(kept)
    assert n_bad == sum(1 for x in kept if len(x.split(",")) != 3)


@SETTINGS
@given(st.sets(st.text("abcde", min_size=1, max_size=3), max_size=20),
       st.dictionaries(st.text("abcde", min_size=1, max_size=3), st.integers(0, 50), max_size=10))
def test_assigned_ids_unique_and_contiguous(spark, wanted, existing):
    from tablewright.operators.reconcile import get_or_assign_ids
    if not wanted:
        return
    ids = {}
    for k, v in existing.items():          # existing ids must be unique per key and overall
        if v not in ids.values():
            ids[k] = v
    actual = spark.createDataFrame(list(ids.items()) or [("zzz", 0)], "name string, id bigint")
    desired = spark.createDataFrame([(w,) for w in wanted], "name string")
    got = {r["name"]: r["id"] for r in get_or_assign_ids(desired, actual, "name", "id").collect()}
    assert set(got) == wanted
    base = max(ids.values()) if ids else 0
    new = sorted(v for k, v in got.items() if k not in ids)
    assert new == list(range(base + 1, base + 1 + len(new)))
    assert all(got[k] == ids[k] for k in wanted if k in ids)


@SETTINGS
@given(st.lists(st.tuples(small_int, small_text), max_size=30))
def test_row_checks_split_every_row_once(spark, rows):
    from pyspark.sql import functions as F
    from tablewright.operators.checks import row_checks
    df = spark.createDataFrame(rows, "i int, t string")
    good, bad = row_checks(df, {"i_positive": F.col("i") > 0, "t_present": F.col("t").isNotNull()})
    assert good.count() + bad.count() == len(rows)
    expected_bad = sum(1 for i, t in rows if (i is not None and i <= 0) or t is None)
    assert bad.count() == expected_bad
