import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, fuse_filter

SCHEMA = "doc_id long, text string, lang string, digest string, n int, id int"
ROWS = [(1, "a", "x", "d", 1, 1), (2, "a", None, None, 2, 1), (3, "", "x", "d", 1, 1),
        (4, None, "x", "d", 1, 1), (None, "a", "x", "d", 1, 1), (None, "q", "x", "d", 1, 1),
        (5, "b", "x", "d", 1, 1), (5, "b", "x", "d", 1, 1), (6, "b", "x", "d", 1, 1),
        (7, "c" * 300_000, "x", "d", 1, 1), (8, "c" * 300_000, "x", "d", 1, 1),
        (9, "z", "x", "d", 1, 1), (9, "z", "y", "d", 1, 1), (10, "A", "x", "d", 1, 1)]


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        seen = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0)):
            kept = i == top and not seen
            seen |= kept
            out.append((i, top, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows_and_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.exact_dedup(df)
    rows = [tuple(r)[:5] for r in got.collect()]
    assert sorted(rows, key=str) == expected(ROWS)


def test_split_does_not_matter(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for new in (F.lit(True), F.lit(False), F.col("id") > 4):
        rows = [tuple(r)[:5] for r in exact_dedup.exact_dedup(df, is_new=F.coalesce(new, F.lit(True))).collect()]
        assert sorted(rows, key=str) == expected(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(df).count() == 0
    assert exact_dedup.keep_rows(df).columns == df.columns


def test_keep_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.keep_rows(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:1]) for r in kept.collect() if r.doc_id) == [
        (2, "a"), (4, ""), (6, "b"), (8, "c"), (9, "z"), (10, "A")]
    assert [r.text for r in kept.filter("doc_id is null").collect()] == ["q"]


def test_unequal_texts_of_one_digest(spark, monkeypatch):
    """With a digest of eight values, only the byte checks keep texts apart."""
    weak = lambda text: F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 1)
    monkeypatch.setattr(exact_dedup, "text_digest", weak)
    data = [(i, f"t{i % 40}") for i in range(100)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    tops = {i % 40: i for i in range(100)}
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [
        (i, tops[i % 40], tops[i % 40] == i) for i in range(100)]


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    got = exact_dedup.exact_dedup(df)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000").count() == 1000


def test_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 100, 5000, 70_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        blob = fuse_filter.build(np.concatenate([keys, keys[:3]]))
        assert fuse_filter.contains(blob, keys).all()
        other = rng.integers(0, 2**63, 50_000).astype(np.uint64)
        assert fuse_filter.contains(blob, other).mean() < 0.001
        assert len(blob) <= 20 + max(64, n * 4)


def test_query_matches_sql(spark):
    import duckdb
    from oracle_check import digest
    from tablewright.llm import registry
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(registry.ORACLE["op2_exact_dedup"])
    df = registry.QUERIES["op2_exact_dedup"](spark, "/root/testdata/sf0.001")
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(
        [d[0] for d in cur.description], cur.fetchall())[0]
