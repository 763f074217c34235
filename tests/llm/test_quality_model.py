import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import quality_model as Q, registry
from tablewright.llm.common import rest_of

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    df = registry.QUERIES["op4_quality_model"](spark, SF)
    assert df.count() == 1000
    rows = df.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) >= 0.95
    assert np.mean([1 - r.predicted for r in bad]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_query_against_plain_counts(spark):
    """Ratios counted one text at a time; scores are those of the fitted weights and curve."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    train = [i for i in docs if marks.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2]
    sets = {i: next(iter(Q.feature_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))) for i, t in docs.items()}
    counts = np.ones((2, Q.SIZE))
    for i in train:
        counts[marks[i], sets[i]] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    model = registry.quality_fit(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert np.allclose(model.ratio, ratio)
    order = sorted(train, key=lambda i: (i, marks[i]))          # fewer rows than the bound: all of them
    plain = Q.fit_rows([sets[i].astype(np.int32) for i in order], np.array([marks[i] for i in order]), ratio)
    assert np.allclose(model.weight, plain.weight, atol=1e-9) and abs(model.intercept - plain.intercept) < 1e-9
    for r in registry.QUERIES["op4_quality_model"](spark, sf).collect():
        size = np.sqrt((ratio[sets[r.doc_id]] ** 2).sum())
        margin = (plain.weight[sets[r.doc_id]].sum() / size if size else 0.0) + plain.intercept
        score = 1 / (1 + np.exp(-(plain.slope * margin + plain.shift)))
        assert abs(r.score - score) < 1e-4 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["", "a", "ab", "The the THE end.", "x " * 50, "é\n\tü  ", "   ", "1 2*** 3|", "", "q" * 300 + " " + "q" * 300]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    together = list(Q.feature_sets(np.frombuffer(b"".join(raw), np.uint8), off))
    for r, ids in zip(raw, together):
        alone = next(iter(Q.feature_sets(np.frombuffer(r, np.uint8), np.array([0, len(r)]))))
        assert alone.tolist() == ids.tolist()
    assert Q.REPEAT in together[3] and Q.REPEAT in together[4] and Q.REPEAT not in together[7]


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient on the dual of the same problem."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    y = np.where(x @ rng.normal(size=6) + 0.3 * rng.normal(size=40) > 0, 1.0, -1.0)
    rows = [np.arange(6)] * 40
    w = Q.dual_coordinate_descent(rows, list(x), y, 6, np.full(40, 0.7), epochs=2000)
    z = np.hstack([x, np.ones((40, 1))]) * y[:, None]
    a = np.zeros(40)
    for _ in range(200_000):
        a = np.clip(a - 0.002 * (z @ (z.T @ a) - 1), 0, 0.7)
    assert np.allclose(w, z.T @ a, atol=1e-2)


def test_edges(spark):
    schema = "doc_id long, text string, quality int, score double"
    data = [(i, "good words in a row number %d" % i, 1, 0.0) for i in range(30)]
    data += [(100 + i, "### $$$ ### %d $$$" % i, 0, 0.0) for i in range(30)]
    data += [(200, None, None, None), (None, "", 1, 0.0), (201, "", 1, 0.0), (201, "", 1, 0.0), (202, "z " * 200_000, None, None)]
    df = spark.createDataFrame(data, schema)
    marks = df.select("doc_id", "quality").unionByName(spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    m = Q.fit(df, marks, rest_of("id", 4) != 2)
    out = df.withColumn("s", Q.score_column(df, m)).collect()
    assert len(out) == len(data) and all(0 <= r.s <= 1 for r in out)
    assert all((r.s >= 0.7) == (r.quality == 1) for r in out if r.doc_id is not None and r.doc_id < 200)
    kept = Q.keep_rows(df, m)
    assert kept.columns == df.columns and kept.filter("doc_id < 100").count() == 30
    for some, value in ((marks.limit(0), 0.5), (marks.filter("quality = 1"), 1.0), (marks.filter("quality = 0"), 0.0)):
        m = Q.fit(df, some, F.lit(True))
        assert {round(r.s, 6) for r in df.withColumn("s", Q.score_column(df, m)).collect()} == {value}
    empty = df.limit(0)
    assert empty.withColumn("s", Q.score_column(empty, Q.fit(empty, marks, F.lit(True)))).count() == 0
