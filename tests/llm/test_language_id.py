import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import language_id as L, registry
from tablewright.llm.common import rest_of

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = registry.QUERIES["op9_language_id"](spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.n_chars >= 50]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert np.mean([r.rejected for r in held]) < 0.1
    assert all(0 <= r.score <= 1 for r in rows)


def plain_vectors(texts, idf):
    """TF-IDF of one text at a time, by a dictionary of trigrams."""
    out = np.zeros((len(texts), L.SIZE))
    for row, text in zip(out, texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        for f in np.flatnonzero(L.counts(raw, np.array([0, len(raw)]))[0]) if len(raw) else []:
            row[f] = np.log1p(L.counts(raw, np.array([0, len(raw)]))[0][f]) * idf[f]
        row /= np.linalg.norm(row) or 1
    return out


def test_query_against_plain_centroids(spark):
    """Document frequencies, clusters and cosines recomputed one text at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in registry.QUERIES["op9_language_id"](spark, sf).collect()}
    train = [r for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None]
    seen = sum((L.counts(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0] > 0).astype(int)
               for r in train)
    idf = np.log((1 + len(train)) / (1 + seen)) + 1
    best = {}
    for lang in sorted({r.lang for r in train}):
        x = plain_vectors([r.text for r in train if r.lang == lang], idf).astype(np.float32)
        centroids, own = L.spherical_kmeans(x[np.lexsort(x[:, :8].T)], L.CENTROIDS)
        assert np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-4) and len(set(own)) > 1
        for i, v in zip(rows, plain_vectors([r.text for r in rows.values()], idf)):
            best.setdefault(i, []).append((float((v @ centroids.T).max()), lang))
    for i, found in best.items():
        score, lang = max(found)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(ch.isalpha() for ch in rows[i].text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert abs(got[i].score - score) < 1e-3
            assert got[i].lang_pred == lang or max(found)[0] - sorted(found)[-2][0] < 1e-3


def test_counts_of_a_batch_are_those_of_each_text():
    texts = ["", "a", "É é", "  ", "Hello World", "x" * 900, "", "ñandú!"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    both = L.counts(np.frombuffer(b"".join(raw), np.uint8), off)
    for r, row in zip(raw, both):
        assert (L.counts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] == row).all()
    assert (L.counts(np.frombuffer("ÉA".encode(), np.uint8), np.array([0, 3])) == L.counts(
        np.frombuffer("éa".encode(), np.uint8), np.array([0, 3]))).all()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, score string"
    data = [(i, "the cat and the dog of that house", "en", 1, "x") for i in range(40)]
    data += [(100 + i, "der hund und die katze von dem haus", "de", 1, "x") for i in range(20)]
    data += [(200, None, "en", 1, "x"), (201, "12 34 !?", "en", 1, None), (202, "", None, 1, "x"), (None, "the cat", "de", 1, "x"),
             (203, "ж", None, 1, "x"), (204, "und die " * 30_000, None, 1, "x"), (204, "und die", None, 1, "x"), (205, "日本", "en", 1, "x")]
    df = spark.createDataFrame(data, schema)
    m = L.fit(df, rest_of("id", 3) != 1)
    got = L.identify(df, m)
    rows = got.collect()
    assert len(rows) == len(data)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "en" for i in range(40)) and all(by[100 + i].lang_pred == "de" for i in range(20))
    assert by[200].lang_pred == by[201].lang_pred == by[202].lang_pred == "und" and by[200].lang_score == 0
    assert by[203].lang_pred == "en" and by[203].lang_rejected
    assert by[204].lang_pred == "de" and by[205].lang_pred in ("en", "de")
    assert L.identify(df.limit(0), m).count() == 0
    none = L.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
