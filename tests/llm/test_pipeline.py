"""Each stage against a plain computation on its own input, nulls and repeats included."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tablewright.llm import registry
from test_simhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(rows in, rows out) of each stage, on the documents with some odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900_001, None, "en", "x", 0), (900_002, "", "en", "x", 0), (900_003, "ab " * 30_000, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(5))
    out = {}
    for name, stage in P.STAGES:
        after = P.materialize(stage(spark, docs, SF), name)
        if name != "bpe":
            assert after.columns == docs.columns
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_rejected_rows_go(spark, stages):
    before, after = stages["quality_classifier"]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
    model = registry.quality_fit(spark, docs, SF)
    scored = docs.withColumn("s", P.quality_model.score_column(docs, model)).collect()
    assert Counter(r.doc_id for r in scored if r.s >= 0.7) == Counter(r.doc_id for r in after)
    assert 0 < len(after) < len(before)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sum(i in kept for i, q in marks.items() if q == 1) >= 0.97 * sum(q == 1 for q in marks.values())


def test_one_row_of_equal_texts(stages):
    before, after = stages["exact_dedup"]
    top = {}
    for r in before:
        top[r.text or ""] = max(top.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(top.values())


def test_one_row_of_near_copies(stages):
    before, after = stages["simhash_near_dedup"]
    want = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in want.values()})


def test_mixed(spark, stages):
    before, after = stages["mixing"]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
    times = {r.doc_id: r.copies for r in registry.mixer(docs, SF).rated(docs).collect()}
    assert Counter(r.doc_id for r in after) == Counter(times)
    assert set(times) == {r.doc_id for r in before}


def test_tokens(stages):
    before, after = stages["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in before:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or ""), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.token_ids)) for r in after) == want


def test_run_and_empty(spark, tmp_path):
    assert P.run(spark, SF).count() > 100
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
