"""From documents to token ids: rejects low quality, removes copies and near copies, mixes
the domains to target weights, encodes.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it to the shared
checkpoint folder and hands the reread table to the next stage, so that a lost executor
costs part of one stage. All stages but the last return the columns of ``documents``.
Mixing repeats rows of scarce domains; of the domain without a weight (text that the labelled
rows call bad) it keeps next to nothing.

Defined cases of the stages: a null text counts as empty, is scored like one, equals other
empty texts and has fingerprint zero and no tokens; of equal texts the row of the largest id
stays, of near ones that of the smallest (null ids last); repeated rows count as copies; a
stage of an empty table gives an empty table of its columns; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import bpe, exact_dedup, mixing, quality_model, registry, simhash_dedup
from tablewright.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_rows(docs, registry.quality_fit(spark, docs, sf_dir), threshold=0.7)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_rows(docs, shingle=3, distance=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, registry.mixer(docs, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs.select("doc_id", "text"), registry.vocabulary_path())
    return coded.select(*registry.token_digest_columns(), F.col("ids").alias("token_ids"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mix),
    ("bpe", tokens),
]

#: SQL has no classifier, fingerprints or merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
