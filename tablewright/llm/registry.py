"""Queries ``opN_<name>``: each applies its operator to the whole of its table.

``QUERIES`` are callables of (spark, folder of the tables); ``ORACLE`` holds DuckDB SQL for
the queries that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import bpe, exact_dedup, hard_negatives, jaccard_join, language_id, mixing, passage_dedup, periodic_runs, pii, quality_model, quality_rules, simhash_dedup, suffix_dedup
from tablewright.llm.common import documents, embeddings, labels, rest_of


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d)),
r AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM w) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM r, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws) AS n_words,
         length(array_to_string(ws, '')) AS word_chars,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda w: lower(w) IN (
           'the', 'of', 'and', 'to', 'a', 'in', 'is', 'that', 'it', 'for', 'was', 'on', 'with',
           'as', 'be', 'by', 'are', 'this', 'at', 'from', 'der', 'die', 'und', 'den', 'von',
           'das', 'zu', 'mit', 'sich', 'des', 'für', 'auf', 'ist', 'nicht', 'dem', 'im', 'ein',
           'eine', 'als', 'de', 'la', 'le', 'et', 'les', 'en', 'un', 'du', 'une', 'que', 'pour',
           'est', 'par', 'dans', 'qui', 'sur', 'pas', 'avec', 'au', 'el', 'y', 'los', 'del',
           'se', 'las', 'por', 'con', 'su', 'no', 'para', 'es', 'al', 'lo'))) AS n_stop
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
         AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1
         AND n_stop / n_words >= 0.05 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM m
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_digest_columns() -> list:
    return ["doc_id", F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path())
    return coded.select(*token_digest_columns())


def quality_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_model.Model:
    """The model of the labelled rows whose crc32 of the id, modulo four, is not two."""
    return quality_model.fit(docs, labels(spark, sf_dir), rest_of("id", 4) != 2)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    score = quality_model.score_column(docs, quality_fit(spark, docs, sf_dir))
    scored = docs.select("doc_id", (rest_of("doc_id", 4) == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_dedup(documents(spark, sf_dir), shingle=3, distance=2)
    return found.select("doc_id", simhash_dedup.hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: ~s["disguised"])
    kinds = {f"n_{k}": F.size(F.filter("spans", lambda s: (s["kind"] == k) & ~s["disguised"])).cast("long")  # noqa: B023
             for k in pii.KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in kinds.items()],
                        F.sha2(pii.span_list(base), 256).alias("base_sha256"),
                        F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"),
                        pii.span_list(F.col("spans")).alias("spans"))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class by passages in common, and a passage that joins it."""
    return passage_dedup.passage_classes(documents(spark, sf_dir)).withColumnRenamed("other_id", "other_doc_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), size=100, with_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, rest_of("id", 3) != 1)
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (rest_of("doc_id", 3) == 1).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


#: Target shares of words; the domain of low quality has none.
MIX_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: Words wanted, against the fewest at which no domain with a share loses any: what documents
#: lose for a small posterior of the domain without one is made up for.
MIX_MARGIN = 1.1


def domain_labels(docs: DataFrame, sf_dir: str) -> DataFrame:
    """The labelled table: language of the rows labelled good, ``low`` for the others."""
    marks = labels(docs.sparkSession, sf_dir).filter("quality is not null").select("doc_id", "quality")
    return docs.select("doc_id", "lang").join(marks.hint("merge"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("lang")).otherwise("low").alias("domain"))


def mixer(docs: DataFrame, sf_dir: str) -> mixing.Mixer:
    return mixing.fit(docs, domain_labels(docs, sf_dir), MIX_WEIGHTS, margin=MIX_MARGIN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixer(documents(spark, sf_dir), sf_dir).rated_fitted()


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir), gram=4, percent=85)


WORD_GAP = r"[\x20\x09-\x0D]+"


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The query's texts: with h = crc32(doc_id) divisible by ten, each word i >= a is word
    a + (i - a) % p, where g = h / 10, a = g % n, p = 1 + (n - a) / (3 + g % 8)."""
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).select(
        "doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, F.filter(
            F.split("text", WORD_GAP), lambda w: w != "")).alias("words"))
    placed = words.withColumn("n", F.size("words").cast("long")).withColumn("a", F.expr("g % n")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(words, (w, i) -> "
                  "if(i < a, w, element_at(words, cast(a + (i - a) % p as int) + 1))), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated_tails(documents(spark, sf_dir)), min_length=12)
    best = found.withColumn("best", F.when(F.size("runs") > 0, periodic_runs.longest_run(F.col("runs"))))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.run_list(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir), F.col("id") % 100 == 0, label=moved)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_quality_model": op4_quality_model,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_passage_dedup": op7_passage_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op1_quality_rules": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
}
