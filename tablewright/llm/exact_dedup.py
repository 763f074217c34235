"""Exact deduplication against an immutable snapshot.

Rows come as a snapshot and a new batch. Texts are represented by their SHA-256. The
distinct digests of the snapshot are dealt to buckets of bounded size, and each bucket gets
one static binary fuse filter. The distinct digests of the batch (its own duplicates are
grouped before) pass the filter of their bucket; what the filter denies is new for sure,
the rest joins the exact digests of the snapshot. Every group of two and more is then
checked byte for byte.

Defined cases: a null text counts as empty; empty texts equal each other; of equal texts the
row with the largest id stays (a null id is smaller than any other); of repeated rows with
one id and one text exactly one stays; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm import fuse_filter
from tablewright.llm.common import fresh, materialize, pick, quoted
from tablewright.operators.keys import key_screen, may_hold

BUCKET_KEYS = 1 << 16      # digests per filter
HOT_GROUPS = 1000          # groups with over 1/1000 of the rows are salted: fewer than 1000
HOT_SALTS = 256


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(key), 20), F.lit(buckets)).cast("int")


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter): one binary fuse filter for the digests of each bucket."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse_filter.build(keys)]})

    keyed = groups.select(F.xxhash64("digest").alias("key"))
    return keyed.withColumn("bucket", _bucket("key", buckets)).groupBy("bucket").applyInPandas(
        one, "bucket int, filter binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``groups`` with ``maybe``: False where the filter of the bucket denies the digest."""
    names = groups.columns

    def one(fpdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        maybe = np.zeros(len(pdf), bool) if not len(fpdf) else fuse_filter.contains(
            fpdf["filter"].iloc[0], keys)
        return pdf[["digest", "key"]].assign(maybe=maybe)

    keyed = groups.select("digest", F.xxhash64("digest").alias("key")).withColumn(
        "bucket", _bucket("key", buckets))
    flags = filters.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInPandas(
        one, "digest string, key long, maybe boolean").select("digest", "maybe")
    return groups.join(flags, "digest").select(*names, "maybe")


def merged_groups(rows: DataFrame) -> DataFrame:
    """(digest, n, top, screened) over rows (id, digest, is_new) of snapshot and batch."""
    old, new = _groups(rows.filter("not is_new")), _groups(rows.filter("is_new"))
    old = materialize(old, "snapshot")
    new = materialize(new, "batch")
    buckets = max(1, math.ceil(max(old.count(), new.count()) / BUCKET_KEYS))
    screened = materialize(screen(new, build_filters(old, buckets), buckets), "screened")
    sure = screened.filter("not maybe").select("digest", "n", "top", F.lit("new").alias("screened"))
    held = old.alias("o").join(screened.filter("maybe").alias("b"), "digest", "full").select(
        "digest",
        (F.coalesce(F.col("o.n"), F.lit(0)) + F.coalesce(F.col("b.n"), F.lit(0))).alias("n"),
        F.greatest("o.top", "b.top").alias("top"),
        F.when(F.col("o.n").isNull(), "new").when(F.col("b.n").isNull(), "snapshot")
        .otherwise("both").alias("screened"))
    return held.unionByName(sure)


def unequal_digests(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests shared by texts that differ in a byte (none, as far as anyone knows).

    The members of each group meet by digest; a group is clean when its smallest and its
    largest text are the same. Groups with over 1/1000 of all rows (fewer than 1000, so
    their broadcast is bounded) are salted, and their parts meet as two texts each.
    """
    several = groups.filter("n > 1").select("digest", "n")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = several.filter(F.col("n") * HOT_GROUPS > F.lit(total)).select("digest", F.lit(True).alias("hot"))
    texts = pick(docs, id=id_col, text=text_col).select(
        "id", F.coalesce("text", F.lit("")).alias("text"), text_digest(F.col("text")).alias("digest"))
    # a screen of the repeated digests, of fixed size: texts without a copy are not shuffled
    texts = may_hold(texts, ["digest"], key_screen(several, ["digest"]), "_maybe").filter("_maybe").drop("_maybe")
    texts = texts.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(HOT_SALTS))).otherwise(F.lit(0).cast("long")))
    wanted = several.join(F.broadcast(hot), "digest", "left").select("digest", F.explode(
        F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(HOT_SALTS - 1).cast("long")))
        .otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    parts = texts.join(wanted, ["digest", "salt"]).groupBy("digest", "salt").agg(
        F.min("text").alias("lo"), F.max("text").alias("hi"))
    return parts.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(
        "lo != hi").select("digest")


def _keyed(docs: DataFrame, id_col: str, text_col: str, is_new: Column) -> DataFrame:
    return materialize(pick(docs, id=id_col, text=text_col).select(
        "id", text_digest(F.col("text")).alias("digest"), is_new.alias("is_new")), "digests")


def _byte_checked(docs, rows, id_col, text_col):
    """Groups whose key is the digest, followed by the text itself for unequal digests."""
    groups = materialize(merged_groups(rows), "groups")
    bad = materialize(unequal_digests(docs, groups, id_col, text_col), "unequal")
    return groups, None if bad.isEmpty() else bad


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                is_new: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, screened.

    ``is_new`` tells batch rows from snapshot rows (over the columns ``id`` and ``text``);
    by default rows are dealt to the two by a hash of the id.
    """
    is_new = F.pmod(F.xxhash64("id"), F.lit(2)) == 1 if is_new is None else is_new
    rows = _keyed(docs, id_col, text_col, is_new)
    groups, bad = _byte_checked(docs, rows, id_col, text_col)
    if bad is not None:
        rows, groups = _regrouped(docs, rows, groups, bad, id_col, text_col, is_new)
    copies = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    joined = copies.join(groups, "digest").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(
        F.col("id").alias(id_col), F.col("top").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("top")) & (F.col("copy") == 1)).alias("kept"),
        F.substring("digest", 1, 64).alias("text_sha256"), "screened")


def _regrouped(docs, rows, groups, bad, id_col, text_col, is_new):
    """Where a digest is shared by different texts: that digest with the text is the key."""
    texts = pick(docs, id=id_col, text=text_col).select(
        "id", F.coalesce("text", F.lit("")).alias("text"), text_digest(F.col("text")).alias("digest"),
        is_new.alias("is_new"))
    apart = texts.join(bad, "digest", "left_semi").select(
        "id", F.concat("digest", F.lit(":"), "text").alias("digest"), "is_new")
    rows = rows.join(bad, "digest", "left_anti").unionByName(apart)
    exact = _groups(apart).withColumn("screened", F.lit("both"))
    return rows, groups.join(bad, "digest", "left_anti").unionByName(exact)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; all columns as they are.

    Rows meet the winners by digest and id, so the rows of one large group are spread.
    """
    decided = exact_dedup(docs, id_col, text_col).filter("kept").select(
        F.col("text_sha256").alias("_w_digest"), F.col(id_col).alias("_w_id"))
    digest = fresh(docs, "_digest")
    keyed = docs.withColumn(digest, text_digest(quoted(docs, text_col)))
    won = keyed.join(decided.distinct(), (keyed[digest] == F.col("_w_digest"))
                     & quoted(keyed, id_col).eqNullSafe(F.col("_w_id")), "left_semi")
    return won.dropDuplicates([digest, id_col]).select(*[quoted(won, c) for c in docs.columns])
