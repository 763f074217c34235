"""Language identification by nearest centroid.

Every byte with its two neighbours (letters folded, other ASCII as space) is a trigram,
hashed to ``SIZE`` features. Term frequencies are logarithmic, document frequencies come
from all training rows, vectors have unit length. The rows of each language (a sample of
about ``MAX_FIT_ROWS``, chosen by a hash of the id) are clustered by spherical k-means into
several centroids in a task of their own; a text gets the language of the centroid of the
highest cosine, and is marked ``rejected`` when it is farther from that centroid than nearly
all the rows that formed it.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text of unknown
trigrams alone gets the language of most rows with score 0 and is rejected; rows without a
language or an id teach nothing; without any training row every text is ``und``; of equally
near centroids the one of the language of most rows wins; repeated rows are judged alike and
each keep their row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import column_bytes, fresh, pick, quoted, slices, text_lengths

SIZE = 4096
MAX_FIT_ROWS = 1000            # of each language, about
CENTROIDS = 3
ROWS_AT_ONCE = 256
SLICE_BYTES = 1 << 20
UNDECIDED = "und"

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def blocks(batch: pa.RecordBatch, name: str = "text"):
    """Pieces of a batch with few rows and few bytes."""
    for part in slices(batch, text_lengths(batch, name), SLICE_BYTES):
        for at in range(0, part.num_rows, ROWS_AT_ONCE):
            yield part.slice(at, ROWS_AT_ONCE)


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Trigram counts, one row for each text."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros((n, SIZE), np.float32)
    c = _FOLD[raw]
    upper = (raw >= 0x80) & (raw <= 0x9E)          # second byte of a capital of Latin-1
    upper[1:] &= raw[:-1] == 0xC3
    upper[0] = False
    c[upper] += 0x20
    before, after = np.empty_like(c), np.empty_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    some = off[:-1] < off[1:]
    before[off[:-1][some]] = 0x20
    after[off[1:][some] - 1] = 0x20
    h = (before * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    key = (h >> np.uint32(20)).astype(np.int64) + SIZE * np.repeat(np.arange(n), np.diff(off))
    blank = (before == 0x20) & (c == 0x20) & (after == 0x20)
    return np.bincount(key[~blank], minlength=n * SIZE).reshape(n, SIZE).astype(np.float32)


def vectors(raw, off, idf) -> np.ndarray:
    x = np.log1p(counts(raw, off)) * idf
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


@dataclass
class Model:
    languages: list[str]           # of each centroid; the language of most rows comes first
    idf: np.ndarray
    centroids: np.ndarray
    nearest: np.ndarray            # lowest cosine that is not rejected, of each centroid


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15):
    """Unit centroids of unit vectors, started far apart from each other."""
    mean = x.mean(axis=0)
    centres = [x[int(np.argmax(x @ mean))]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.stack(centres).T).max(axis=1)))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c, np.argmax(x @ c.T, axis=1)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of all training rows each trigram occurs, and the number of rows."""
    def count(batches):
        df, n = np.zeros(SIZE, np.int64), 0
        for whole in batches:
            for part in blocks(whole):
                df += (counts(*column_bytes(part.column("text"))) > 0).sum(axis=0)
                n += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, SIZE, dtype=np.int32)), pa.array(np.append([n], df))], ["feature", "n"])

    got = train.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE + 1, np.int64)
    out[got["feature"] + 1] = got["n"]
    return out[1:], int(out[0])


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", most: int = MAX_FIT_ROWS, clusters: int = CENTROIDS) -> Model:
    """Learn from the rows whose ``id`` satisfies ``trainable`` and whose language is known."""
    train = pick(docs, id=id_col, text=text_col, lang=lang_col).filter(
        "id is not null and lang is not null").filter(trainable).select(
        "id", "lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(SIZE, np.float32), np.zeros((0, SIZE), np.float32), np.zeros(0))
    df, n = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        text = pa.array(pdf["text"], pa.string())
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        x = np.concatenate([vectors(*column_bytes(p.column("text")), idf) for p in blocks(batch)])
        x = x[np.lexsort(x[:, :8].T)]               # rows come in any order
        c, own = spherical_kmeans(x, clusters)
        cos = (x * c[own]).sum(axis=1)
        low = [float(np.quantile(cos[own == i], 0.005)) if (own == i).any() else 1.0 for i in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [r.astype(np.float32).tobytes() for r in c],
                             "low": low})

    every = F.lit(1)
    for lang, rows in sizes.items():
        every = F.when(F.col("lang") == lang, F.lit(max(1, -(-rows // most)))).otherwise(every)
    sample = train.filter(F.pmod(F.xxhash64("id"), every) == 0)
    got = sample.groupBy("lang").applyInPandas(learn, "lang string, centroid binary, low double").collect()
    got = sorted(got, key=lambda r: (-sizes[r.lang], r.lang, r.centroid))
    return Model([r.lang for r in got], idf,
                 np.stack([np.frombuffer(r.centroid, np.float32) for r in got]) if got else np.zeros((0, SIZE), np.float32),
                 np.array([0.9 * r.low for r in got]))


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    plain = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122) & (raw < 128)
    upto = np.concatenate([[0], np.cumsum(plain)])
    found = upto[off[1:]] > upto[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(ch.isalpha() for ch in raw[off[i]:off[i + 1]].tobytes().decode("utf-8", "ignore"))
    return found


def predict(model: Model, raw, off):
    """(centroid or -1, score, rejected) of each text."""
    n = len(off) - 1
    if not model.languages:
        return np.full(n, -1), np.zeros(n), np.ones(n, bool)
    cos = vectors(raw, off, model.idf) @ model.centroids.T
    best = np.argmax(cos, axis=1)
    score = np.clip(cos[np.arange(n), best].astype(np.float64), 0, 1)
    rejected = (score < model.nearest[best]) | (score == 0)
    lettered = has_letter(raw, off)
    return np.where(lettered, best, -1), np.where(lettered, score, 0.0), rejected | ~lettered


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected (columns of these names are replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(text: pa.Array) -> pa.Array:
        m = held.value
        names = np.array([*m.languages, UNDECIDED], object)
        lang, score, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
        for part in blocks(pa.RecordBatch.from_arrays([text], ["text"])):
            at, s, r = predict(m, *column_bytes(part.column("text")))
            lang += names[at].tolist()
            score.append(s)
            rejected.append(r)
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))],
            ["lang", "score", "rejected"])

    name = fresh(docs, "_found")
    out = docs.withColumn(name, run(F.coalesce(quoted(docs, text_col).cast("string"), F.lit(""))))
    return out.withColumns({"lang_pred": F.col(name)["lang"], "lang_score": F.col(name)["score"],
                            "lang_rejected": F.col(name)["rejected"]}).drop(name)
