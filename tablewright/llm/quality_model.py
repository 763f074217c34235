"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: of bytes (3), of the shape of the text (4 changes of
character class) and of words (1 and 2; two equal words in a row share one feature). Class
log-count ratios come from all labelled rows of the training part. The indicators scaled by
these ratios and brought to unit length are the input of a linear hinge-loss model, fitted
by dual coordinate descent on at most ``MAX_FIT_ROWS`` labelled rows of each class (those
with the smallest hash of the id), in one task. A logistic curve through the margins of the
fitting rows turns a margin into a score.

Defined cases: a null text counts as empty; a text without features is scored by the
intercept; rows without a label or an id teach nothing; with one class only or none at all
every score is that class's value or 0.5; repeated rows are scored alike, each keeps its row,
and a labelled row that repeats counts as often as it is there; texts of any length are read
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import column_bytes, fresh, mix64, pick, quoted, slices, text_lengths

MAX_FIT_ROWS = 3000            # of each class
SLICE_BYTES = 1 << 20
BYTE_BITS, SHAPE_BITS, WORD_BITS, PAIR_BITS = 16, 14, 15, 14
SHAPE0 = 1 << BYTE_BITS
WORD0 = SHAPE0 + (1 << SHAPE_BITS)
PAIR0 = WORD0 + (1 << WORD_BITS)
SIZE = PAIR0 + (1 << PAIR_BITS)
REPEAT = SIZE - 1              # two equal words in a row

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = np.arange(256, dtype=np.uint8)       # punctuation stands for itself
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[[9, 11, 12, 13]] = ord(" ")
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _fold(parts, bits: int) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.int32)


def word_hashes(raw: np.ndarray, off: np.ndarray):
    """64-bit hashes of the words (ASCII case folded) and the offsets of each text's words."""
    ink = ~_SPACE[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    begins[heads] = ink[heads]
    letters = _LOWER[raw[ink]].astype(np.uint64) + np.uint64(1)
    starts = np.flatnonzero(begins[ink])
    words = np.concatenate([[0], np.cumsum(begins)])[off]
    if not len(starts):
        return np.zeros(0, np.uint64), words
    place = np.arange(len(letters)) - np.repeat(starts, np.diff(np.append(starts, len(letters))))
    letters *= _PLACE[place & 63] + place.astype(np.uint64) // np.uint64(64) * np.uint64(2)
    return mix64(np.add.reduceat(letters, starts)), words


def feature_sets(raw: np.ndarray, off: np.ndarray):
    """For each text of a batch the sorted ids of its features."""
    wide = raw.astype(np.uint32)
    grams = _fold([wide[:-2], wide[1:-1], wide[2:]], BYTE_BITS) if len(raw) > 2 else np.zeros(0, np.int32)
    shape = _SHAPE[raw]
    change = np.ones(len(raw), bool)
    change[1:] = shape[1:] != shape[:-1]
    change[off[:-1][off[:-1] < len(raw)]] = True
    seq = shape[change].astype(np.uint32)
    seq_off = np.concatenate([[0], np.cumsum(change)])[off]
    shapes = SHAPE0 + _fold([seq[:-3], seq[1:-2], seq[2:-1], seq[3:]], SHAPE_BITS) if len(seq) > 3 else np.zeros(0, np.int32)
    words, word_off = word_hashes(raw, off)
    singles = WORD0 + (words >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    pairs = PAIR0 + (mix64(words[:-1] * np.uint64(3) + words[1:]) >> np.uint64(64 - PAIR_BITS)).astype(np.int32)
    pairs[words[:-1] == words[1:]] = REPEAT
    seen = np.zeros(SIZE, bool)
    for i in range(len(off) - 1):
        seen[grams[off[i]:max(off[i], off[i + 1] - 2)]] = True
        seen[shapes[seq_off[i]:max(seq_off[i], seq_off[i + 1] - 3)]] = True
        seen[singles[word_off[i]:word_off[i + 1]]] = True
        seen[pairs[word_off[i]:max(word_off[i], word_off[i + 1] - 1)]] = True
        ids = np.flatnonzero(seen)
        seen[ids] = False
        yield ids


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (intercept + sum(weight) / |ratio|) + shift)))"""

    ratio: np.ndarray
    weight: np.ndarray          # weight of the hinge-loss model times ratio
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        size = float(np.sqrt((r * r).sum()))
        return self.intercept + (float(self.weight[ids].sum()) / size if size else 0.0)

    def scores(self, sets) -> np.ndarray:
        m = np.array([self.margin(ids) for ids in sets])
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -500, 500)))


def dual_coordinate_descent(rows, values, labels, size, cost, epochs=30, seed=3):
    """Weights (last one: intercept) of the L2-regularised hinge loss; labels are +1 and -1,
    ``cost`` bounds the dual variable of each row. Stops when no gradient is left."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v, y = rows[i], values[i], labels[i]
            slope = y * (float(w[at] @ v) + w[size]) - 1
            pull = min(slope, 0) if alpha[i] <= 0 else max(slope, 0) if alpha[i] >= cost[i] else slope
            if abs(pull) < 1e-9:
                continue
            worst = max(worst, abs(pull))
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            w[at] += step * v
            w[size] += step
            alpha[i] = new
        if worst < 1e-3:
            break
    return w


def logistic_curve(margins, labels, rounds=50):
    """(slope, shift) of a logistic curve by Newton's method, with Platt's soft targets."""
    up = labels > 0
    n1, n0 = up.sum(), (~up).sum()
    target = np.where(up, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()],
                      [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(sets: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> Model:
    """The hinge-loss model of bounded rows (labels 0 and 1) and its score curve."""
    y = np.where(labels > 0, 1.0, -1.0)
    values = []
    for ids in sets:
        v = ratio[ids]
        size = np.sqrt((v * v).sum())
        values.append(v / size if size else v)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = dual_coordinate_descent(sets, values, y, SIZE, 10.0 * share * len(y))
    model = Model(ratio, w[:-1] * ratio, float(w[-1]))
    margins = np.array([model.margin(ids) for ids in sets])
    model.slope, model.shift = logistic_curve(margins, y)
    return model


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ratios over all rows (text, label), and the number of rows of each class."""
    def count(batches):
        counts, rows = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                label = batch.column("label").to_numpy()
                for y, ids in zip(label, feature_sets(*column_bytes(batch.column("text")))):
                    counts[y, ids] += 1
                    rows[y] += 1
        y, ids = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(y, [0, 1]).astype(np.int32)), pa.array(np.append(ids, [-1, -1]).astype(np.int32)),
             pa.array(np.append(counts[y, ids], rows))], ["label", "feature", "n"])

    found = train.mapInArrow(count, "label int, feature int, n long").groupBy("label", "feature").agg(
        F.sum("n").alias("n")).toPandas()          # two rows for each feature at most
    counts, rows = np.zeros((2, SIZE)), np.zeros(2, np.int64)
    own = found["feature"] >= 0
    counts[found["label"][own], found["feature"][own]] = found["n"][own]
    rows[found["label"][~own]] = found["n"][~own]
    p, q = 1 + counts[1], 1 + counts[0]
    return np.log((p / p.sum()) / (q / q.sum())), rows


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", most: int = MAX_FIT_ROWS) -> Model:
    """Learn from the labelled rows of ``docs`` whose ``id`` satisfies ``trainable``.

    The texts of the labelled part are shuffled once, for the counts; the fitting rows are
    chosen by id before their texts are read and are the only ones that meet in a task.
    """
    marks = pick(labels, id=id_col, label=label_col).filter("id is not null and label in (0, 1)").filter(
        trainable).select("id", F.col("label").cast("int").alias("label"))
    texts = pick(docs, id=id_col, text=text_col).filter("id is not null").filter(trainable).select(
        "id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a merge join at every size: the labels grow with the documents
    ratio, rows = log_count_ratios(texts.join(marks.hint("merge"), "id").select("text", "label"))
    if not rows.all():
        value = 0.0 if not rows.any() else 50.0 if rows[1] else -50.0
        return Model(ratio * 0, ratio * 0, value)
    # the bounded sample is chosen among the labels, so that no text is shuffled for it
    # (picked by hash first, so that an ordered limit has little to order)
    chosen = [marks.filter((F.col("label") == y) & (F.pmod(F.xxhash64("id"), F.lit(max(1, int(rows[y]) // most))) == 0))
              .orderBy(F.xxhash64("id", F.lit(y)), "id").limit(most) for y in (0, 1)]
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").select("id", "text", "label")

    def learn(batches):
        sets, ys, ids = [], [], []
        for whole in batches:
            ids += whole.column("id").to_pylist()
            ys += whole.column("label").to_pylist()
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                sets += [s.astype(np.int32) for s in feature_sets(*column_bytes(batch.column("text")))]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i], sets[i].tobytes()))
        if order:
            m = fit_rows([sets[i] for i in order], np.array([ys[i] for i in order]), ratio)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m.weight.tobytes()]), pa.array([m.intercept]), pa.array([m.slope]), pa.array([m.shift])],
                ["weight", "intercept", "slope", "shift"])

    got = sample.repartition(1).mapInArrow(          # bounded: two classes of ``most`` rows
        learn, "weight binary, intercept double, slope double, shift double").first()
    return Model(ratio, np.frombuffer(got.weight), got.intercept, got.slope, got.shift)


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(
        (model.ratio.astype(np.float32), model.weight.astype(np.float32), model.intercept, model.slope, model.shift))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        m = Model(*held.value)
        whole = pa.RecordBatch.from_arrays([text], ["text"])
        out = [np.zeros(0)]
        for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
            out.append(m.scores(feature_sets(*column_bytes(batch.column("text")))))
        return pa.array(np.concatenate(out))

    return score(F.coalesce(quoted(docs, text_col).cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below the threshold; all columns as they are."""
    name = fresh(docs, "_score")
    return docs.withColumn(name, score_column(docs, model, text_col)).filter(
        F.col(name) >= threshold).drop(name)
