"""Runs of repeated words: every maximal stretch with a period, found by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are the same) that is at
least ``min_length`` and two periods long and that no neighbouring word extends with that
period. Periods below ``SHORT`` are read off by direct lag scans. Longer ones are searched by
scale: for periods q in [2k, 4k) the k-grams of a text are hashed, and each window of k + 1
places names its smallest k-gram. A window at the start of a run and the window one period on
hold the same words, so their minimizers are q apart and equal; such pairs seed an extension
to both sides, word by word.

k-grams that have a period of at most k/2 themselves lie inside a run of a smaller scale and
come last in the order of minimizers. Equal k-grams without such a period are more than k/2
apart, so a minimizer has at most eight partners in reach of its scale. A longer run whose
windows hold nothing but periodic k-grams consists of the neighbouring parts of two touching
runs of one small period; these runs' ends seed it.

Defined cases: a null text has no words, no runs and an empty collapsed text, like an empty
one; a null id is kept; repeated rows each have a row; an empty table gives an empty result;
other columns are ignored, whatever their names. Texts of any length are searched whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.blobs import sliding_minima
from tablewright.llm.common import mix64, pick, slices, text_lengths

SHORT = 32                 # periods below this (or twice the least length) by direct lag scans
SLICE_BYTES = 2 << 20      # text searched together
LF = b"\n"


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of True with at least ``least`` places."""
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    if len(same) and same[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(same)]])
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


def _matching(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch [a, b) around place ``at`` on which words ``lag`` apart are the same."""
    b, step, top = at, 64, len(words) - lag
    while b < top:
        end = min(top, b + step)
        apart = words[b:end] != words[b + lag:end + lag]
        if apart.any():
            b += int(apart.argmax())
            break
        b, step = end, step * 2
    a, step = at, 64
    while a > 0:
        low = max(0, a - step)
        apart = (words[low:a] != words[low + lag:a + lag])[::-1]
        if apart.any():
            a -= int(apart.argmax())
            break
        a, step = low, step * 2
    return a, b


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def _smallest(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of the period is a period of words[start:end] (two periods long:
    by the theorem of Fine and Wilf no other smaller period is possible)."""
    for p in _prime_factors(period):
        d = period // p
        if (words[start:start + period - d] == words[start + d:start + period]).all() and \
                (words[start:end - d] == words[start + d:end]).all():
            return False
    return True


class Found:
    """Runs found so far, each once, as (start, end, period)."""

    def __init__(self, words: np.ndarray, min_length: int):
        self.words, self.min_length, self.runs, self.tried = words, min_length, [], {}

    def stretch(self, a: int, b: int, q: int) -> None:
        if b - a >= q and b - a + q >= self.min_length and _smallest(self.words, a, b + q, q):
            self.runs.append((a, b + q, q))

    def seed(self, at: int, q: int) -> None:
        """Extends places ``at`` and ``at + q``; places of a stretch tried before are left."""
        known = self.tried.setdefault(q, [])
        if any(a <= at < b for a, b in known):
            return
        a, b = _matching(self.words, at, q)
        if a < b:
            known.append((a, b))
            self.stretch(a, b, q)


def _short(found: Found, top: int) -> None:
    words = found.words
    for q in range(1, top + 1):
        a, b = stretches(words[:-q] == words[q:], max(q, found.min_length - q))
        for s, e in zip(a.tolist(), b.tolist()):
            found.stretch(s, e, q)


def _scale(found: Found, k: int, grams: np.ndarray) -> None:
    """Seeds for the periods in [2k, 4k); ``grams`` are the hashes of all k-grams."""
    runs = [r for r in found.runs if r[2] <= k // 2 and r[1] - r[0] >= k]
    inside = np.zeros(len(grams) + 1, np.int32)
    for s, e, _ in runs:
        inside[s] += 1
        inside[e - k + 1] -= 1
    periodic = np.cumsum(inside[:-1]) > 0
    rank = np.where(periodic, grams | np.uint64(1 << 63), grams & np.uint64((1 << 63) - 1))
    places = np.unique(sliding_minima(rank, k + 1))
    places = places[~periodic[places]]
    order = np.lexsort((places, grams[places]))
    places = places[order]
    hashes = grams[places]
    ahead = 1
    while ahead < len(places):
        near = hashes[ahead:] == hashes[:-ahead]
        lag = places[ahead:] - places[:-ahead]
        near &= lag < 4 * k
        if not near.any():
            break
        hit = np.flatnonzero(near & (lag >= 2 * k))
        for at, q in zip(places[hit].tolist(), lag[hit].tolist()):
            found.seed(at, q)
        ahead += 1
    _touching(found, runs, k)


def _touching(found: Found, runs: list, k: int) -> None:
    """Seeds from pairs of runs (s, e), (t, f) of one period d with s < t <= e: a longer run
    made of their neighbouring parts either starts at s and repeats from a place in [t, e],
    or repeats from t."""
    words, by_period = found.words, {}
    for s, e, d in runs:
        by_period.setdefault(d, []).append((s, e))
    for d, some in by_period.items():
        some.sort()
        for (s, e), (t, f) in zip(some, some[1:]):
            if t > e or e - s < 2 * k - d or f - t < 2 * k - d:
                continue
            for place in range(t, e + 1):
                if 2 * k <= place - s < 4 * k:
                    found.seed(s, place - s)
            first = max(s, t - 4 * k + 1)
            for place in range(first, min(first + d, t - 2 * k + 1)):
                if (words[place:place + d] == words[t:t + d]).all():
                    for at in range(place, t - 2 * k + 1, d):
                        found.seed(at, t - at)


def find(words: np.ndarray, longest: int, min_length: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of ``words`` (numbers), sorted by start and period.

    ``words`` may hold several texts that no number is shared across the borders of;
    ``longest`` is the length of the longest one.
    """
    found = Found(words, min_length)
    if not len(words):
        return []
    short = SHORT                       # k-grams that a reported run may hold are no shorter than it
    while short < 2 * min_length:
        short *= 2
    _short(found, min(short - 1, longest // 2))
    grams, k, power = mix64(words.astype(np.uint64)), 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while 4 * k <= longest and len(grams) > k:
            if 2 * k >= short:
                _scale(found, k, mix64(grams))
            grams = grams[:len(grams) - k] * power + grams[k:]
            power, k = power * power, 2 * k
    return sorted(set(found.runs), key=lambda r: (r[0], r[2]))


def _numbered(texts: list) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Words of all texts, their numbers with one number of its own after each text, the
    start of each text in the numbers, and the number of words of the longest text."""
    split = [t.split() if t else [] for t in texts]     # bytes.split knows ASCII blanks alone
    flat = [w for words in split for w in words]
    codes = pd.factorize(np.array(flat + [None], object)[:-1])[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.cumsum(sizes + 1) - sizes - 1
    out = np.empty(len(flat) + len(split), np.int64)
    word = np.ones(len(out), bool)
    word[starts + sizes] = False
    out[word] = codes
    out[~word] = len(flat) + np.arange(len(split))
    return split, out, starts, int(sizes.max(initial=0))


def collapse(texts: list, min_length: int):
    """For each text (bytes or None) its runs and the text with each run cut to one period."""
    split, words, starts, longest = _numbered(texts)
    per_text = [[] for _ in texts]
    found = find(words, longest, min_length)
    if found:
        owner = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
        for (s, e, q), i in zip(found, owner.tolist()):
            per_text[i].append((s - int(starts[i]), e - s, q))
    kept = []
    for runs, own in zip(per_text, split):
        if runs:
            drop = np.zeros(len(own) + 1, np.int64)
            for s, length, q in runs:
                drop[s + q] += 1
                drop[s + length] -= 1
            own = [w for w, d in zip(own, np.cumsum(drop).tolist()) if not d]
        kept.append(b" ".join(own))
    return per_text, kept, [len(s) for s in split]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              min_length: int = 12) -> DataFrame:
    """One row per row: id, n_words, runs (start, length, period; by start, then period) and
    collapsed: the words without those that a run holds after its first period, joined by
    one blank."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                runs, kept, sizes = collapse(batch.column("text").cast(pa.binary()).to_pylist(), min_length)
                flat = [x for own in runs for x in own]
                columns = [pa.array([x[i] for x in flat], pa.int64()) for i in range(3)]
                offsets = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(RUN)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()), listed,
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"])

    rows = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                                 "collapsed string")
    return found.withColumnRenamed("id", id_col)


def longest_run(runs):
    """The run of greatest length (ties: smallest start, then period) of a column of runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period"))


def run_list(runs):
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
