"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. For each of ``HASHES`` hash functions the
Cartesian tree over the hashes cuts the sequence: the node at place ``c`` with the interval
``l..r`` stands for all subsequences within ``l..r`` that hold ``c``, and for all of them the
shingle at ``c`` is the minimum. Nodes of at least the wanted length are the compact
windows, about ``2 n / t`` for each function. Windows of equal minimum meet in one shuffle and
are linked in all pairs where they are few. Where a minimum is frequent (in boilerplate, in a
passage that many texts have), its texts meet by longer runs near it: two passages as similar
as wanted have 21 shingles in a row in common, hence one of the 14-shingle seeds chosen there.
Of texts that have 46 shingles in a row around a seed in common, the first is linked to each
and stands for them; it and all others are compared in pairs, unless they are known to have
such a run in common elsewhere. The links of two
texts are joined as intervals: a link counts when a link of another function fits in one
subsequence with it on both sides. Texts that keep links are fetched and verified: along the
diagonals of the links, stretches of common shingles are cut at gaps, and reported when the
Jaccard similarity of their shingle sets is at least ``similarity`` over ``words`` words; what
the cuts leave is searched by prefix sums over the matches and by windows of ``words`` words.

Equal texts take part once; the other copies are reported as copies of it. A map task sends
``FEW`` + 1 windows of a minimum at most, and of a seed what no other there stands for.

Defined cases: null, empty and short texts have no passage; ASCII capitals count as small;
repeats within one text are not reported; a null id comes after all others; repeated rows
give one pair; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.blobs import by_part, pack, rolling_hash, sliding_minima, small, stacked, unpack, wide
from tablewright.llm.common import column_bytes, materialize, mix64, pick, slices, text_lengths
from tablewright.llm.jaccard_join import joined_components
from tablewright.llm.quality_model import word_hashes
from tablewright.llm.suffix_dedup import _pack_text, _row_blocks, _unpacked

SHINGLE = 5
WORDS = 50                  # words of a passage
SIMILARITY = 0.8
HASHES = 6
AGREE = 2                   # hash functions that must fit together
DRIFT = 8                   # words by which a diagonal may shift
BAND = 32                   # words by which the diagonals of links that are compared differ
FEW = 16                    # windows of a minimum that are linked in all pairs; more meet by seeds
HUBS = 4                    # seeds that stand for others of their slice
RUN_SPREAD = 8              # neighbours of which one run tells texts that have it in common
CLEAR = 16                  # seeds compared until those that can't link are looked for again
NAMES = 8                   # runs of a text that tell texts linked already
HOT_BITS = 24               # bits that tell frequent minima
GAPS = (12, 6, 1)           # foreign shingles at which stretches are cut, in turn
SLICE_BYTES = 2 << 20
PART_BYTES = 16 << 20
MAX_PARTS = 20_000
TURNS = 2                   # times that one pair of every two components is verified before the rest
_BITS, _ODD = 28, 0x9E3779B
_BACK = pow(_ODD, -1, 1 << _BITS)


def shingles(raw: np.ndarray, off: np.ndarray):
    """Hashes of the five-word shingles of each text, one after another, and their offsets."""
    words, word_off = word_hashes(raw, off)
    counts = np.maximum(np.diff(word_off) - SHINGLE + 1, 0)
    every = mix64(rolling_hash(words, SHINGLE)) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
    starts = np.repeat(word_off[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return every[starts], np.concatenate([[0], np.cumsum(counts)])


def compact_windows(hashes: np.ndarray, off: np.ndarray, least: int):
    """(l, c, r) of all Cartesian tree nodes of at least ``least`` places (``r`` exclusive).

    The trees of all texts grow a level at a time by range-minimum queries on a sparse
    table. Equal hashes are ordered by scrambled places, so that repeats keep trees shallow.
    """
    n = len(hashes)
    if n >= 1 << _BITS:
        raise ValueError("a text of over 268 million words")
    low = np.uint64((1 << _BITS) - 1)
    place = (np.arange(n, dtype=np.uint64) * np.uint64(_ODD)) & low
    table = [(hashes & ~low) | place]
    longest = int(np.diff(off).max()) if len(off) > 1 else 0
    while 2 << (len(table) - 1) <= longest:
        half = 1 << (len(table) - 1)
        t = table[-1].copy()
        t[:-half] = np.minimum(t[:-half], t[half:])
        table.append(t)
    table = np.stack(table) if n else np.zeros((1, 0), np.uint64)
    lo, hi = off[:-1], off[1:]
    out = []
    while True:
        long_ = hi - lo >= least
        lo, hi = lo[long_], hi[long_]
        if not len(lo):
            break
        level = np.floor(np.log2(hi - lo)).astype(np.int64)
        level -= (1 << level) > hi - lo
        least_ = np.minimum(table[level, lo], table[level, hi - (1 << level)])
        c = (((least_ & low) * np.uint64(_BACK)) & low).astype(np.int64)
        out.append((lo, c, hi))
        lo, hi = np.concatenate([lo, c + 1]), np.concatenate([c, hi])
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def pair_links(key, dh, comp, l, c, r, k):
    """Links of windows sorted by key: every two of a key and of different components; and the
    keys of over ``FEW`` windows in several components, which have no links here."""
    n = len(key)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(head), n))
    last = np.repeat(np.cumsum(size), size)
    open_ = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
    a, b, ahead = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(open_):
        ahead += 1
        open_ = open_[open_ + ahead < last[open_]]
        some = open_[comp[open_] != comp[open_ + ahead]]
        a.append(some)
        b.append(some + ahead)
    a, b = np.concatenate(a), np.concatenate(b)
    return [dh[a], dh[b], k[a], c[a], l[a], r[a], c[b], l[b], r[b]], key[head][(size > FEW) & _several(comp, head)]


def _several(comp, head):
    """Which of the groups that start at ``head`` have several components."""
    starts = np.flatnonzero(head)
    other = comp != comp[starts][np.cumsum(head) - 1] if len(comp) else np.zeros(0, bool)
    return np.add.reduceat(other, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)


def common_run(least: int, similarity: float) -> int:
    """Shingles that two passages of ``least`` shingles at least have in a row, if none repeats:
    each break of what is common has foreign shingles, ``SHINGLE - 1`` on both sides at least."""
    enough = math.ceil(2 * least * similarity / (1 + similarity) - 1e-9)
    foreign = (1 - similarity) / similarity / (2 * (SHINGLE - 1))          # breaks for a common shingle
    return min(-(-m // (1 + int(m * foreign + 1e-9))) for m in range(enough, 20 * enough + 20))


def seed_size(run: int) -> tuple[int, int]:
    """Length of seeds, and of how many neighbours one is taken, so that each run has one."""
    seed = max(1, 2 * run // 3)
    return seed, run - seed + 1


def seed_places(h: np.ndarray, off: np.ndarray, seed: int, spread: int):
    """Hashes of all runs of ``seed`` shingles, and the places of those that are least of
    ``spread`` neighbours: a longer run common to two texts has one of them in both."""
    if len(h) < seed + spread - 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = mix64(rolling_hash(h, seed))
    least = sliding_minima(runs, spread)
    end = np.repeat(off[1:], np.diff(off))[:len(least)]
    return runs, np.unique(least[np.arange(len(least)) + spread + seed - 1 <= end])


def stretch_ends(key, doc, at, gap: int):
    """Indices of seeds without those between two equal ones that overlap them: of a stretch
    where a text repeats itself the first and the last seed meet what leads into it or out of it."""
    order = np.lexsort((at, key, doc))
    near = np.zeros(len(order) + 1, bool)
    near[1:-1] = (np.diff(at[order]) <= gap) & (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.sort(order[~(near[:-1] & near[1:])])


def run_names(h, off, at, doc, least: int):
    """For each seed ``NAMES`` hashes of runs of ``least`` shingles of its text: the least, by as
    many functions, of the runs with a seed in their middle (0: there is none)."""
    out = np.full((len(off) - 1, NAMES), np.uint32(0xFFFFFFFF))
    inside = (at - least // 2 >= off[doc]) & (at - least // 2 + least <= off[doc + 1])
    if inside.any():
        runs = rolling_hash(h, least)[at[inside] - least // 2]
        for t in range(NAMES):
            np.minimum.at(out[:, t], doc[inside], (mix64(runs ^ mix64(np.array([t + 1], np.uint64))) >> np.uint64(32)).astype(np.uint32))
    out[out == 0xFFFFFFFF] = 0
    return out[doc]


def hub_pairs(key, dh, around, names, run: int, least: int, enough: int, hubs=None):
    """Index pairs of seeds (sorted by key) that link, and which seeds no other stands for.

    The first seed of a key is compared with the others. One with ``least`` shingles in a row in
    common is linked to it, which stands for it from there on; the rest goes on with the next.
    Without ``hubs``, a number of first seeds, all are tried, and those are linked as well that
    have ``run`` shingles in a row and ``enough`` in all in common, shifted by ``DRIFT`` at most, if
    they have no common one of ``names``, the hashes of some runs of ``least`` shingles: by those
    they are linked already.
    """
    n = len(key)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(head)
    size = np.diff(np.append(starts, n))
    stay, a, b = np.ones(n, bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def link(hub, others):
        others = others[dh[others] != dh[hub]]
        a.append(np.full(len(others), hub))
        b.append(others)

    for s, m in zip(starts[size > 1].tolist(), size[size > 1].tolist()):
        rest, tried = np.arange(s, s + m), 0
        while len(rest) > 1 and (hubs is None or tried < hubs):
            hub, rest, tried = int(rest[0]), rest[1:], tried + 1
            row = common_rows(around, hub, rest)
            same = row >= least
            link(hub, rest[same])
            stay[rest[same]] = False
            if hubs is None:
                near = np.flatnonzero((row < least) & (row >= run) & (dh[rest] != dh[hub]))
                near = near[~((names[rest[near]] == names[hub]) & (names[hub] != 0)).any(axis=1)]
                if len(near):
                    link(hub, rest[near[near_hub(around, hub, rest[near], enough)]])
            rest = rest[~same]
    return np.concatenate(a), np.concatenate(b), stay


def _marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = (key & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _surroundings(key, comp, around):
    """The first of each key, component and surroundings, by place: the others link as it does."""
    row = around.astype(np.uint64)
    name = np.zeros(len(row), np.uint64)
    for i in range(row.shape[1]):
        name = mix64(name ^ row[:, i]) + np.uint64(i)
    order = np.lexsort((np.arange(len(key)), name, comp, key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, comp, name)], axis=0)
    return np.sort(order[new])


def common_rows(around, hub, others):
    """How many shingles in a row each of the others has in common with the hub around a seed."""
    half, mine, other = around.shape[1] // 2, around[hub], around[others]
    apart = (other != mine) | (mine == 0)
    left, right = apart[:, half - 1::-1], apart[:, half:]
    left = np.where(left.any(axis=1), left.argmax(axis=1), half)
    return left + np.where(right.any(axis=1), right.argmax(axis=1), half)


def near_hub(around, hub, others, enough: int):
    """Which of the others have ``enough`` shingles of the hub's, shifted by ``DRIFT`` at most,
    in one half of the places around (a least passage is not longer), and the hub as many of theirs."""
    mine, other = around[hub], around[others]
    wider, wide_mine = np.pad(other, ((0, 0), (DRIFT, DRIFT))), np.pad(mine, DRIFT)
    there, back = np.zeros(other.shape, bool), np.zeros(other.shape, bool)
    for d in range(2 * DRIFT + 1):
        there |= wider[:, d:d + len(mine)] == mine
        back |= other == wide_mine[d:d + len(mine)]
    return np.minimum(_most(there & (mine != 0), len(mine) // 2), _most(back & (other != 0), len(mine) // 2)) >= enough


def _most(there: np.ndarray, width: int) -> np.ndarray:
    """For each row the most marked places in ``width`` neighbours."""
    count = np.cumsum(np.pad(there, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    return (count[:, width:] - count[:, :-width]).max(axis=1)


def able(around, label, enough: int):
    """Which seeds of a key have ``enough`` shingles that seeds of other labels have as well."""
    keep = np.arange(len(label))
    while True:
        some = around[keep]
        at, i = np.nonzero(some)
        order = np.lexsort((label[keep][at], value := some[at, i]))
        value, who = value[order], label[keep][at][order]
        head = np.ones(len(value), bool)
        head[1:] = value[1:] != value[:-1]
        shared = np.zeros(len(at), bool)
        shared[order] = _several(who, head)[np.cumsum(head) - 1] if len(who) else False
        ok = np.bincount(at[shared], minlength=len(keep)) >= enough
        if ok.all():
            return keep
        keep = keep[ok]


def open_pairs(key, comp, around, run: int, least: int, enough: int):
    """Index pairs of seeds (sorted by key) of two components that may link.

    Each seed that has enough shingles in common with other components at all is compared with
    those, seeds of small components first. One with a passage of ``least`` shingles in common in
    the same places (``least`` in a row, or ``enough`` of them where the hub repeats none) is linked
    and its component is one with the hub's from there on. Of what then are two components those
    are linked as well that have ``run`` in a row and ``enough`` in all, shifted.
    """
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(head)
    size = np.diff(np.append(starts, len(key)))
    several = _several(comp, head)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, m in zip(starts[several].tolist(), size[several].tolist()):
        label = np.unique(comp[s:s + m], return_inverse=True)[1]
        mine = around[s:s + m]
        for joining in (True, False):                   # what is one component first, then what may be
            rest, turn = np.arange(m), 0
            while True:
                if turn % CLEAR == 0:
                    rest = rest[able(mine[rest], label[rest], enough)]
                turn += 1
                count = np.bincount(label[rest], minlength=m)
                if count.max() == len(rest):
                    break
                at = int(np.argmin(count[label[rest]]))
                hub, others = int(rest[at]), rest[label[rest] != label[rest[at]]]
                rest = np.delete(rest, at)
                row = common_rows(mine, hub, others)
                if joining:
                    alike = row >= least
                    own = mine[hub][mine[hub] != 0]
                    if len(np.unique(own)) == len(own):
                        alike |= _most((mine[others] == mine[hub]) & (mine[hub] != 0), least) >= enough
                    joined, first = np.unique(label[others[alike]], return_index=True)
                    a.append(np.full(len(first), s + hub))
                    b.append(s + others[alike][first])
                    label[np.isin(label, joined)] = label[hub]
                else:
                    near = others[row >= run]
                    near = near[near_hub(mine, hub, near, enough)]
                    a.append(np.full(len(near), s + hub))
                    b.append(s + near)
    return np.concatenate(a), np.concatenate(b)


def _clip(l, c, r):
    return np.maximum(l, c - 65_535), np.minimum(r, c + 65_535)


def distinct_links(cols):
    """Links (a, b, k, ca, la, ra, cb, lb, rb) without repeats: place and function tell a window."""
    a, b, k, ca, cb = cols[0], cols[1], cols[2], cols[3], cols[6]
    order = np.lexsort((cb, k, ca, b, a))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (a, b, k, ca, cb)], axis=0)
    return [x[order[new]] for x in cols]


def agreeing(a, b, k, ca, la, ra, cb, lb, rb, least: int, bands=None):
    """Which links (sorted by pair, band of diagonals and ``ca``) fit with enough links of other functions: both
    minima in both intervals, on both sides, with room for ``least`` shingles in common.

    Each link is compared with those after it until one starts beyond its interval.
    """
    n = len(a)
    fits = np.zeros((HASHES, n), bool)
    fits[k, np.arange(n)] = True
    new = np.zeros(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if bands is not None:
        new[1:] |= bands[1:] != bands[:-1]
    group, open_, d = np.cumsum(new), np.arange(n), 0
    while len(open_):
        d += 1
        open_ = open_[open_ + d < n]
        open_ = open_[(group[open_] == group[open_ + d]) & (ca[open_ + d] < ra[open_])]
        x, y = open_, open_ + d
        ok = np.ones(len(x), bool)
        for c, l, r in ((ca, la, ra), (cb, lb, rb)):
            lo, hi = np.maximum(l[x], l[y]), np.minimum(r[x], r[y])
            ok &= (lo <= np.minimum(c[x], c[y])) & (hi > np.maximum(c[x], c[y])) & (hi - lo >= least)
        fits[k[y[ok]], x[ok]] = True
        fits[k[x[ok]], y[ok]] = True
    return fits.sum(axis=0) >= AGREE


def run_links(texts: DataFrame, parts: int, least: int) -> DataFrame:
    """(a, b, ca, cb): texts that have ``least`` shingles in a row in common, at ca and cb. Of the
    runs the least of ``RUN_SPREAD`` neighbours take part; the first text of a run meets each
    other, and where that joins nothing more in this part, the link is left out."""
    def send(batches):
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                h, off = shingles(*column_bytes(batch.column("text")))
                dhs = batch.column("dh").to_numpy()
                runs, at = seed_places(h, off, least, RUN_SPREAD)
                doc = np.searchsorted(off, at, side="right") - 1
                key, dh, c = _once(runs[at], dhs[doc], at - off[doc], place=1)
                yield _blob_batch([(part, False, pack(key[i], dh[i], c[i].astype(np.uint32)))
                                   for part, i in by_part((key % np.uint64(parts)).astype(np.int64))], "part")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        key, dh, c = stacked(pdf["blob"])
        key, dh, c = _once(key, dh, c.astype(np.int64), place=1)
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        a, b = first[~head], np.flatnonzero(~head)
        i = spanning(dh[a], dh[b])
        return pd.DataFrame({"a": dh[a[i]], "b": dh[b[i]], "ca": c[a[i]], "cb": c[b[i]]})

    sent = texts.select("dh", F.col("text").cast("binary").alias("text")).mapInArrow(
        send, "part int, known boolean, blob binary")
    return sent.groupBy("part").applyInPandas(meet, "a long, b long, ca long, cb long")


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links (a, b) that join as much as all of them, and nothing twice."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, out = list(range(len(nodes))), []

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, (x, y) in enumerate(zip(at[:len(a)].tolist(), at[len(a):].tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[y] = x
            out.append(i)
    return np.array(out, np.int64)


def window_links(texts: DataFrame, parts: int, least: int, seeds: tuple | None = None) -> DataFrame:
    """(part, blob): links of windows of equal minimum by pairs of texts; under part -1 the
    minima of over ``FEW`` windows, which have no links, or with ``seeds`` (length and spread) the
    seeds that several components have."""
    def send(batches):
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                h, off = shingles(*column_bytes(batch.column("text")))
                dhs, comps = batch.column("dh").to_numpy(), batch.column("comp").to_numpy()
                cols = []
                for k, mine, l, c, r in all_windows(h, off, least):
                    l, r = _clip(l, c, r)
                    doc = np.searchsorted(off, c, side="right") - 1
                    base = off[doc]
                    cols.append((mine[c], dhs[doc], comps[doc], l - base, c - base, r - base, np.full(len(c), k, np.uint8)))
                key, dh, comp, l, c, r, k = _once(*[np.concatenate(x) for x in zip(*cols)], place=4)
                out = []
                if seeds:
                    runs, at = seed_places(h, off, *seeds)
                    seed, _, own = _once(runs[at] >> np.uint64(16), (of := comps[np.searchsorted(off, at, side="right") - 1]), of, place=2)
                    out = [(part, True, pack(small(seed[i], 6), own[i])) for part, i in by_part((seed % np.uint64(parts)).astype(np.int64))]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                start = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.zeros(0, np.int64)
                other = comp != comp[start]                 # the first of another component tells that there are several
                other &= np.cumsum(other) - np.where(other[start], 0, np.cumsum(other)[start]) == 1
                some = np.flatnonzero((np.arange(len(key)) - start <= FEW) | other)     # more do not matter: the key is frequent
                for part, i in by_part((key[some] % np.uint64(parts)).astype(np.int64)):
                    i = some[i]
                    i = i[np.lexsort((c[i], dh[i]))]
                    out.append((part, False, pack(
                        small(key[i] >> np.uint64(16), 6), dh[i], comp[i], (c[i] - l[i]).astype(np.uint16), c[i].astype(np.uint32),
                        (r[i] - c[i]).astype(np.uint16), k[i])))
                yield _blob_batch(out, "part")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if pdf["known"].any():
            seed, own = stacked(pdf["blob"][pdf["known"]])
            seed, own, _ = _once(wide(seed), own, own, place=2)
            twice = np.unique(seed[1:][seed[1:] == seed[:-1]])
            rows = [(-1, pack(twice))] if len(twice) else []
        if pdf["known"].all():
            return pd.DataFrame(rows, columns=["part", "blob"])
        key, dh, comp, left, c, right, k = stacked(pdf["blob"][~pdf["known"]])
        key, c = wide(key), c.astype(np.int64)
        key, dh, comp, l, c, r, k = _once(key, dh, comp, c - left, c, c + right, k, place=4)
        links, frequent = pair_links(key, dh, comp, l, c, r, k)
        rows += _by_pair(links, parts) + ([(-1, pack(frequent))] if len(frequent) and not seeds else [])
        return pd.DataFrame(rows, columns=["part", "blob"])

    sent = texts.select("dh", "comp", F.col("text").cast("binary").alias("text")).mapInArrow(
        send, "part int, known boolean, blob binary")
    return sent.groupBy("part").applyInPandas(meet, "part int, blob binary")


def frequent_minima(met: DataFrame, width: int = HOT_BITS) -> np.ndarray:
    """The minima without links (or the seeds) as 2^``width`` bits, whatever their number."""
    def spots(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                at = unpack(blob)[0] & np.uint64((1 << width) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["spot"])

    found = met.filter("part < 0").select("blob").mapInArrow(spots, "spot long").groupBy(
        F.shiftright("spot", 15).alias("part")).agg(F.expr("bitmap_construct_agg(spot & 32767)").alias("bits"))
    bits = np.zeros(1 << width >> 3, np.uint8)
    for r in found.collect():                               # 2^width bits in all
        own = np.frombuffer(r.bits, np.uint8)
        bits[r.part * 4096:r.part * 4096 + len(own)] = own
    return bits


def seed_links(texts: DataFrame, bits: np.ndarray, parts: int, least: int, similarity: float, classes: bool) -> DataFrame:
    """(part, blob): links of texts around their frequent minima, by what is there in a row.

    Two passages have a run of ``common_run`` shingles in common, and so a seed: texts meet by
    seeds, with the shingles around them, and not by the minimum. See ``hub_pairs`` and, for
    ``classes``, ``open_pairs``.
    """
    run, half = common_run(least, similarity), math.ceil(least / similarity)
    enough = math.ceil(2 * least * similarity / (1 + similarity) - 1e-9)
    seed, spread = seed_size(run)

    def links_of(dh, c, a, b):
        at = np.tile(np.stack([c[a], c[b]]), 2)             # as of two functions: they need no other to agree
        k = np.repeat(np.arange(2, dtype=np.uint8), len(a))
        return [np.tile(dh[a], 2), np.tile(dh[b], 2), k, at[0], at[0] - least, at[0] + least, at[1], at[1] - least, at[1] + least]

    def send(batches):
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                h, off = shingles(*column_bytes(batch.column("text")))
                dhs, comps = batch.column("dh").to_numpy(), batch.column("comp").to_numpy()
                runs, at = seed_places(h, off, seed, spread)
                if classes:
                    at = at[_marked(bits, runs[at] >> np.uint64(16))]
                else:
                    near = np.zeros(len(h) + 1, np.int64)
                    for _, mine, l, c, r in all_windows(h, off, least):
                        hit = _marked(bits, mine[c] >> np.uint64(16))
                        np.add.at(near, np.maximum(l, c - half)[hit], 1)
                        np.add.at(near, np.minimum(r, c + half)[hit], -1)
                    at = at[np.cumsum(near)[at] > 0]
                at = at[stretch_ends(runs[at], np.searchsorted(off, at, side="right"), at, seed)]
                if not len(at):
                    continue
                doc = np.searchsorted(off, at, side="right") - 1
                inside = (at - half >= off[doc]) & (at + half <= off[doc + 1])
                name = at.astype(np.uint64)                 # seeds of a text in equal surroundings count once
                if inside.any():
                    name[inside] = rolling_hash(h, 2 * half)[at[inside] - half]
                order = np.lexsort((at, name, dhs[doc]))
                at, doc, name = at[order], doc[order], name[order]
                new = np.ones(len(at), bool)
                new[1:] = (dhs[doc][1:] != dhs[doc][:-1]) | (name[1:] != name[:-1])
                at, doc = at[new], doc[new]
                c = at - off[doc]
                key, dh, c, at, doc = _once(runs[at] >> np.uint64(16), dhs[doc], c, at, doc, place=2)
                places = at[:, None] + np.arange(-half, half)
                around = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)[np.clip(places, 0, len(h) - 1)]
                around[(places < off[doc][:, None]) | (places >= off[doc + 1][:, None])] = 0
                if classes:
                    names, out = comps[doc], []
                    stay = _surroundings(key, names, around)
                else:
                    names = run_names(h, off, at, doc, least)
                    a, b, stay = hub_pairs(key, dh, around, names, run, least, enough, HUBS)
                    out = [(p, True, blob) for p, blob in _by_pair(links_of(dh, c, a, b), parts)]
                    stay = np.flatnonzero(stay)
                for part, i in by_part((key[stay] % np.uint64(parts)).astype(np.int64)):
                    i = stay[i]
                    out.append((part, False, pack(small(key[i], 6), dh[i], c[i].astype(np.uint32), around[i], names[i])))
                yield _blob_batch(out, "part")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.loc[pdf["known"], ["part", "blob"]].itertuples(index=False, name=None))
        if not pdf["known"].all():
            key, dh, c, around, names = stacked(pdf["blob"][~pdf["known"]])
            key, dh, c, at = _once(wide(key), dh, c.astype(np.int64), np.arange(len(dh)), place=2)
            if classes:
                keep = _surroundings(key, names[at], around[at])
                dh, c, at = dh[keep], c[keep], at[keep]
                a, b = open_pairs(key[keep], names[at], around[at], run, least, enough)
            else:
                a, b, _ = hub_pairs(key, dh, around[at], names[at], run, least, enough)
            rows += _by_pair(links_of(dh, c, a, b), parts)
        return pd.DataFrame(rows, columns=["part", "blob"])

    sent = texts.select("dh", "comp", F.col("text").cast("binary").alias("text")).mapInArrow(
        send, "part int, known boolean, blob binary")
    return sent.groupBy("part").applyInPandas(meet, "part int, blob binary")


def candidate_pairs(texts: DataFrame, parts: int, words: int, similarity: float, classes: bool = False) -> DataFrame:
    """(a, b, diagonals) for pairs of texts (by hash, a < b) of two components with agreeing
    links; for ``classes``, one of each two components suffices where a run is common."""
    least = words - SHINGLE + 1

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, k, ca, la, ra, cb, lb, rb = cols = distinct_links(_unpack_links(pdf["blob"]))
        keep = np.zeros(len(a), bool)
        for shift in (0, BAND // 2):              # links of one passage have nearly one diagonal
            bands = (cb - ca + shift) // BAND
            order = np.lexsort((cb, k, ca, bands, b, a))
            keep[order] |= agreeing(*[x[order] for x in cols], least, bands[order])
        a, b, diagonal = a[keep], b[keep], (cb - ca)[keep]
        rows = pd.DataFrame({"a": a, "b": b, "d": diagonal // DRIFT}).drop_duplicates()
        got = rows.groupby(["a", "b"], sort=True)["d"].agg(lambda x: sorted(int(v) * DRIFT + DRIFT // 2 for v in x)).reset_index()
        return got.rename(columns={"d": "diagonals"}) if len(got) else pd.DataFrame({"a": [], "b": [], "diagonals": []}, dtype=object)

    # around frequent minima; for classes wherever a seed is left that several components have
    seeds = seed_size(common_run(least, similarity)) if classes else None
    met = materialize(window_links(texts, parts, least, seeds), "windows")
    bits = frequent_minima(met, min(28, HOT_BITS + math.ceil(math.log2(parts))) if classes else HOT_BITS)
    links = met.filter("part >= 0")
    if bits.any():
        links = links.unionByName(seed_links(texts, bits, parts, least, similarity, classes))
    return links.groupBy("part").applyInPandas(judge, "a long, b long, diagonals array<int>")


def all_windows(h: np.ndarray, off: np.ndarray, least: int):
    """(function, its hashes, l, c, r) of the compact windows of each function."""
    for k in range(HASHES):
        mine = mix64(h ^ mix64(np.array([k + 1], np.uint64)))
        yield k, mine, *compact_windows(mine, off, least)


def _once(key, dh, *cols, place=3):
    """Columns sorted by key, text and place (the column of that number), equal ones once:
    copies of one text have the same, in several slices too."""
    cols = (key, dh, *cols)
    order = np.lexsort((cols[place], dh, key))
    cols = [x[order] for x in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (cols[0], cols[1], cols[place])], axis=0)
    return [x[new] for x in cols]


def _by_pair(links, parts: int):
    """(part, blob) of links, a < b, all of a pair in one part."""
    links = list(links)
    swap = links[0] > links[1]
    for x, y in ((0, 1), (3, 6), (4, 7), (5, 8)):
        links[x], links[y] = np.where(swap, links[y], links[x]), np.where(swap, links[x], links[y])
    pair = mix64(links[0].view(np.uint64) * np.uint64(3) + links[1].view(np.uint64))
    return [(p, _pack_links([x[i] for x in links])) for p, i in by_part((pair % np.uint64(parts)).astype(np.int64))]


def _blob_batch(out, name):
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(
        (pa.int32(), pa.bool_(), pa.binary()))], [name, "known", "blob"])


def _pack_links(x):
    a, b, k, ca, la, ra, cb, lb, rb = x
    o = np.lexsort((ca, b, a))
    return pack(a[o], b[o], k[o], ca[o].astype(np.uint32), (ca - la)[o].astype(np.uint16), (ra - ca)[o].astype(np.uint16),
                cb[o].astype(np.uint32), (cb - lb)[o].astype(np.uint16), (rb - cb)[o].astype(np.uint16))


def _unpack_links(blobs):
    a, b, k, ca, la, ra, cb, lb, rb = stacked(blobs)
    ca, cb = ca.astype(np.int64), cb.astype(np.int64)
    return [a, b, k, ca, ca - la, ca + ra, cb, cb - lb, cb + rb]


def _stretches(mask: np.ndarray, gap: int):
    """(first, after last) of runs of marked places with fewer than ``gap`` unmarked between."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist()))


def _windows(match: np.ndarray, lo: int, hi: int, n_other: int, least: int, similarity: float, score):
    """Passages (start, end, start, end, score) within ``lo..hi`` that no cut at gaps leaves whole.

    Without repeated shingles, a stretch is similar enough when (1 + s) matches - s (places on
    both sides) >= 0, a difference of prefix sums: the longest stretch from match to match is
    taken, then the rest on its sides is searched. What is left is searched by windows of
    ``least`` places that start anywhere, so a short stretch takes foreign shingles in.
    """
    enough, out, todo = math.ceil(2 * least * similarity / (1 + similarity) - 1e-9), [], [(lo, hi, similarity)]

    while todo:
        lo, hi, bar = todo.pop()
        at = lo + np.flatnonzero(match[lo:hi] >= 0)
        if len(at) < enough:
            continue
        if bar <= 1:
            mine, n = match[at], np.arange(len(at))
            before = (1 + bar) * n - bar * (at + mine)                          # of a stretch that starts here
            after = (1 + bar) * (n + 1) - bar * (at + mine + 2)                 # of one that ends here
            best = np.maximum.accumulate(after[::-1])[::-1]
            last = np.searchsorted(-best, -before + 1e-9, side="right") - 1
            size = np.where(last >= n, at[np.maximum(last, 0)] + 1 - at, 0)
            k = int(np.argmax(size))
            p, q = int(at[k]), int(at[k] + size[k])
            if q - p >= least:
                own = match[p:q][match[p:q] >= 0]
                u, v = int(own.min()), int(own.max()) + 1
                near = score(p, q, u, v)
                if near >= similarity and v - u >= least:
                    out.append((p, q, u, v, near))
                    todo += [(lo, p, bar), (q, hi, bar)]
                else:                                   # repeated shingles, or too short on the other side
                    todo.append((lo, hi, bar + (1 - similarity) / 8))
                continue
        # windows of the least length, over places that may lie outside the matches
        if hi - lo < least or n_other < least:
            continue
        run = np.concatenate([[0], np.cumsum(match[lo:hi] >= 0)])
        count = run[least:] - run[:-least]
        for p in (lo + np.argsort(-count, kind="stable")[:int((count >= enough).sum())]).tolist():
            q = p + least
            own = p + np.flatnonzero(match[p:q] >= 0)
            hit = None
            for u in np.unique(np.clip(match[own] - (own - p), 0, n_other - least)).tolist():
                near = score(p, q, u, u + least)
                if near >= similarity and (hit is None or near > hit[4]):
                    hit = (p, q, u, u + least, near)
            if hit:
                out.append(hit)
                todo += [(lo, p, similarity), (q, hi, similarity)]
                break
    return out


def passages(x: np.ndarray, y: np.ndarray, diagonals, words: int, similarity: float):
    """Verified passages (start, end, start, end in words, Jaccard) common to the shingle
    sequences ``x`` and ``y`` near the diagonals."""
    least, out = words - SHINGLE + 1, []

    def score(p, q, u, v):
        mine, other = np.unique(x[p:q]), np.unique(y[u:v])
        both = len(np.intersect1d(mine, other, assume_unique=True))
        return both / (len(mine) + len(other) - both)

    for d in diagonals:
        match = np.full(len(x), -1)
        for e in sorted(range(-DRIFT, DRIFT + 1), key=abs, reverse=True):
            lo, hi = max(0, -(d + e)), min(len(x), len(y) - (d + e))
            if lo < hi:
                i = np.arange(lo, hi)
                same = x[lo:hi] == y[lo + d + e:hi + d + e]
                match[i[same]] = i[same] + d + e
        todo, found = [(0, len(x), 0)], []
        while todo:
            s, e, g = todo.pop()
            for p, q in _stretches(match[s:e] >= 0, GAPS[g]):
                p, q = p + s, q + s
                if q - p < least:
                    continue
                own = match[p:q][match[p:q] >= 0]
                u, v = int(own.min()), int(own.max()) + 1
                near = score(p, q, u, v)
                if near >= similarity and v - u >= least:
                    found.append((p, q, u, v, near))
                elif g + 1 < len(GAPS):
                    todo.append((p, q, g + 1))
        free = np.concatenate([[0], *[[f[0], f[1]] for f in sorted(found)], [len(x)]]).astype(int)
        for lo, hi in zip(free[::2].tolist(), free[1::2].tolist()):
            found += _windows(match, lo, hi, len(y), least, similarity, score)
        out += [(p, q + SHINGLE - 1, u, v + SHINGLE - 1, near) for p, q, u, v, near in found]
    out.sort(key=lambda s: (-(s[1] - s[0]), s))
    kept = []
    for s in out:                     # neighbouring diagonals find the same passage
        if not any(s[0] < t[1] and t[0] < s[1] and s[2] < t[3] and t[2] < s[3] for t in kept):
            kept.append(s)
    return sorted(kept)


def verified(met: DataFrame, words: int, similarity: float) -> DataFrame:
    """Passages of rows with two packed texts, their ids and diagonals."""
    def run(batches):
        for batch in _row_blocks(batches, 64):
            xs, xo = shingles(*_unpacked(batch.column("a_text")))
            ys, yo = shingles(*_unpacked(batch.column("b_text")))
            rows = []
            for r, diagonals in enumerate(batch.column("diagonals").to_pylist()):
                for s in passages(xs[xo[r]:xo[r + 1]], ys[yo[r]:yo[r + 1]], diagonals, words, similarity):
                    rows.append((r, *s))
            at = pa.array([x[0] for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a_id").take(at), batch.column("b_id").take(at)]
                + [pa.array([x[j] for x in rows], pa.float64() if j == 5 else pa.int32()) for j in range(1, 6)],
                ["a_id", "b_id", "a_start", "a_end", "b_start", "b_end", "similarity"])

    return met.mapInArrow(run, "a_id long, b_id long, a_start int, a_end int, b_start int, b_end int, similarity double")


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, component_id (smallest id reachable by passages in common), and
    the longest verified passage of those that join it: start_word, end_word, other_id,
    other_start, other_end, similarity (null where there is none).

    Texts that have as many shingles in a row in common as a passage needs are one component
    first. Candidates then are pairs of two components, as many as there are; one of every two
    components is verified in each of a few turns, then all that still are of two.
    """
    least = words - SHINGLE + 1
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("dh", F.when(F.octet_length("text") >= 2 * words - 1, F.xxhash64(F.sha2("text", 256))))
    meta = materialize(rows.select("id", "dh", F.octet_length("text").cast("long").alias("n_bytes")), "meta")
    ids = meta.filter("dh is not null").groupBy("dh").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("first_id"),
        F.max("id").alias("last_id"), F.count(F.lit(1)).alias("ids"))
    total = meta.filter("dh is not null").agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, min(MAX_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))))
    runs = materialize(run_links(rows.filter("dh is not null"), parts, least), "runs")
    joined = joined_components(runs.select("a", "b")).select(F.col("node").alias("c_dh"), F.col("root").alias("comp"))

    about = materialize(ids.join(joined.hint("merge"), F.col("dh") == F.col("c_dh"), "left").select(
        "dh", "first_id", "last_id", "ids", F.coalesce("comp", "dh").alias("comp")), "about")
    n_words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    texts = materialize(rows.join(about.select(F.col("dh").alias("a_dh"), "first_id", "ids", "comp").hint("merge"), F.col("dh") == F.col("a_dh"))
                        .filter(F.col("id").eqNullSafe(F.col("first_id"))).select(
        "dh", "comp", F.when(F.col("ids") > 1, n_words).alias("n"), "text"), "texts")

    # each text that a run joins is verified with one that it has a run in common with
    by_run = runs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", (F.col("cb") - F.col("ca")).cast("int").alias("d")).groupBy(
        "node").agg(F.min_by(F.struct("a", "b", "d"), F.struct(F.xxhash64("a", "b"), "d")).alias("s")).select(
        "s.a", "s.b", F.array("s.d").alias("diagonals")).distinct()
    found = [materialize(verified_links(texts, by_run, words, similarity), "found")]
    pairs = materialize(candidate_pairs(texts, parts, words, similarity, classes=True), "pairs")
    links = runs.select("a", "b")
    for turn in range(TURNS + 1):
        known = joined_components(links)
        root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731,B023
        pairs = materialize(pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").select(
            "a", "b", "diagonals", F.coalesce("a_root", "a").alias("p"), F.coalesce("b_root", "b").alias("q")).filter(
            "p != q"), "open")
        if pairs.isEmpty():
            break
        some = pairs if turn == TURNS else pairs.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(
            F.min_by(F.struct("a", "b", "diagonals"), F.xxhash64("a", "b")).alias("s")).select("s.*")
        some = materialize(some.select("a", "b", "diagonals"), "some")
        found.append(materialize(verified_links(texts, some, words, similarity), "found"))
        links = links.unionByName(found[-1].select("a", "b"))
        pairs = pairs.select("a", "b", "diagonals").join(some.select("a", "b"), ["a", "b"], "left_anti")
    return _with_class(meta, about, texts, found, joined_components(links), id_col, words)


def verified_links(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Passages of pairs of texts (a, b, diagonals), with a and b for their ids."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("dh")).distinct()
    some = _pack_text(texts.select("dh", "text").join(wanted, "dh", "left_semi"))
    side = lambda c: some.select(F.col("dh").alias(f"{c}_id"), F.col("text").alias(f"{c}_text")).hint("merge")
    met = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    return verified(met, words, similarity).distinct().withColumnsRenamed({"a_id": "a", "b_id": "b"})


def _with_class(meta, about, texts, found, roots, id_col, words):
    """The rows of ``meta`` with component and passage; texts of fewer words stay alone."""
    names = ("dh", "start_word", "end_word", "other", "other_start", "other_end")
    own, other = ("a", "a_start", "a_end"), ("b", "b_start", "b_end")
    sides = [F.struct(*[F.col(c).alias(n) for c, n in zip(x + y, names)], "similarity") for x, y in ((own, other), (other, own))]
    passage = functools.reduce(DataFrame.unionByName, found).select(F.explode(F.array(*sides)).alias("s")).select("s.*").groupBy("dh").agg(
        F.min_by(F.struct(*names[1:], "similarity"), F.struct(F.col("start_word") - F.col("end_word"), "other", "start_word", "other_start")).alias("s"))
    passage = passage.select("dh", "s.*").join(about.select(F.col("dh").alias("other"), F.col("first_id").alias("other_id")), "other").drop("other")
    of_text = about.join(texts.select("dh", "n").distinct(), "dh").join(roots.withColumnRenamed("node", "dh"), "dh", "left").join(
        passage, "dh", "left").select("dh", "first_id", "last_id", "ids", "n", *names[1:3], "other_id", *names[4:], "similarity",
                                      F.when((F.col("ids") == 1) | (F.col("n") >= words), F.coalesce("root", "dh")).alias("node"))
    rows = materialize(meta.select("id", "dh").join(of_text, "dh", "left"), "rows")
    lowest = rows.filter("node is not null").groupBy(F.col("node").alias("l_node")).agg(F.min("id").alias("lowest"))
    whole = F.col("node").isNotNull() & (F.col("ids") > 1)          # passages of whole texts with their copies
    first = F.col("id").eqNullSafe(F.col("first_id"))
    copy = whole & (~first | (F.col("start_word").isNull() & (F.col("last_id") != F.col("first_id"))))

    def told(name, of_copy):
        return F.when(copy, of_copy).otherwise(F.col(name)).alias(name)

    return rows.join(lowest, F.col("node") == F.col("l_node"), "left").select(
        F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"),
        told("start_word", F.lit(0)), told("end_word", F.col("n")), told("other_id", F.when(first, F.col("last_id")).otherwise(F.col("first_id"))),
        told("other_start", F.lit(0)), told("other_end", F.col("n")), told("similarity", F.lit(1.0)))


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of passages: id, first_id, start_word, end_word, first_start, first_end, similarity.

    ``first_id`` is the smaller id of the two. Rows for copies of a whole text name the copy
    of smallest id, which alone takes part in the other pairs.
    """
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter(F.octet_length("text") >= 2 * words - 1)      # so many words need so many bytes
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("dh", F.xxhash64("sha"))
    meta = materialize(rows.groupBy("sha", "dh", "id").agg(
        F.max(F.octet_length("text")).cast("long").alias("n_bytes")), "meta")
    first = meta.groupBy("sha", "dh").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("first_id"), F.count(F.lit(1)).alias("ids"))
    total = meta.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(MAX_PARTS, max(least, math.ceil(total / PART_BYTES))))
    pairs = materialize(candidate_pairs(rows.withColumn("comp", F.col("dh")), parts, words, similarity), "pairs")
    texts = _pack_text(rows.select("id", "dh", "text"))
    ids = first.select(F.col("dh").alias("i_dh"), F.col("first_id").alias("i_id"))

    def with_text(left: DataFrame, side: str) -> DataFrame:
        named = left.join(ids.hint("merge"), F.col(side) == F.col("i_dh")).withColumnRenamed("i_id", f"{side}_id").drop("i_dh")
        t = texts.select(F.col("id").alias("t_id"), F.col("dh").alias("t_dh"), F.col("text").alias(f"{side}_text"))
        return named.join(t.hint("merge"), (F.col(side) == F.col("t_dh")) & F.col(f"{side}_id").eqNullSafe(F.col("t_id"))
                          ).drop("t_id", "t_dh")

    met = with_text(with_text(pairs, "a"), "b").select("a_id", "b_id", "diagonals", "a_text", "b_text")
    found = verified(met, words, similarity).distinct()
    swap = F.coalesce(F.col("b_id") < F.col("a_id"), F.col("a_id").isNull())

    def side(name, of_first):
        return F.when(swap == F.lit(of_first), F.col(f"b_{name}")).otherwise(F.col(f"a_{name}"))

    apart = found.select(
        side("id", False).alias(id_col), side("id", True).alias("first_id"), side("start", False).alias("start_word"),
        side("end", False).alias("end_word"), side("start", True).alias("first_start"), side("end", True).alias("first_end"),
        "similarity")
    return apart.unionByName(_copies(rows, meta, first, id_col, words))


def _copies(rows, meta, first, id_col, words):
    """Whole texts of at least ``words`` words that a smaller id has as well."""
    several = first.filter("ids > 1").select(F.col("sha").alias("f_sha"), "first_id")
    counted = rows.select("id", "sha", F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("n"))
    own = counted.join(several.hint("merge"), F.col("sha") == F.col("f_sha")).filter(
        (F.col("n") >= words) & ~F.col("id").eqNullSafe(F.col("first_id"))).select("id", "first_id", "n").distinct()
    zero = F.lit(0)
    return own.select(F.col("id").alias(id_col), "first_id", zero.alias("start_word"), F.col("n").alias("end_word"),
                      zero.alias("first_start"), F.col("n").alias("first_end"), F.lit(1.0).alias("similarity"))
