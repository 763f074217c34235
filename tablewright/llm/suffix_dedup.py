"""Suffix-array deduplication: removes every byte of a string of ``size`` bytes that also
starts earlier (in a document of smaller id, or earlier in the same document).

Equal texts are settled first: only the one of smallest id is searched, the others go whole.
Sorting the suffixes of every byte would multiply the input, so the suffixes are sampled by
content: in each window of ``size`` bytes the leftmost smallest hash of a run of ``gram``
bytes marks an anchor, so equal windows have their anchor at the same place. One shuffle of
the anchors' hashes keeps those that occur twice; only these take their surroundings along.
Their suffixes are dealt to buckets by sampled splitters over the leading bytes (shorter
than a run, so that equal strings never part), and each bucket sorts its suffixes, and the
reversed bytes before the anchors, by multikey sorting on eight bytes at a time. The common
prefixes of neighbours give, for each place of the anchor in a window, the groups of equal
windows; all but the first of a group are removed. Comparisons are of bytes, hashes choose
candidates alone.

Anchors of a very frequent run are recognised in the map task and sent once per slice; equal
surroundings of a slice are settled there as well. Runs that hold more than 1/``HOT_RUNS`` of
all anchors (counted over all slices, fewer than ``HOT_RUNS``) do not go to the bucket of
their lead: a window of ``size`` bytes around a run holds half of its other bytes before the
run or after it, so such an anchor goes to one bucket by a hash of the run with that many
bytes before it, and to one by a hash of the run with those after it. A frequent line between
different neighbours is so dealt by its neighbours. Buckets follow the input: where there are
more than splitters, a range is dealt further by a hash of the lead.

Defined cases: a null text counts as empty; texts under ``size`` bytes lose nothing; a null
id comes after all others; among different texts of one id a hash of the text decides; of
repeated rows one is the earlier; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.blobs import by_part, pack, rolling_hash, sliding_argmin, small, stacked, wide
from tablewright.llm.bpe import gather
from tablewright.llm.common import column_bytes, materialize, mix64, pick, slices, text_lengths

SIZE = 100
GRAM = 40
LEAD = 16                    # bytes of the splitters
SLICE_BYTES = 2 << 20
PART_BYTES = 16 << 20        # text for each part and bucket
HOT_RUNS = 20_000            # a run with a larger share than 1/HOT_RUNS of the anchors is hot
LEAST_HOT = 1000             # anchors that a hot run has at least
MAX_SAMPLE = 20_000          # splitters are chosen from so many sampled strings
LAST = np.iinfo(np.int64).max


def anchors(raw: np.ndarray, off: np.ndarray, size: int, gram: int):
    """Places of the anchors in ``raw`` and the hashes of their runs."""
    windows = np.maximum(np.diff(off) - size + 1, 0)
    starts = gather(np.arange(len(raw)), off[:-1], windows)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = mix64(rolling_hash(mix64(raw.astype(np.uint64) + np.uint64(1)), gram))
    least = sliding_argmin(hashes, size - gram + 1)
    at = np.unique(least[starts])
    return at, hashes[at]


def surroundings(raw, off, at, size, gram):
    """Bytes from each anchor on, bytes before it (nearest first), and how many are real."""
    doc = np.searchsorted(off, at, side="right") - 1
    after = np.minimum(off[doc + 1] - at, size)
    before = np.minimum(at - off[doc], size - gram)
    right = raw[np.minimum(at[:, None] + np.arange(size), len(raw) - 1)] * (np.arange(size) < after[:, None])
    steps = np.arange(1, size - gram + 1)
    left = raw[np.maximum(at[:, None] - steps, 0)] * (steps <= before[:, None])
    return right.astype(np.uint8), left.astype(np.uint8), after, before


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte strings: sorted by eight bytes, then only runs of equals by the next."""
    n, width = rows.shape
    padded = np.zeros((n, -(-max(width, 1) // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8")
    order = np.argsort(keys[:, 0], kind="stable")
    run = np.concatenate([[0], np.cumsum(np.diff(keys[order, 0].astype(np.uint64)) != 0)]) if n else np.zeros(0, int)
    for depth in range(1, keys.shape[1]):
        counts = np.bincount(run, minlength=1)
        open_ = np.flatnonzero(counts[run] > 1) if n else []
        if not len(open_):
            break
        at = order[open_]
        key = keys[at, depth].astype(np.uint64)
        order[open_] = at[np.lexsort((key, run[open_]))]
        key = keys[order, depth].astype(np.uint64)
        new = np.ones(n, bool)
        new[1:] = (run[1:] != run[:-1]) | ((key[1:] != key[:-1]) & (counts[run[1:]] > 1))
        run = np.cumsum(new) - 1
    return order


def common_prefix(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before it in the order (first: 0)."""
    out = np.zeros(len(order), np.int64)
    for s in range(1, len(order), 100_000):
        e = min(len(order), s + 100_000)
        same = rows[order[s:e]] == rows[order[s - 1:e - 1]]
        first = np.argmin(same, axis=1)
        out[s:e] = np.where(same.all(axis=1), rows.shape[1], first)
    return out


def nearest_prefix(order, lcp):
    """For each row the longest prefix it shares with any other row."""
    after = np.append(lcp[1:], 0)
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, after)
    return out


def repeated(right, left, after, before, size: int, gram: int, places_in=None):
    """For rows sorted by (id, text, place): (row, first, last) where windows with the anchor
    ``first`` to ``last`` bytes from their start equal a window of an earlier row; the places
    looked at are those from ``places_in[0]`` to ``places_in[1]`` (all by default)."""
    n = len(right)
    low, high = np.full(n, size), np.full(n, -1)
    ro, lo = multikey_order(right), multikey_order(left)
    rp, lp = common_prefix(right, ro), common_prefix(left, lo)
    rmax, lmax = nearest_prefix(ro, rp), nearest_prefix(lo, lp)
    hopeful = np.minimum(rmax, after) + np.minimum(lmax, before) >= size
    start, stop = places_in or (0, size - gram)
    for o in range(start, stop + 1):
        sel = np.flatnonzero(hopeful & (after >= size - o) & (before >= o) & (rmax >= size - o) & (lmax >= o))
        if len(sel) < 2:
            continue
        rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
        rid[ro], lid[lo] = np.cumsum(rp < size - o), np.cumsum(lp < o)
        key = (rid[sel] << 32) | lid[sel]
        _, first = np.unique(key, return_index=True)
        dup = np.ones(len(sel), bool)
        dup[first] = False
        rows = sel[dup]
        low[rows] = np.minimum(low[rows], o)
        high[rows] = o
    rows = np.flatnonzero(high >= 0)
    return rows, low[rows], high[rows]


def _pack_text(df: DataFrame) -> DataFrame:
    @F.arrow_udf("binary")
    def packed(text: pa.Array) -> pa.Array:
        z = zstandard.ZstdCompressor(level=1)
        return pa.array([z.compress(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())

    return df.withColumn("text", packed("text"))


def _unpacked(col: pa.Array):
    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(t) for t in col.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def _row_blocks(batches, size=256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _distinct(i, d, p):
    """Order by (id, text, place) without repeated rows."""
    order = np.lexsort((p, d, i))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(i[order]) != 0) | (np.diff(d[order]) != 0) | (np.diff(p[order]) != 0)
    return order[new]


def repeated_anchors(texts: DataFrame, parts: int, size: int, gram: int) -> DataFrame:
    """(dh, pos): anchors of (dh, text) whose run occurs at two places or more; and for each
    run the rows (run, -1 - its anchors over all slices), as far as it has many in a slice."""
    def send(batches):
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                raw, off = column_bytes(batch.column("text"))
                at, key = anchors(raw, off, size, gram)
                doc = np.searchsorted(off, at, side="right") - 1
                dh = batch.column("dh").to_numpy()[doc]
                pos = at - off[doc]
                order = np.lexsort((pos, dh, key))
                key, dh, pos = key[order], dh[order], pos[order]
                new = np.ones(len(key), bool)       # copies of one text count once
                new[1:] = (key[1:] != key[:-1]) | (dh[1:] != dh[:-1]) | (pos[1:] != pos[:-1])
                key, dh, pos = key[new], dh[new], pos[new]
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                times = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] if len(key) else np.zeros(0, np.int64)
                many = times > 1
                out = []
                for part, i in by_part((key[first] % np.uint64(parts)).astype(np.int64)):
                    i = np.flatnonzero(first)[i]
                    out.append((part, False, pack(small(key[i] >> np.uint64(16), 6), dh[i], pos[i].astype(np.uint32),
                                                  times[i].astype(np.uint32))))
                known = np.flatnonzero(many)          # known to repeat: spread by text, not by key
                for part, i in by_part(dh[known] % parts):
                    out.append((part, True, pack(dh[known[i]], pos[known[i]].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))],
                    ["part", "known", "blob"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if pdf["known"].any():
            dh, pos = stacked(pdf["blob"][pdf["known"]])
            out[0].append(dh)
            out[1].append(pos)
        if not pdf["known"].all():
            key, dh, pos, times = stacked(pdf["blob"][~pdf["known"]])
            key = wide(key)
            order = np.lexsort((pos, dh, key))
            key, dh, pos, times = key[order], dh[order], pos[order].astype(np.int64), times[order].astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (dh[1:] != dh[:-1]) | (pos[1:] != pos[:-1])
            run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            twice = (np.bincount(run, weights=new) > 1) | (np.bincount(run, weights=times > 1) > 0)
            keep = twice[run] & new
            every = np.bincount(run, weights=times).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            often = np.flatnonzero(every >= LEAST_HOT)
            out[0].extend([dh[keep], key[heads[often]].view(np.int64)])
            out[1].extend([pos[keep], -1 - every[often]])
        return pd.DataFrame({"dh": np.concatenate(out[0]), "pos": np.concatenate(out[1]).astype(np.int64)})

    return texts.select("dh", F.col("text").cast("binary").alias("text")).mapInArrow(
        send, "part int, known boolean, blob binary").groupBy("part").applyInPandas(match, "dh long, pos long")


def splitters(texts: DataFrame, buckets: int, rows: int) -> np.ndarray:
    """Leading strings that cut the sampled suffixes into ``buckets`` even ranges.

    A hash picks about 64 of ``rows`` texts for each bucket, ``MAX_SAMPLE`` at most, before
    anything is sent (an ordered limit would send so many from every task).
    """
    wanted = min(MAX_SAMPLE, 64 * buckets)
    if buckets < 2:
        return np.zeros(0, f"S{LEAD}")
    place = F.pmod(F.xxhash64("dh", F.lit("place")), F.octet_length("text")).cast("int") + 1
    lead = F.substring(F.col("text").cast("binary"), place, F.lit(LEAD))
    picked = texts.filter(F.pmod(F.xxhash64("dh", F.lit("lead")), F.lit(max(1, rows // wanted))) == 0)
    got = picked.select(lead.alias("lead")).limit(4 * MAX_SAMPLE).collect()
    lead = np.sort(np.array([bytes(r.lead) for r in got], f"S{LEAD}"))
    return np.unique(lead[np.linspace(0, len(lead), buckets + 1).astype(int)[1:-1]]) if len(lead) else lead


def run_names(right: np.ndarray, gram: int) -> np.ndarray:
    """The names (48 bits of the hash) of the runs that rows of bytes start with."""
    units = mix64(right[:, :gram].astype(np.uint64).ravel() + np.uint64(1))
    return mix64(rolling_hash(units, gram)[::gram]) >> np.uint64(16) if len(right) else np.zeros(0, np.uint64)


def half_names(right, left, gram: int, half: int):
    """Hashes of each run with ``half`` bytes before it, and with ``half`` bytes after it."""
    before = np.concatenate([left[:, :half][:, ::-1], right[:, :gram]], axis=1).astype(np.uint64)
    after = right[:, :gram + half].astype(np.uint64)
    return [mix64(rolling_hash(mix64(x.ravel() + np.uint64(1)), gram + half)[::gram + half]) for x in (before, after)]


def offsets(size: int, gram: int):
    """Places of the anchor in a window: all, those with half of the other bytes before the
    run, those with half of them after it."""
    half = (size - gram) // 2
    return (0, size - gram), (half, size - gram), (0, size - gram - half)


def dealt_surroundings(chosen: DataFrame, cuts: np.ndarray, buckets: int, size: int, gram: int,
                       hot: np.ndarray) -> DataFrame:
    """(bucket, known, blob): anchors with their surroundings, dealt to buckets by their lead
    or, where ``hot`` names their run, by its neighbours; and (known) stretches settled in the
    map task. ``chosen`` has id, dh, packed text, places."""
    lead, half, finer = min(LEAD, gram), (size - gram) // 2, max(1, -(-buckets // (len(cuts) + 1)))
    every, before_run, after_run = offsets(size, gram)

    def send(batches):
        for batch in _row_blocks(batches):
            raw, off = _unpacked(batch.column("text"))
            places = batch.column("places")
            counts = np.diff(places.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), counts)
            at = off[doc] + places.flatten().to_numpy()
            id_ = batch.column("id").fill_null(LAST).to_numpy()[doc]
            dh = batch.column("dh").to_numpy()[doc]
            for s in range(0, len(at), 50_000):
                some = slice(s, s + 50_000)
                right, left, after, before = surroundings(raw, off, at[some], size, gram)
                i, d, p = id_[some], dh[some], (at - off[doc])[some]
                order = _distinct(i, d, p)
                both = np.ascontiguousarray(np.concatenate(
                    [right, left, after[:, None].astype("<u2").view(np.uint8), before[:, None].astype("<u2").view(np.uint8)],
                    axis=1)[order])
                _, first = np.unique(both.view(f"V{both.shape[1]}").ravel(), return_index=True)
                seen = np.ones(len(order), bool)
                seen[first] = False
                out = []
                settled = order[seen & ((after + before)[order] >= size)]
                for part, k in by_part(d[settled] % buckets):
                    k = settled[k]
                    out.append((part, True, pack(i[k], d[k], p[k] - before[k], p[k] + after[k])))
                sent = order[~seen]
                dealt = []                      # (bucket, rows, places of the anchor in a window)
                is_hot = np.isin(run_names(right[sent], gram), hot) if len(hot) else np.zeros(len(sent), bool)
                warm = sent[is_hot]
                if len(warm):
                    for name, real, need, places_in in zip(half_names(right[warm], left[warm], gram, half), (before, after),
                                                           (half, gram + half), (before_run, after_run)):
                        held = np.flatnonzero(real[warm] >= need)
                        dealt.append(((name[held] % np.uint64(buckets)).astype(np.int64), warm[held], places_in))
                cold = sent[~is_hot]
                heads = np.ascontiguousarray(right[cold][:, :lead]).view(f"S{lead}").ravel()
                bucket = np.searchsorted(cuts, heads, side="right")
                if finer > 1:
                    words = np.zeros((len(cold), 16), np.uint8)
                    words[:, :lead] = right[cold][:, :lead]
                    words = words.view(np.uint64)
                    bucket = bucket * finer + (mix64(mix64(words[:, 0]) ^ words[:, 1]) % np.uint64(finer)).astype(np.int64)
                dealt.append((bucket, cold, every))
                for bucket, rows, places_in in dealt:
                    for part, k in by_part(bucket):
                        k = rows[k]
                        k = k[multikey_order(right[k])]          # neighbours alike: packs better
                        out.append((part, False, pack(right[k], left[k], after[k].astype(np.uint16),
                                                      before[k].astype(np.uint16), i[k], d[k], p[k],
                                                      np.full(len(k), places_in[0], np.uint16),
                                                      np.full(len(k), places_in[1], np.uint16))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))],
                    ["bucket", "known", "blob"])

    return chosen.mapInArrow(send, "bucket int, known boolean, blob binary")


def repeated_stretches(dealt: DataFrame, size: int, gram: int) -> DataFrame:
    """(id, dh, start, end) of the removed windows of dealt surroundings."""
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [[np.zeros(0, np.int64)] for _ in range(4)]
        if pdf["known"].any():
            for c, x in zip(cols, stacked(pdf["blob"][pdf["known"]])):
                c.append(x)
        if not pdf["known"].all():
            right, left, after, before, i, d, p, least, most = stacked(pdf["blob"][~pdf["known"]])
            for places_in in offsets(size, gram):
                own = np.flatnonzero((least == places_in[0]) & (most == places_in[1]))
                if not len(own):
                    continue
                order = own[_distinct(i[own], d[own], p[own])]
                rows, low, high = repeated(right[order], left[order], after[order].astype(np.int64),
                                           before[order].astype(np.int64), size, gram, places_in)
                k = order[rows]
                for c, x in zip(cols, (i[k], d[k], p[k] - high, p[k] - low + size)):
                    c.append(x)
        return pd.DataFrame(dict(zip(("id", "dh", "start", "end"), map(np.concatenate, cols))))

    return dealt.groupBy("bucket").applyInPandas(search, "id long, dh long, start long, end long")


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint stretches (touching ones joined) of spans (n x 2)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    heads = np.flatnonzero(new)
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], axis=1)


def cut_texts(found: DataFrame) -> DataFrame:
    """(id, dh, n_removed, n_spans, kept, kept_sha256) of packed texts with their spans."""
    def run(batches):
        for batch in _row_blocks(batches):
            raw, off = _unpacked(batch.column("text"))
            spans = batch.column("spans")
            ends = spans.offsets.to_numpy()
            start, end = (spans.values.field(k).to_numpy() for k in (0, 1))
            out = []
            for r in range(batch.num_rows):
                text = raw[off[r]:off[r + 1]]
                own = merged(np.stack([start[ends[r]:ends[r + 1]], end[ends[r]:ends[r + 1]]], axis=1))
                keep = np.ones(len(text), bool)
                for a, b in own:
                    keep[a:b] = False
                kept = text[keep].tobytes()
                out.append((int((~keep).sum()), len(own), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("dh")] + [pa.array([x[j] for x in out], t) for j, t in enumerate(
                    (pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                ["id", "dh", "n_removed", "n_spans", "kept", "kept_sha256"])

    return found.mapInArrow(run, "id long, dh long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
          gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``,
    the remaining bytes (``kept``: null where nothing was removed and the text stays as it is)."""
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("dh", F.xxhash64("sha"))
    meta = materialize(rows.groupBy("sha", "dh", "id").agg(
        F.max(F.octet_length("text")).cast("long").alias("n_bytes"), F.count(F.lit(1)).cast("int").alias("copies")), "meta")
    first = meta.filter(F.col("n_bytes") >= size).groupBy("sha", "dh").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("first_id"))
    total, n_rows = meta.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, least, math.ceil(total / PART_BYTES))
    long_ = rows.filter(F.octet_length("text") >= size)
    found = materialize(repeated_anchors(long_, parts, size, gram), "anchors")
    n_anchors = found.filter("pos >= 0").count()
    hot = found.filter(F.col("pos") < -1 - max(LEAST_HOT, n_anchors // HOT_RUNS)).select("dh").collect()   # below HOT_RUNS
    hot = np.array(sorted(r.dh for r in hot), np.int64).view(np.uint64)
    places = found.filter("pos >= 0").groupBy("dh").agg(F.collect_set("pos").alias("places"))
    wanted = first.select("dh", F.col("first_id").alias("id")).distinct().join(places, "dh")

    def with_texts(keys: DataFrame, extra: str) -> DataFrame:
        texts = _pack_text(long_.select("id", "dh", "text")).alias("t")
        k = keys.select(F.col("id").alias("k_id"), F.col("dh").alias("k_dh"), extra).hint("merge")
        met = texts.join(k, F.col("t.id").eqNullSafe(F.col("k_id")) & (F.col("t.dh") == F.col("k_dh")))
        return met.select("id", "dh", "text", extra)

    cuts = splitters(long_, parts, n_rows)
    dealt = dealt_surroundings(with_texts(wanted, "places"), cuts, parts, size, gram, hot)
    stretches = materialize(repeated_stretches(dealt, size, gram), "stretches")
    spans = stretches.groupBy(F.when(F.col("id") != int(LAST), F.col("id")).alias("id"), "dh").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = cut_texts(with_texts(spans, "spans").dropDuplicates(["id", "dh"]))
    if not with_text:
        cut = cut.drop("kept")
    return _answer(meta, first, cut, id_col, size, with_text)


def _answer(meta, first, cut, id_col, size, with_text):
    m = meta.join(first.withColumnRenamed("sha", "f_sha").drop("dh"), F.col("sha") == F.col("f_sha"), "left")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    m = m.withColumn("is_first", (F.col("n_bytes") < size) | (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)))
    c = cut.withColumnRenamed("id", "c_id").withColumnRenamed("dh", "c_dh").hint("merge")
    m = m.join(c, F.col("is_first") & F.col("id").eqNullSafe(F.col("c_id")) & (F.col("dh") == F.col("c_dh")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = [F.col("id").alias(id_col), "n_bytes",
           F.when(F.col("is_first"), F.coalesce("n_removed", F.lit(0))).otherwise(F.col("n_bytes")).alias("n_removed"),
           F.when(F.col("is_first"), F.coalesce("n_spans", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_spans"),
           F.when(F.col("is_first"), F.coalesce("kept_sha256", "sha")).otherwise(nothing).alias("kept_sha256")]
    if with_text:
        out.append(F.when(F.col("is_first"), F.col("kept")).otherwise(F.lit(b"")).alias("kept"))
    return m.select(*out)
