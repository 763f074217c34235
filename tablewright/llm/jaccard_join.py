"""Exact Jaccard join of texts as sets of word n-grams, with set-relation skipping.

A set is kept as sorted 48-bit hashes of its distinct n-grams; equal sets take part once, under
a 64-bit hash of the whole set. Two sets link when ``100 * both >= percent * either``.

1. Where sets are made, a set is compared with the leader of a list of one of its first few
   grams; so is, once over all, each set with the first set of such a list. What it lacks of
   that leader's grams, and has besides, is kept as counts and 64-bit masks: from these follow
   bounds of its overlap with any other set of the same leader.
2. Inverted lists hold the grams that a linked pair must share: the first
   ``n - ceil(t n) + 1`` of each set in one order for all (frequent grams last, by a sketch of
   counts over all sets; grams that only one set has, by a second sketch, have no list). An
   entry names the set, its size and the gram's position. Sets of two components that are
   neighbours in several lists are compared first: all of a group of close sets are in one
   component after a number of pairs linear in its size. Then lists are sorted by size and read
   in blocks; a pair of blocks is skipped when its sizes or positions allow no link, or when
   all its sets are linked already, and a pair of sets when the leader that both have tells
   so. What several lists say of a pair is added up, and the pair is dropped when the grams
   left after its last common position, or after the prefix that ends first, can't make up a
   link.
3. Of the pairs of two components one is compared, in a few turns; pairs of what is one
   component then are done with. For a remaining pair (x, y) with leaders (p, q) the overlap of the leaders is computed once;
   |x and y| lies between it less |p - x| + |q - y| and it plus |x - p| + |y - q|. That decides
   many pairs; for the others the overlap is computed.

Components are exact: a pair of sets is left out only when it can't link or when it is in
one component already. Lists with more than ``LIST`` entries in several components are dealt
to tasks by pairs of salts.

Defined cases: a null, empty or wordless text has an empty set, linked with nothing; with fewer
words than ``n`` the whole sequence is the one gram; ASCII capitals count as small; repeated
rows and equal texts are linked; a null id is never a component's id unless it has no other;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.blobs import by_part, pack, rolling_hash, small, unpack, wide
from tablewright.llm.common import column_bytes, materialize, mix64, pick, slices, text_lengths
from tablewright.llm.components import components
from tablewright.llm.quality_model import word_hashes
from tablewright.llm.simhash_dedup import local_roots

SLICE_BYTES = 4 << 20      # text whose sets are compared in place
PIECE_BYTES = 1 << 20      # text or packed sets worked on at once
WIDTH = 6                  # bytes of a gram's hash
BITS = 8 * WIDTH
HEADS = 6                  # first grams by which a leader is looked for
SKETCH = 16                # first grams that a leader must mostly share
LEADERS = 8                # leaders of a list
COUNT_BITS = 20            # buckets of the sketch that finds frequent grams
MAX_PAIR_BITS = 27         # buckets of the sketch that finds shared grams, at most
PART_BITS = 16             # buckets that one task counts
ID_BITS = 23               # bits of the screen for sets that are compared
LIST = 50_000              # entries that one task crosses
#: What a list's entry tells of its set: component, leader, size of the leader, what it lacks
#: of the leader and has besides.
MASKS = 4
DIFFERENCES = [f"{c}{i}" for c in ("lacks", "adds") for i in range(MASKS)]
KNOWN = ["sid", "n", "comp", "ref", "m", "less", "more", *DIFFERENCES]
FEW_LINKS = 1 << 20        # links (16 bytes each) that one task joins to components
SMALL = 128                # entries of a block
TURNS = 3                  # times that one pair of every two components is compared before the rest


def needed(na, nb, percent: int):
    """The least overlap of two linked sets."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n, percent: int):
    """Grams of a set of n that hold one of any linked set's (numbers, arrays or columns)."""
    least = F.ceil(percent * n / 100) if isinstance(n, Column) else -(-percent * n // 100)
    return n - least + 1


def _cut(batches, rows=1 << 16):
    """Batches of at most 65,536 rows: a row's number shares 64 bits with a gram."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gram_sets(raw: np.ndarray, off: np.ndarray, gram: int):
    """Sorted distinct gram hashes of each text, one after another, and their offsets."""
    words, word_off = word_hashes(raw, off)
    n_words = np.diff(word_off)
    counts = np.maximum(n_words - gram + 1, 0)
    every = mix64(rolling_hash(words, gram)) if len(words) >= gram else np.zeros(0, np.uint64)
    starts = np.repeat(word_off[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    doc = np.repeat(np.arange(len(counts)), counts)
    value = every[starts]
    few = np.flatnonzero((n_words > 0) & (n_words < gram))
    if len(few):
        with np.errstate(over="ignore"):
            whole = []
            for i in few.tolist():
                h = np.uint64(n_words[i])
                for w in words[word_off[i]:word_off[i + 1]]:
                    h = mix64(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w], np.uint64))[0]
                whole.append(h)
        doc, value = np.concatenate([doc, few]), np.concatenate([value, np.array(whole, np.uint64)])
    key = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | (value >> np.uint64(64 - BITS)))
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    return key & np.uint64((1 << BITS) - 1), np.searchsorted(owner, np.arange(len(counts) + 1))


def _pieces(batch, name: str):
    """Parts of a batch by the bytes of a packed or text column."""
    return slices(batch, text_lengths(batch, name), PIECE_BYTES)


def unpacked(col: pa.Array):
    """A column of packed sets as (grams, offsets)."""
    raw, off = column_bytes(col)
    return wide(raw.reshape(-1, WIDTH)), off // WIDTH


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def masks(grams: np.ndarray) -> list[int]:
    """``MASKS`` times a bit of 64 for each gram, together."""
    return [int(np.bitwise_or.reduce(np.uint64(1) << ((grams >> np.uint64(6 * i)) & np.uint64(63)), initial=np.uint64(0))
                .astype(np.int64)) for i in range(MASKS)]


def compared(a: np.ndarray, b: np.ndarray):
    """Overlap of two sorted sets, masks of what a lacks of b, masks of what a has besides."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    there = b[at] == a
    lacks = np.ones(len(b), bool)
    lacks[at[there]] = False
    return [int(there.sum()), *masks(b[lacks]), *masks(a[~there])]


def _local_leaders(grams, off, percent: int):
    """For each set of a slice its leader among the earlier ones (-1: none) and their overlap;
    a repeated set is its first row's copy (-2)."""
    lead, both = np.full(len(off) - 1, -1), np.zeros(len(off) - 1, np.int64)
    first, seen = {}, set()
    names = np.zeros(len(off) - 1, np.int64)
    raw = small(grams, WIDTH).tobytes()
    for i in range(len(off) - 1):
        own = grams[off[i]:off[i + 1]]
        if not len(own):
            continue
        name = xxhash.xxh3_64_intdigest(raw[off[i] * WIDTH:off[i + 1] * WIDTH])
        names[i] = np.uint64(name).astype(np.int64)
        if name in seen:
            lead[i] = -2
            continue
        seen.add(name)
        for g in own[:HEADS].tolist():
            j = first.get(g)
            if j is not None:
                n, m = len(own), int(off[j + 1] - off[j])
                if 100 * min(n, m) >= percent * max(n, m):
                    o = overlap(own, grams[off[j]:off[j + 1]])
                    if o >= needed(n, m, percent):
                        lead[i], both[i] = j, o
                        break
        if lead[i] == -1:
            for g in own[:HEADS].tolist():
                first.setdefault(g, i)
    return names, lead, both, raw


def build_sets(docs: DataFrame, id_col: str, text_col: str, gram: int, percent: int) -> DataFrame:
    """(id, n, sid, grams, lead, both): ``grams`` is null for empty sets and for copies of a
    set of the same slice; ``lead`` is the linked leader found in the slice."""
    def run(batches):
        for whole in batches:
            for batch in _cut(slices(whole, text_lengths(whole, "text"), SLICE_BYTES)):
                parts = [gram_sets(*column_bytes(b.column("text")), gram) for b in _pieces(batch, "text")]
                grams = np.concatenate([g for g, _ in parts])
                ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))])
                names, lead, both, packed = _local_leaders(grams, ends, percent)
                n = np.diff(ends)
                empty, led = n == 0, lead >= 0
                blobs = [None if empty[i] or lead[i] == -2 else packed[ends[i] * WIDTH:ends[i + 1] * WIDTH]
                         for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n), pa.array(names, mask=empty), pa.array(blobs, pa.binary()),
                     pa.array(names[np.maximum(lead, 0)], mask=~led), pa.array(both, mask=~led)],
                    ["id", "n", "sid", "grams", "lead", "both"])

    rows = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, sid long, grams binary, lead long, both long")


# -- sketches ---------------------------------------------------------------------------

def _counted(rows: DataFrame, of, bits: int, least, part_bits: int) -> np.ndarray:
    """A bit for each of 2^bits buckets: whether at least ``least`` of the buckets that
    ``of(grams)`` names over all rows are that one. Counted in tasks by parts of the buckets."""
    part_bits = min(part_bits, bits)

    def count(batches):
        for batch in batches:
            bucket, times = np.unique(np.concatenate([of(b) for b in _pieces(batch, "grams")]), return_counts=True)
            parts, blobs = [], []
            for part, at in by_part(bucket >> part_bits):
                low = (bucket[at] & ((1 << part_bits) - 1)).astype(np.uint32)
                parts.append(part)
                blobs.append(pack(np.diff(low, prepend=np.uint32(0)), times[at].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << part_bits, np.int64)
        for blob in pdf["blob"]:
            step, times = unpack(blob)
            total[np.cumsum(step.astype(np.int64))] += times          # each bucket once a blob
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(total >= least).tobytes()]})

    out = np.zeros(1 << bits >> 3, np.uint8)
    size = 1 << part_bits >> 3
    found = rows.mapInArrow(count, "part int, blob binary").groupBy("part").applyInPandas(merge, "part int, bits binary")
    for r in found.collect():          # 2^bits bits in all, whatever the size of the table
        out[r.part * size:(r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def marked(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams & np.uint64((1 << bits) - 1)).astype(np.int64)


def frequent_grams(sets: DataFrame, total: int) -> np.ndarray:
    """Marks buckets with clearly more grams than others; their grams come last in order."""
    mean = total / (1 << COUNT_BITS)
    return _counted(sets.select("grams"), lambda b: _bucket(unpacked(b.column("grams"))[0], COUNT_BITS).astype(np.int32),
                    COUNT_BITS, mean + 8 * math.sqrt(mean) + 64, PART_BITS)


def ordered_prefixes(col: pa.Array, often: np.ndarray, percent: int):
    """Prefix entries of packed sets: (set, gram, position, size)."""
    grams, off = unpacked(col)
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(owner * 2 + marked(often, _bucket(grams, COUNT_BITS)), kind="stable")
    position = np.arange(len(grams)) - np.repeat(off[:-1], n)
    head = position < np.repeat(prefix_length(n, percent), n)
    return owner[head], grams[order][head], position[head], np.repeat(n, n)[head]


PAIR = ["a", "b", "na", "nb", "both", *DIFFERENCES]

# -- exact overlaps -----------------------------------------------------------------------

def screened_sets(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, grams) of the sets that ``pairs`` (a, b) name, and few others: a screen of fixed
    size is built from the pairs, so that the sets in no pair are not shuffled."""
    screen = 1 << ID_BITS
    spot = F.pmod(F.xxhash64("sid"), F.lit(screen))
    named = pairs.select(F.explode(F.array("a", "b")).alias("sid")).select(spot.alias("spot"))
    found = named.groupBy(F.shiftright("spot", 15).alias("part")).agg(
        F.expr("bitmap_construct_agg(spot & 32767)").alias("bits")).collect()    # 2^ID_BITS bits in all
    bits = np.zeros(screen >> 3, np.uint8)
    for r in found:
        own = np.frombuffer(r.bits, np.uint8)
        bits[r.part * 4096:r.part * 4096 + len(own)] = own

    def keep(batches):
        for batch in batches:
            at = batch.column("spot").to_numpy(zero_copy_only=False)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            some = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([some.column("sid"), some.column("grams")], ["sid", "grams"])

    return sets.filter("grams is not null").select("sid", "grams", spot.alias("spot")).mapInArrow(
        keep, "sid long, grams binary").groupBy("sid").agg(F.first("grams").alias("grams"))


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, both, lacks…, adds…) for distinct pairs (a, b) of sets: the masks of the grams
    of b that a lacks, and of those that a has besides."""
    pairs = materialize(pairs, "asked")

    def run(batches):
        for batch in (b for whole in batches for b in _pieces(whole, "xg")):
            x, x_off = unpacked(batch.column("xg"))
            y, y_off = unpacked(batch.column("yg"))
            told = [compared(x[x_off[i]:x_off[i + 1]], y[y_off[i]:y_off[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(np.diff(x_off)), pa.array(np.diff(y_off)),
                 *[pa.array([t[i] for t in told], pa.int64()) for i in range(1 + 2 * MASKS)]], PAIR)

    held = screened_sets(sets, pairs)
    x = held.select(F.col("sid").alias("a"), F.col("grams").alias("xg"))
    y = held.select(F.col("sid").alias("b"), F.col("grams").alias("yg"))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "xg", "yg").mapInArrow(
        run, ", ".join(f"{c} long" for c in PAIR)), "overlaps")


def linked(percent: int):
    return (100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))


# -- leaders ------------------------------------------------------------------------------

def leader_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets ``a`` with a leader ``b``: one of the first sets of a list of one of their
    first grams whose size allows a link and whose first grams are mostly theirs too. (What it
    finds bears on the work left alone: all links are found by the lists.)"""
    def heads(batches):
        for batch in (b for whole in batches for b in _pieces(whole, "grams")):
            grams, off = unpacked(batch.column("grams"))
            n = np.diff(off)
            take = np.minimum(n, HEADS)
            owner = np.repeat(np.arange(len(n)), take)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
            first = [small(grams[a:a + min(SKETCH, m)], 4).tobytes() for a, m in zip(off, n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[off[owner] + nth].astype(np.int64)), batch.column("sid").take(pa.array(owner)),
                 pa.array(n[owner]), pa.array([first[i] for i in owner.tolist()], pa.binary())],
                ["gram", "sid", "n", "first"])

    entries = sets.filter("grams is not null").select("sid", "grams").mapInArrow(
        heads, "gram long, sid long, n long, first binary")

    def star(batches):
        at, held = None, []
        for batch in batches:
            gram, sid, n = (batch.column(c).to_pylist() for c in ("gram", "sid", "n"))
            first = batch.column("first").to_pylist()
            a, b = [], []
            for i in range(batch.num_rows):
                if at != gram[i]:
                    at, held = gram[i], []
                own = set(np.frombuffer(first[i], "<u4").tolist())
                for leader, size, grams in held:
                    if 100 * min(n[i], size) >= percent * max(n[i], size) and \
                            3 * len(own & grams) >= 2 * min(len(own), len(grams)):
                        if sid[i] != leader:
                            a.append(sid[i])
                            b.append(leader)
                        break
                else:
                    if len(held) < LEADERS:
                        held.append((sid[i], n[i], own))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # one order of the sets in all lists: most sets of a group of close ones get one leader
    dealt = entries.repartition("gram").sortWithinPartitions("gram", F.xxhash64("sid"), "sid")
    met = dealt.mapInArrow(star, "a long, b long")
    pairs = materialize(met.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("b")), "stars")
    for _ in range(2):                  # a leader's own leader, if it comes before it, is its sets' leader too
        up = pairs.select(F.col("a").alias("b"), F.col("b").alias("c")).filter(F.xxhash64("c") < F.xxhash64("b"))
        pairs = pairs.join(up, "b", "left").select("a", F.when(F.col("c") != F.col("a"), F.col("c")).otherwise(F.col("b")).alias("b"))
    return pairs


def joined_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b). A graph of at most ``FEW_LINKS`` distinct
    links is settled in one task; a larger one by distributed contraction."""
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .filter("a != b").distinct(), "edges")
    if links.count() > FEW_LINKS:
        return components(links)

    def settle(batches):
        ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        a, b = (np.concatenate([e[i] for e in ends]) if ends else np.zeros(0, np.int64) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(nodes), [(at[:len(a)], at[len(a):])])
        for s in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[s:s + 10_000]), pa.array(nodes[root[s:s + 10_000]])], ["node", "root"])

    return materialize(links.coalesce(1).mapInArrow(settle, "node long, root long"), "roots")


# -- lists --------------------------------------------------------------------------------

def shared_entries(sets: DataFrame, percent: int, total: int) -> DataFrame:
    """(gram, sid, n, pos): the list entries of grams that more than one set may have."""
    held = sets.filter("grams is not null").select("sid", "grams")
    often = frequent_grams(held, total)
    bits = min(MAX_PAIR_BITS, max(16, math.ceil(math.log2(max(1, total)))))
    twice = _counted(held.select("grams"), lambda b: _bucket(ordered_prefixes(b.column("grams"), often, percent)[1], bits).astype(np.int32),
                     bits, 2, PART_BITS + 2)

    def run(batches):
        for batch in (b for whole in batches for b in _pieces(whole, "grams")):
            owner, gram, pos, n = ordered_prefixes(batch.column("grams"), often, percent)
            hit = marked(twice, _bucket(gram, bits))
            owner = owner[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[hit].astype(np.int64)), batch.column("sid").take(pa.array(owner)),
                 pa.array(n[hit].astype(np.int32)), pa.array(pos[hit].astype(np.int32))], ["gram", "sid", "n", "pos"])

    return held.mapInArrow(run, "gram long, sid long, n int, pos int").distinct()


def neighbour_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of two components that stand side by side in several lists and can link by
    what is known of them. Half of the lists are ordered by a hash of the sets, half by their
    leaders and what they lack of them."""
    def run(batches):
        last = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", *KNOWN)]
            if last is not None:
                now = [np.concatenate([x, y]) for x, y in zip(last, now)]
            last = [c[-1:] for c in now]
            gram, known = now[0], dict(zip(KNOWN, now[1:]))
            a = np.flatnonzero(gram[1:] == gram[:-1])
            a = a[possible(known, a, a + 1, percent)]
            sid, n = known["sid"], known["n"]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[a], sid[a + 1])), pa.array(np.maximum(sid[a], sid[a + 1])),
                                              pa.array(np.minimum(n[a], n[a + 1]))], ["a", "b", "low"])

    by_leader = F.pmod("gram", F.lit(2)) == 0
    ordered = entries.withColumn("o1", F.when(by_leader, F.col("ref")).otherwise(F.xxhash64("sid"))).withColumn(
        "o2", F.when(by_leader, F.col("lacks0")).otherwise(0)).repartition("gram").sortWithinPartitions(
        "gram", "o1", "o2", "adds0", "sid").select("gram", *KNOWN)
    met = ordered.mapInArrow(run, "a long, b long, low long").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("lists"), F.min("low").alias("low"))
    return met.filter(F.col("lists") >= F.least(F.lit(3), F.ceil(prefix_length(F.col("low"), percent) / 4))).select("a", "b")


def possible(known: dict, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries a and b are of two components and may link by their sizes and, where
    they have one leader, by what each lacks of it (``less`` grams, of the masks ``lacks…``) and
    has besides (``more``, ``adds…``): grams whose bit the other has not are not the other's."""
    def both(count, name):
        most = np.minimum(known[count][a], known[count][b])
        for i in range(MASKS):
            x, y = (known[f"{name}{i}"][k].view(np.uint64) for k in (a, b))
            most = np.minimum(most, np.minimum(known[count][a] - np.bitwise_count(x & ~y).astype(np.int64),
                                               known[count][b] - np.bitwise_count(y & ~x).astype(np.int64)))
        return most

    na, nb = known["n"][a], known["n"][b]
    ok = (known["comp"][a] != known["comp"][b]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    most = known["m"][a] - known["less"][a] - known["less"][b] + both("less", "lacks") + both("more", "adds")
    return ok & ((known["ref"][a] != known["ref"][b]) | (most >= needed(na, nb, percent)))


def can_link(na, nb, i, j, percent: int):
    """Whether sets of sizes na and nb with a common gram at positions i and j can link."""
    return np.minimum(i, j) + 1 + np.minimum(na - i, nb - j) - 1 >= needed(na, nb, percent)


def cross(key, known: dict, pos, side, percent: int):
    """Index pairs of entries of one list and two components that can link. The entries come
    sorted by list and size; short lists are paired by distance, long ones by blocks."""
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(key))
    out_a, out_b = [], []
    n, comp = known["n"], known["comp"]

    def tried(a, b):
        hit = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] < 0))
        a, b = a[hit], b[hit]
        hit = possible(known, a, b, percent)
        a, b = a[hit], b[hit]
        hit = can_link(n[a], n[b], pos[a], pos[b], percent)
        out_a.append(a[hit])
        out_b.append(b[hit])

    last = np.repeat(ends, ends - starts)
    short = np.repeat(ends - starts <= SMALL, ends - starts)
    live = np.flatnonzero(short & (np.arange(len(key)) + 1 < last))
    ahead = 1
    while len(live):
        tried(live, live + ahead)
        ahead += 1
        live = live[live + ahead < last[live]]
        live = live[100 * n[live + ahead] * percent <= 10_000 * n[live]]     # sizes only grow
    for s, e in zip(starts[ends - starts > SMALL].tolist(), ends[ends - starts > SMALL].tolist()):
        heads = np.arange(s, e, SMALL)
        tails = np.minimum(heads + SMALL, e)
        low, high = n[heads], n[tails - 1]
        near = np.array([pos[a:b].min() for a, b in zip(heads, tails)])
        one = np.array([comp[a] if (comp[a:b] == comp[a]).all() else -1 for a, b in zip(heads, tails)])
        mixed = np.array([(comp[a:b] != comp[a]).any() for a, b in zip(heads, tails)])
        for i in range(len(heads)):
            others = np.arange(i, len(heads))
            fit = (100 * high[i] >= percent * low[others]) & (mixed[i] | mixed[others] | (one[others] != one[i]))
            # by the closest positions and the greatest sizes of both blocks
            most = np.minimum(high[i] - near[i], high[others] - near[others])
            fit &= most + prefix_length(high[i], percent) >= needed(low[i], low[others], percent)
            for j in others[fit].tolist():
                a = np.repeat(np.arange(heads[i], tails[i]), tails[j] - heads[j])
                b = np.tile(np.arange(heads[j], tails[j]), tails[i] - heads[i])
                if i == j:
                    a, b = a[a < b], b[a < b]
                tried(a, b)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def list_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) that can link by all lists of both, from entries (gram, pos and ``KNOWN``)."""
    spread = materialize(entries.groupBy("gram").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo != hi")
        .select("gram", F.ceil(F.col("size") / LIST).cast("int").alias("salts")), "lists")
    met = entries.join(spread, "gram")
    one = met.filter("salts = 1").select("gram", F.lit(0).alias("s"), F.lit(0).alias("t"), "pos", F.lit(-1).alias("side"), *KNOWN)
    # an entry with salt u meets every salt v under (least, greatest); its side tells u from v
    own = F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int")
    many = met.filter("salts > 1").withColumn("u", own).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "gram", F.least("u", "v").alias("s"), F.greatest("u", "v").alias("t"), "pos",
        F.when(F.col("u") == F.col("v"), F.lit(-1)).otherwise(F.col("u")).alias("side"), *KNOWN)
    names = ["gram", "s", "t", "pos", "side", *KNOWN]

    def run(batches):
        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if kept is not None:
                now = [np.concatenate([k, c]) for k, c in zip(kept, now)]
            if not len(now[0]):
                continue
            key = np.stack(now[:3], axis=1)
            open_ = int(np.flatnonzero((key == key[-1]).all(axis=1))[0])     # the last list may go on
            kept = [c[open_:] for c in now]
            yield from paired([c[:open_] for c in now])
        if kept is not None:
            yield from paired(kept)

    def paired(c):
        known, pos = dict(zip(KNOWN, c[5:])), c[3]
        a, b = cross(np.stack(c[:3], axis=1), known, pos, c[4], percent)
        sid, n = known["sid"], known["n"]
        swap = sid[a] > sid[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (sid[a], sid[b], n[a], n[b], pos[a], pos[b])], ["a", "b", "na", "nb", "i", "j"])

    dealt = one.unionByName(many).repartition("gram", "s", "t").sortWithinPartitions("gram", "s", "t", "n", "pos", "sid")
    pairs = dealt.mapInArrow(run, "a long, b long, na long, nb long, i long, j long")
    together = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"),
                                           F.count(F.lit(1)).alias("common"), F.max("i").alias("i"), F.max("j").alias("j"))
    # grams are in one order: what is common besides comes after the last common position
    most = F.col("common") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1
    # and what is common in the prefix that ends first is counted whole: the rest is after it
    most = F.least(most, F.col("common") + F.greatest(
        *[F.col(c) - prefix_length(F.col(c), percent) for c in ("na", "nb")]))
    return together.filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def joining_pairs(sets: DataFrame, pairs: DataFrame, links: DataFrame, percent: int):
    """The pairs (a, b) that are of two components yet, and the links with those found on the
    way: in each turn one pair of every two components is compared, and what it joins is one
    component. Two large components with many links take one comparison, not all of them."""
    for turn in range(TURNS):
        known = joined_components(links)
        root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731,B023
        at = pairs.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left").select(
            "a", "b", F.coalesce("a_root", "a").alias("p"), F.coalesce("b_root", "b").alias("q"))
        pairs = materialize(at.filter("p != q"), "open")
        one = pairs.groupBy(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(
            F.min_by(F.struct("a", "b"), F.xxhash64("a", "b", F.lit(turn))).alias("pair"), F.count(F.lit(1)).alias("pairs"))
        found = overlaps(sets, one.filter("pairs > 1").select("pair.*")).filter(linked(percent)).select("a", "b")
        if found.isEmpty():
            break
        links = materialize(links.unionByName(found), "links")
    known = joined_components(links)
    still = pairs.select("a", "b").join(known.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left").join(
        known.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left").filter(
        F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")
    return materialize(still, "pairs"), links


def derived(sets: DataFrame, pairs: DataFrame, led: DataFrame, percent: int) -> DataFrame:
    """The linked pairs (a, b) of ``pairs``; ``led`` holds (sid, lead, less, more): how many
    grams of the leader the set lacks and how many it has besides."""
    side = lambda c: led.select(F.col("sid").alias(c), F.col("lead").alias(f"{c}_lead"),
                                F.col("less").alias(f"{c}_less"), F.col("more").alias(f"{c}_more"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.coalesce("a_lead", "a").alias("p"), F.coalesce("b_lead", "b").alias("q"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a_less", "a_more", "b_less", "b_more")])
    known = materialize(known.withColumn("lo", F.least("p", "q")).withColumn("hi", F.greatest("p", "q")), "known")
    base = overlaps(sets, known.select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()).select(
        F.col("a").alias("lo"), F.col("b").alias("hi"), "both",
        F.col("na").alias("n_lo"), F.col("nb").alias("n_hi"))
    told = known.join(base, ["lo", "hi"])
    # sizes follow from the leaders'; the overlap lies between ``least`` and ``most``
    size = (F.col("n_lo") + F.col("n_hi") - F.col("a_less") - F.col("b_less") + F.col("a_more") + F.col("b_more"))
    told = told.withColumn("want", percent * size).withColumn(
        "least", (100 + percent) * (F.col("both") - F.col("a_less") - F.col("b_less"))).withColumn(
        "most", (100 + percent) * (F.col("both") + F.col("a_more") + F.col("b_more")))
    told = materialize(told.filter("most >= want").select("a", "b", (F.col("least") >= F.col("want")).alias("sure")), "told")
    open_ = told.filter("not sure").select("a", "b")
    rest = overlaps(sets, open_).filter(linked(percent)).select("a", "b")
    return told.filter("sure").select("a", "b").unionByName(rest)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 4,
                 percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set) and component_id."""
    sets = materialize(build_sets(docs, id_col, text_col, gram, percent), "sets")
    refs = overlaps(sets, leader_pairs(sets, percent)).select(
        F.col("a").alias("sid"), F.col("b").alias("ref"), F.col("nb").alias("m"), (F.col("nb") - F.col("both")).alias("less"),
        (F.col("na") - F.col("both")).alias("more"), *DIFFERENCES, linked(percent).alias("linked"))
    local = sets.filter("lead is not null").select(F.col("sid").alias("a"), F.col("lead").alias("b"))
    links = materialize(local.unionByName(refs.filter("linked").select(F.col("sid").alias("a"), F.col("ref").alias("b"))), "links")
    total = sets.filter("grams is not null").agg(F.sum("n")).first()[0] or 0
    every = shared_entries(sets, percent, total).join(refs.drop("linked"), "sid", "left").select(
        "gram", "pos", "sid", "n", F.coalesce("ref", "sid").alias("ref"), F.coalesce("m", "n").alias("m"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("less", "more", *DIFFERENCES)])
    every = materialize(every, "every")

    def entries():
        known = joined_components(links).withColumnRenamed("node", "sid")
        return every.join(known, "sid", "left").select("gram", "pos", *[
            F.coalesce("root", "sid").alias(c) if c == "comp" else F.col(c) for c in KNOWN])

    more = overlaps(sets, neighbour_pairs(entries(), percent)).filter(linked(percent)).select("a", "b")
    links = materialize(links.unionByName(more), "links")
    pairs = materialize(list_pairs(materialize(entries(), "entries"), percent), "pairs")
    led = refs.select("sid", F.col("ref").alias("lead"), "less", "more")
    pairs, links = joining_pairs(sets, pairs, links, percent)
    roots = joined_components(links.unionByName(derived(sets, pairs, led, percent)))

    named = sets.select("id", "n", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "id", "n", "sid", F.coalesce("root", "sid").alias("root"))
    lowest = named.filter("sid is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    linked_rows = named.filter("sid is not null").join(lowest, "root").select("id", "n", "component_id")
    alone = named.filter("sid is null").select("id", "n", F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
