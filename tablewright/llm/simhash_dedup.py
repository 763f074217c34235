"""SimHash near-duplicates: all pairs of fingerprints within a few bits, by vantage points.

Distinct fingerprints are dealt to shards by a vantage-point tree that is fitted on a
bounded sample: at each node a fingerprint no farther than the radius goes inside, any other
goes outside, and one outside by no more than the wanted distance visits the inside as well.
By the triangle inequality every wanted pair meets in some shard. Each shard searches with
a tree of its own and returns one star for each group it has found; the stars are joined to
components. Where a tree can't split (most points within a few bits of the border), its
points meet by key instead: two fingerprints are within two bits exactly if they share a
value at one bit or less from both, so 65 keys for each point find the groups in linear work.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; null ids
are kept and never become a component's id unless it has no other; repeated rows stay as
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import fresh, materialize, pick, quoted, slices, text_lengths
from tablewright.llm.components import components

SEED = 42
SHARD_POINTS = 4096        # wanted points in a shard
MAX_SHARDS = 2048          # bounds the sample and the tree
SAMPLE_PER_SHARD = 32
BRUTE = 256                # points that are compared each with each in memory
BAD_SPLIT = 0.5            # a split with more visitors than this is given up
SLICE_BYTES = 4 << 20

_LANES = np.zeros(256, np.uint64)      # each byte value with its bits spread to eight lanes
for _bit in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that are set in over half of it (empty: zero)."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    blocks = (n + 254) // 255                       # lanes of a byte hold 255 rows at most
    owner = np.repeat(np.arange(len(some)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = (np.cumsum(n) - n)[owner] + 255 * nth
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    per_doc = np.add.reduceat(sums, np.cumsum(blocks) - blocks, axis=0)
    bits = per_doc * 2 > n[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of the word shingles; bytes.split and bytes.lower know ASCII alone, as wanted."""
    words = text.lower().split()
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0] + ends[:-shingle].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp): one row for each row."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text_lengths(whole, "text"), SLICE_BYTES):
                per_doc = [shingle_hashes(t, shingle) if t else [] for t in
                           batch.column("text").cast(pa.binary()).to_pylist()]
                counts = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
                flat = np.fromiter((h for d in per_doc for h in d), np.uint64, int(counts.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_hash"),
                     pa.array(majority(flat, counts).view(np.int64))], ["id", "text_hash", "fp"])

    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, f"id {kind}, text_hash long, fp long")


class Node:
    """A node of the shard tree: a leaf (``leaf`` and ``dense``) or a split."""

    __slots__ = ("leaf", "dense", "point", "radius", "inner", "outer")

    def __init__(self, leaf=-1, dense=False, point=0, radius=0, inner=None, outer=None):
        self.leaf, self.dense, self.point, self.radius = leaf, dense, point, radius
        self.inner, self.outer = inner, outer


def best_split(points: np.ndarray, distance: int, rng: np.random.Generator):
    """(vantage point, radius) with the fewest visitors among balanced splits, or None."""
    best, n = None, len(points)
    for at in rng.integers(0, n, 12):
        counts = np.bincount(np.bitwise_count(points ^ points[at]).astype(np.int64), minlength=65)
        inside = np.cumsum(counts)
        upto = np.concatenate([inside, np.full(distance, n)])
        visitors = upto[distance:distance + 65] - inside
        bigger = np.maximum(inside + visitors, n - inside)
        cost = np.where((inside >= n // 5) & (inside < n) & (visitors <= BAD_SPLIT * n) & (bigger < 0.95 * n),
                        visitors + 0.2 * bigger, np.inf)
        radius = int(np.argmin(cost))
        if np.isfinite(cost[radius]) and (best is None or cost[radius] < best[0]):
            best = (cost[radius], points[at], radius)
    return best and best[1:]


def fit_tree(sample: np.ndarray, per_leaf: int, distance: int) -> tuple[Node, int]:
    """The shard tree over a sample (uint64), and its number of leaves."""
    rng = np.random.default_rng(7)
    leaves = 0

    def grow(points):
        nonlocal leaves
        split = best_split(points, distance, rng) if len(points) > per_leaf else None
        if split is None:
            leaves += 1
            return Node(leaf=leaves - 1, dense=len(points) > per_leaf)
        point, radius = split
        d = np.bitwise_count(points ^ point)
        return Node(point=point, radius=radius, inner=grow(points[d <= radius + distance]),
                    outer=grow(points[d > radius]))

    return grow(sample), leaves


def deal(tree: Node, points: np.ndarray, distance: int):
    """(index of point, leaf, dense) for every leaf that a point belongs to or visits."""
    found = []

    def walk(node, at):
        if not len(at):
            return
        if node.inner is None:
            found.append((at, np.full(len(at), node.leaf), np.full(len(at), node.dense)))
            return
        d = np.bitwise_count(points[at] ^ node.point)
        walk(node.inner, at[d <= node.radius + distance])
        walk(node.outer, at[d > node.radius])

    walk(tree, np.arange(len(points)))
    return [np.concatenate(x) for x in zip(*found)] if found else [
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]


def _by_keys(points: np.ndarray):
    """Links of a set that no split helps: shared values within one bit (distance two)."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    keys = (points[:, None] ^ flips).ravel()
    owner = np.repeat(np.arange(len(points)), len(flips))
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    same = keys[1:] == keys[:-1]
    return owner[:-1][same], owner[1:][same]


def links(points: np.ndarray, distance: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect all points within ``distance``: searched with a local tree."""
    out = []

    def search(at):
        if len(at) < 2:
            return
        split = best_split(points[at], distance, rng) if len(at) > BRUTE else None
        if split is not None:
            d = np.bitwise_count(points[at] ^ split[0])
            search(at[d <= split[1] + distance])
            search(at[d > split[1]])
        elif distance == 2 and len(at) > BRUTE:
            a, b = _by_keys(points[at])
            out.append((at[a], at[b]))
        else:
            for s in range(0, len(at), BRUTE):
                near = np.bitwise_count(points[at[s:s + BRUTE], None] ^ points[at]) <= distance
                a, b = np.nonzero(near)
                a += s
                out.append((at[a[a < b]], at[b[a < b]]))

    search(np.arange(len(points)))
    return out


def local_roots(n: int, pairs) -> np.ndarray:
    """Smallest index connected to each index."""
    root = np.arange(n)
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (before == root).all():
            break
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def near_edges(points: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``distance`` bits."""
    total = points.count()
    shards = min(MAX_SHARDS, max(1, math.ceil(total / SHARD_POINTS)))
    wanted = shards * SAMPLE_PER_SHARD if shards > 1 else 0
    # picked by hash before anything is sent: ``wanted`` to twice as many fingerprints
    picked = points.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, total // max(wanted, 1)))) == 0).select("fp")
    sample = np.array(sorted(r.fp for r in picked.limit(4 * wanted).collect()) if wanted else [],
                      np.int64).view(np.uint64)
    tree, leaves = fit_tree(sample, SAMPLE_PER_SHARD, distance) if shards > 1 else (Node(leaf=0), 1)
    if distance != 2:                   # the keys know distance two alone

        def plain(node):
            node.dense = False
            for child in (node.inner, node.outer):
                if child is not None:
                    plain(child)
        plain(tree)

    def shard(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            at, leaf, dense = deal(tree, fp.view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.astype(np.int32)), pa.array(fp[at]), pa.array(dense)], ["leaf", "fp", "dense"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy(np.int64))
        root = local_roots(len(fp), links(fp.view(np.uint64), distance, np.random.default_rng(11)))
        far = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[far], "b": fp[root[far]]})

    dealt = materialize(points.select("fp").mapInArrow(shard, "leaf int, fp long, dense boolean"), "shards")
    stars = dealt.filter("not dense").groupBy("leaf").applyInPandas(search, "a long, b long")
    keyed = dealt.filter("dense").select("fp").distinct().select("fp", F.explode(F.array(
        F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])).alias("key"))
    low = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).filter("b != c")
    return stars.unionByName(keyed.join(low, "key").select(F.col("fp").alias("a"), "b").filter("a != b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               distance: int = 2) -> DataFrame:
    """One row per input row: id, text_hash, fp, root, component_id."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "points")
    roots = components(near_edges(points, distance))
    named = materialize(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.select("fp", "root").join(lowest, "root"), "fp").select(
        F.col("id").alias(id_col), "text_hash", "fp", "root", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
              distance: int = 2) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (null ids last)."""
    found = near_dedup(docs, id_col, text_col, shingle, distance)
    won = found.groupBy("root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("n"), F.col(id_col).alias("_w_id"), F.col("text_hash").alias("_w_hash"))).alias("w"))
    won = won.select("w._w_id", "w._w_hash").distinct()
    key = fresh(docs, "_text_hash")
    keyed = docs.withColumn(key, F.xxhash64(quoted(docs, text_col)))
    kept = keyed.join(won, (keyed[key] == F.col("_w_hash")) & quoted(keyed, id_col).eqNullSafe(F.col("_w_id")),
                      "left_semi")
    return kept.dropDuplicates([key, id_col]).select(*[quoted(kept, c) for c in docs.columns])
