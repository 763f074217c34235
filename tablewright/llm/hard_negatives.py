"""Hard negatives by inner product: cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, an anchor
gets a zero there; then the distance d of the two gives their inner product,
(|q|^2 + M^2 - d^2) / 2, and a ball of radius r around a point at distance d holds inner
products between those at d + r and d - r alone.

The top of the tree is a net of points from a bounded sample; each candidate belongs to its
nearest net point, whose covering radius is taken over all candidates. Cells are dealt to
shards of bounded size (a crowded cell to several), and each shard grows its own cover tree:
the points of a node are covered by balls of half its radius, level by level; what no such
ball groups stays a leaf. An anchor is sent only to the shards whose ball meets its window.
There anchors descend in blocks, best bound first; a node is skipped where its bounds miss
the window or the best scores found so far, and leaves are verified by exact products.

Positives take two rounds: the nearest cell gives a lower bound for the last positive, and
only cells that can beat it are searched after. Negatives take one round: their windows
follow from the positives' scores.

Of equal candidates (label and vector) only the first few by id can be among the first few of
anything; the others are left out by a ranking inside the group, exactly.

Defined cases: rows with a null label or vector, or any null or non-finite component, take no
part, nor do rows with a scaled component of 2^31 or a scaled squared norm of 2^62 and more
(their scores need not fit a long). Vectors of several lengths are filled up with zeros; an
empty vector is zero. Rows that repeat another in id, label and vector count once; rows that
share only the id are rows of their own, ties between them by label. A null id is no anchor;
as a partner it comes after all others of its score. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import materialize, pick

SHARD = 16_384             # candidates of a shard
GROUP = 65_536             # anchors that meet a shard in one task
BLOCK = 64                 # anchors that descend together
LEAF = 128                 # points that are not split further
TRIALS = 64                # balls tried before a node is called unstructured
NET_BYTES = 4 << 20        # bounds the net that every task gets
MAX_CELLS = 1024
SAMPLE_PER_CELL = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None,
                    scale: float) -> DataFrame:
    """(id, anon, label, vec, norm): vectors as little-endian int32 without trailing zeros;
    a null id is marked ``anon`` and stands as zero (pandas has no null among longs)."""
    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten()
            off = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale if len(flat) else np.zeros(0)
            fit = np.isfinite(x) & (np.abs(np.floor(x)) < 2.0 ** 31)
            whole = np.where(fit, np.floor(x), 0).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~fit)])
            square = [float((whole[a:b].astype(float) ** 2).sum()) for a, b in zip(off, off[1:])]
            keep = np.flatnonzero((bad[off[1:]] == bad[off[:-1]]) & (np.array(square) < 2.0 ** 62)
                                  if len(square) else np.zeros(0, bool))
            cut = [np.trim_zeros(whole[off[i]:off[i + 1]], "b") for i in keep]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n).take(pa.array(keep)) for n in ("id", "anon", "label")],
                 pa.array([c.astype("<i4").tobytes() for c in cut], pa.binary()),
                 pa.array([int((c * c).sum()) for c in cut], pa.int64())], ["id", "anon", "label", "vec", "norm"])

    named = pick(rows, id=id_col, label=label_col, vector=vector_col)
    named = named.filter("label is not null and vector is not null").select(
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNull().alias("anon"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("vector").cast("array<double>").alias("vector"))
    return named.mapInArrow(run, "id long, anon boolean, label long, vec binary, norm long").distinct()


def matrix(vecs, width: int) -> np.ndarray:
    """Packed vectors as rows of a float matrix, filled up with zeros."""
    lengths = np.fromiter((len(v) // 4 for v in vecs), np.int64, len(vecs))
    out = np.zeros((len(vecs), width))
    out[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(vecs), "<i4")
    return out


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products. Doubles hold them (and all partial sums) below 2^53."""
    if exact:
        return (a @ b.T).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):           # partial sums may wrap, the result is below 2^62
        for i in range(a.shape[1]):
            out += a[:, i, None] * b[:, i]
    return out


class Space:
    """Distances and bounds after the augmentation; ``top`` is the greatest squared norm."""

    def __init__(self, top: int, width: int):
        self.top, self.width, self.exact = float(top), width, top < 1 << 52
        self.slack = 1.0 + 1e-9 * self.top      # rounding of roots and squares

    def lift(self, points: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(0, self.top - (points * points).sum(1)))
        return np.hstack([points, last[:, None]])

    def distances(self, anchors: np.ndarray, lifted: np.ndarray) -> np.ndarray:
        """From anchors (their last component is zero) to lifted points."""
        square = (anchors * anchors).sum(1)[:, None] + self.top - 2 * (anchors @ lifted[:, :-1].T)
        return np.sqrt(np.maximum(0, square))

    def bounds(self, anchors: np.ndarray, distance: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and greatest inner product within ``radius`` of points at ``distance``."""
        total = ((anchors * anchors).sum(1) + self.top)[:, None]
        far, near = distance + radius, np.maximum(0, distance - radius)
        return (total - far * far) / 2 - self.slack, (total - near * near) / 2 + self.slack


class Tree:
    """A cover tree as lists by node: center, covering radius, children or points."""

    def __init__(self, lifted: np.ndarray):
        self.lifted, self.center, self.radius, self.children, self.points = lifted, [], [], [], []
        everything = np.arange(len(lifted))
        self._grow(everything, 0, self._away(everything, 0))

    def _away(self, at: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((self.lifted[at] - self.lifted[center]) ** 2).sum(1))

    def _grow(self, at: np.ndarray, center: int, away: np.ndarray) -> int:
        node = len(self.center)
        radius = float(away.max(initial=0)) * (1 + 1e-9) + 1e-3
        self.center.append(center)
        self.radius.append(radius)
        self.children.append([])
        self.points.append(None)
        balls, rest, rest_away = [], at, away
        if len(at) > LEAF and away.max() > 0:
            covered = 0
            for trial in range(1, len(at)):
                if not len(rest) or (trial > TRIALS and covered < 4 * trial):
                    break
                head = int(rest[0]) if trial > 1 else center
                d = self._away(rest, head)
                inside = d <= radius / 2
                balls.append((rest[inside], head, d[inside]))
                covered += int(inside.sum())
                rest, rest_away = rest[~inside], rest_away[~inside]
            small = [b for b in balls if len(b[0]) < 8]       # too few for a ball of their own
            balls = [b for b in balls if len(b[0]) >= 8]
            loose = np.concatenate([rest, *[b[0] for b in small]])
            if balls and max(len(b[0]) for b in balls) < len(at):
                kids = [self._grow(*b) for b in balls]
                if len(loose):
                    kids.append(self._leaf(np.sort(loose), center))
                self.children[node] = kids
                return node
        self.points[node] = np.sort(at)
        return node

    def _leaf(self, at: np.ndarray, center: int) -> int:
        self.center.append(center)
        self.radius.append(float(self._away(at, center).max()) * (1 + 1e-9) + 1e-3)
        self.children.append([])
        self.points.append(at)
        return len(self.center) - 1


class Best:
    """The first ``k`` candidates of each (anchor, window), by score and then by place."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.k, self.low, self.high = k, low.copy(), high
        self.held = [(np.zeros(0, np.int64),) * 3 for _ in range(low.shape[1])]

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the span of scores that can still matter (empty: low > high)."""
        some = self.low <= self.high
        return (np.where(some, self.low, HIGHEST).min(1), np.where(some, self.high, LOWEST).max(1))

    def add(self, anchor: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        for w, held in enumerate(self.held):
            hit = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
            if not hit.any():
                continue
            a, p, s = (np.concatenate([old, new[hit]]) for old, new in zip(held, (anchor, place, score)))
            order = np.lexsort((p, -s, a))
            a, p, s = a[order], p[order], s[order]
            first = np.searchsorted(a, a)
            nth = np.arange(len(a)) - first
            keep = nth < self.k
            full = nth == self.k - 1
            self.low[a[full], w] = np.maximum(self.low[a[full], w], s[full])
            self.held[w] = a[keep], p[keep], s[keep]


def descend(space: Space, tree: Tree, points: np.ndarray, labels: np.ndarray, anchors: np.ndarray,
            anchor_labels: np.ndarray, best: Best, same: bool) -> None:
    """Best-first search of one block of anchors; places of ``points`` are in order of id."""
    heap = []

    def push(nodes: list, alive: np.ndarray) -> None:
        d = space.distances(anchors[alive], tree.lifted[[tree.center[i] for i in nodes]])
        low, high = space.bounds(anchors[alive], d, np.array([tree.radius[i] for i in nodes]))
        for i, node in enumerate(nodes):
            heapq.heappush(heap, (-float(high[:, i].max()), node, alive, low[:, i], high[:, i]))

    if len(tree.lifted):
        push([0], np.arange(len(anchors)))
    while heap:
        _, node, alive, low, high = heapq.heappop(heap)
        least, most = best.reach()
        alive = alive[(high >= least[alive]) & (low <= most[alive]) & (least[alive] <= most[alive])]
        if not len(alive):
            continue
        if tree.points[node] is None:
            push(tree.children[node], alive)
            continue
        at = tree.points[node]
        score = products(anchors[alive], points[at], space.exact)
        fits = (score >= least[alive, None]) & (score <= most[alive, None])
        fits &= (labels[at] == anchor_labels[alive, None]) == same
        a, p = np.nonzero(fits)
        best.add(alive[a], at[p], score[a, p])


def search_shard(cands: pd.DataFrame, asks: pd.DataFrame, space: Space, k: int, same: bool) -> pd.DataFrame:
    """The first ``k`` candidates of one shard for each (ask, window)."""
    cands = cands.sort_values(["anon", "id", "label"], kind="stable").reset_index(drop=True)
    points = matrix(cands["vec"].tolist(), space.width)
    labels, ids, anon = (cands[c].to_numpy() for c in ("label", "id", "anon"))
    tree = Tree(space.lift(points))
    out = []
    for begin in range(0, len(asks), BLOCK):
        block = asks.iloc[begin:begin + BLOCK]
        low, high = np.stack(block["low"].to_list()), np.stack(block["high"].to_list())
        best = Best(low.astype(np.int64), high.astype(np.int64), k)
        descend(space, tree, points, labels, matrix(block["vec"].tolist(), space.width),
                block["label"].to_numpy(np.int64), best, same)
        for w, (a, p, s) in enumerate(best.held):
            out.append(pd.DataFrame({"anchor": block["anchor"].to_numpy()[a], "window": np.full(len(a), w, np.int32),
                                     "id": ids[p], "anon": anon[p], "id_label": labels[p], "score": s}))
    return pd.concat(out, ignore_index=True)


class Index:
    """Candidates in shards, with the net that routes anchors to them."""

    def __init__(self, rows: DataFrame, k: int):
        """``rows`` (id, anon, label, vec, norm): of equal candidates the first ``k`` + 1 by id stay."""
        first = Window.partitionBy("label", "vec").orderBy("anon", "id")
        cands = materialize(rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
                            .drop("nth"), "candidates")
        total, top, width = cands.agg(F.count(F.lit(1)), F.coalesce(F.max("norm"), F.lit(0)),
                                      F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
        self.k, self.space = k, Space(top, width // 4)
        self.net = self._fit_net(cands, total)
        self._deal(cands)

    def _fit_net(self, cands: DataFrame, total: int) -> np.ndarray:
        width = self.space.width + 1
        cells = max(1, min(MAX_CELLS, math.ceil(total / SHARD), NET_BYTES // (8 * width)))
        wanted = cells * SAMPLE_PER_CELL
        key = F.xxhash64("vec")
        picked = cands.filter(F.pmod(key, F.lit(max(1, total // wanted))) == 0).select("vec", key.alias("h"))
        rows = picked.orderBy("h", "vec").limit(2 * wanted).collect()
        sample = self.space.lift(matrix([r.vec for r in rows] or [b""], self.space.width))
        chosen, away = [0], np.full(len(sample), np.inf)
        while len(chosen) < min(cells, len(sample)):     # a net: the farthest point comes next
            away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
            if away.max() <= 0:
                break
            chosen.append(int(away.argmax()))
        return sample[chosen]

    def _deal(self, cands: DataFrame) -> None:
        net, space = self.net, self.space

        def cells(batches):
            for batch in batches:
                lifted = space.lift(matrix(batch.column("vec").to_pylist(), space.width))
                square = (lifted * lifted).sum(1)[:, None] + (net * net).sum(1) - 2 * (lifted @ net.T)
                cell = square.argmin(1)
                away = np.sqrt(((lifted - net[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)],
                    [*batch.schema.names, "cell", "away"])

        dealt = materialize(cands.mapInArrow(
            cells, "id long, anon boolean, label long, vec binary, norm long, cell int, away double"), "cells")
        stats = {r.cell: r for r in dealt.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}   # one row per net point
        self.radius = np.array([stats[c].radius * (1 + 1e-9) + 1e-3 if c in stats else -1.0 for c in range(len(net))])
        parts = [math.ceil(stats[c].n / SHARD) if c in stats else 0 for c in range(len(net))]
        self.first = np.concatenate([[0], np.cumsum(parts)])
        spots = F.array(*[F.lit(int(x)) for x in self.first])
        at = F.element_at(spots, F.col("cell") + 1)
        many = F.element_at(spots, F.col("cell") + 2) - at
        self.shards = dealt.select("id", "anon", "label", "vec", (
            at + F.pmod(F.xxhash64("vec", "id", "anon", "label"), many).cast("int")).alias("shard"))

    def route(self, anchors: DataFrame, nearest: bool | None) -> DataFrame:
        """``anchors`` (anchor, label, vec, low, high) with the shards each must visit: those
        of the best cell (True), of all other cells that its windows reach (False), or both."""
        net, radius, first, space = self.net, self.radius, self.first, self.space

        def run(batches):
            for batch in batches:
                q = matrix(batch.column("vec").to_pylist(), space.width)
                low = np.array([min(x) for x in batch.column("least").to_pylist()], np.int64)
                high = np.array([max(x) for x in batch.column("most").to_pylist()], np.int64)
                down, up = space.bounds(q, space.distances(q, net), np.maximum(radius, 0))
                up = np.where(radius < 0, -np.inf, up)
                best = np.arange(len(net)) == up.argmax(1)[:, None]
                open_ = (up >= low[:, None]) & (down <= high[:, None]) & (radius >= 0)
                chosen = open_ if nearest is None else open_ & best if nearest else open_ & ~best
                lists = [[s for c in np.flatnonzero(row) for s in range(first[c], first[c + 1])] for row in chosen]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in ("anchor", "label", "vec", "low", "high")],
                     pa.array(lists, pa.list_(pa.int32()))],
                    ["anchor", "label", "vec", "low", "high", "shards"])

        some = anchors.withColumn("least", F.col("low")).withColumn("most", F.col("high"))
        routed = some.mapInArrow(run, "anchor long, label long, vec binary, low array<long>, high array<long>, "
                                      "shards array<int>")
        return routed.withColumn("shard", F.explode("shards")).drop("shards")

    def search(self, anchors: DataFrame, n_anchors: int, same: bool, nearest: bool | None = None) -> DataFrame:
        """(anchor, window, id, anon, id_label, score): the first ``k`` of each shard."""
        space, k, groups = self.space, self.k, max(1, math.ceil(n_anchors / GROUP))

        def run(cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            if not len(cands) or not len(asks):
                return pd.DataFrame({n: [] for n in ("anchor", "window", "id", "anon", "id_label", "score")})
            return search_shard(cands, asks, space, k + 1 if same else k, same)

        asks = self.route(anchors, nearest).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))
        cands = self.shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return cands.groupBy("shard", "part").cogroup(asks.groupBy("shard", "part")).applyInPandas(
            run, "anchor long, window int, id long, anon boolean, id_label long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (anchor, window), numbered by ``rank``."""
    order = Window.partitionBy("anchor", "window").orderBy(
        F.col("score").desc(), "anon", "id", "id_label")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_window(low, high) -> list[Column]:
    return [F.array(F.lit(low) if not isinstance(low, Column) else low).alias("low"),
            F.array(F.lit(high) if not isinstance(high, Column) else high).alias("high")]


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", label: Column | None = None, scale: float = 256.0, positives: int = 5,
         negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition over ``id``, ``label`` an expression over ``id`` and
    ``label`` in place of the label. An anchor's positives are its first other rows of the
    same label by score (ties by id); the negatives of each are the first rows of another
    label whose score is between the two percentages of the positive's.
    """
    vectors = materialize(integer_vectors(rows, id_col, vector_col, label_col, label, scale), "vectors")
    index = Index(vectors, max(positives, negatives))
    anchors = materialize(vectors.filter(is_anchor & ~F.col("anon")).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n = anchors.count()

    def named() -> Column:
        return F.when(~F.col("anon"), F.col("id"))

    everything = anchors.select("anchor", "label", "vec", *_one_window(LOWEST, HIGHEST))
    near = materialize(index.search(everything, n, True, nearest=True), "near")
    bound = _ranked(near, positives + 1).filter(F.col("rank") == positives + 1).select(
        "anchor", F.col("score").alias("bound"))
    further = anchors.join(bound, "anchor", "left").select(
        "anchor", "label", "vec", *_one_window(F.coalesce("bound", F.lit(LOWEST)), HIGHEST))
    both = near.unionByName(index.search(further, n, True, nearest=False))
    own = anchors.select("anchor", F.col("id").alias("own"), F.col("norm").alias("square"))
    found = _ranked(both, positives + 1).join(own, "anchor").withColumn(   # anchors have ids
        "itself", (F.col("id") == F.col("own")) & ~F.col("anon") & (F.col("score") == F.col("square")))
    once = Window.partitionBy("anchor", "itself").orderBy("rank")
    partners = found.withColumn("nth", F.row_number().over(once)).filter(~F.col("itself") | (F.col("nth") > 1))
    kept = _ranked(partners.select("anchor", "window", "id", "anon", "id_label", "score"), positives)
    kept = materialize(kept.select("anchor", F.col("rank").alias("place"), named().alias("positive_id"),
                                   F.col("score").alias("positive_score")), "positives")

    lowest = F.expr(f"cast(ceil(cast(positive_score as decimal(20,0)) * {low_percent} / 100) as long)")
    highest = F.expr(f"cast(floor(cast(positive_score as decimal(20,0)) * {high_percent} / 100) as long)")
    windows = kept.withColumn("lo", lowest).withColumn("hi", highest).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("w"))    # ``positives`` at most
    asked = anchors.join(windows, "anchor").select(
        "anchor", "label", "vec", F.transform("w", lambda x: x["lo"]).alias("low"),
        F.transform("w", lambda x: x["hi"]).alias("high"))
    asked = materialize(asked.withColumn("low", F.concat("low", F.array_repeat(F.lit(HIGHEST), positives - F.size("low"))))
                        .withColumn("high", F.concat("high", F.array_repeat(F.lit(LOWEST), positives - F.size("high")))),
                        "windows")
    negative = _ranked(index.search(asked, n, False), negatives).select(
        "anchor", (F.col("window") + 1).alias("place"), "rank", named().alias("negative_id"),
        F.col("score").alias("negative_score"))
    return negative.join(kept, ["anchor", "place"]).join(own, "anchor").select(
        F.col("own").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")
