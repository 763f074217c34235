import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hard_negatives, registry
from tablewright.llm.common import embeddings

SF = "/root/testdata/sf0.001"


def plain(rows, low=80, high=100, scale=256.0):
    """Every anchor against every row; rows are (id, label, vector)."""
    seen = {}
    for i, label, vec in rows:
        if label is None or vec is None or not all(c is not None and math.isfinite(c) for c in vec):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        x = [math.floor(scale * c) for c in vec]
        while x and x[-1] == 0:
            x.pop()
        seen[(i, label, tuple(x))] = 1
    rows, out = list(seen), []

    def ordered(found):
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))

    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(product(a[2], r[2]), r[0], r[1], r) for r in rows]
        for p in ordered([s for s in scored if s[2] == a[1] and s[3] is not a])[:5]:
            hard = ordered([s for s in scored if s[2] != a[1] and low * p[0] <= 100 * s[0] <= high * p[0]])[:5]
            out += [(a[0], p[1], i + 1, s[1], p[0], s[0]) for i, s in enumerate(hard)]
    return sorted(out, key=repr)


def mined(rows):
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(rows, F.col("id") % 100 == 0, label=moved).collect()), key=repr)


def clusters(n, dims, seed, kinds=3):
    """Tight balls, equal vectors, scattered points and a third of all rows at one place."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(kinds, dims))
    out = []
    for i in range(n):
        kind = rng.integers(4)
        v = heads[0] if i % 3 == 0 else heads[rng.integers(kinds)]
        if kind == 1:
            v = v + rng.normal(size=dims) * 0.02
        elif kind == 2:
            v = rng.normal(size=dims) * rng.uniform(0.1, 2)
        out.append((i * 5, int(rng.integers(10)), [float(c) for c in v]))
    return out


def test_query_against_every_pair(spark):
    got = registry.op13_hard_negatives(spark, SF)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"),
                          ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = plain([(r.vec_id, r.label, r.embedding) for r in embeddings(spark, SF).collect()])
    assert want and sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_shards_and_balls(spark, monkeypatch, seed):
    """Small shards and leaves: several cells, crowded cells, deep trees."""
    for name, value in (("SHARD", 100), ("LEAF", 8), ("TRIALS", 6), ("BLOCK", 4), ("GROUP", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clusters(900, 6, seed)
    assert mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")) == plain(rows)


def test_tree_covers_its_points():
    rng = np.random.default_rng(5)
    points = np.floor(np.vstack([rng.normal(size=(400, 5)) * 3 + c for c in rng.normal(size=(6, 5)) * 300]))
    space = hard_negatives.Space(int((points * points).sum(1).max()), 5)
    tree = hard_negatives.Tree(space.lift(points))

    def below(node):
        kids = tree.children[node]
        at = np.concatenate([below(k) for k in kids]) if kids else tree.points[node]
        away = np.sqrt(((tree.lifted[at] - tree.lifted[tree.center[node]]) ** 2).sum(1))
        assert away.max() <= tree.radius[node]
        return at

    assert sorted(below(0).tolist()) == list(range(len(points)))
    assert len(tree.children) > 10 and any(len(k) > 2 for k in tree.children)


def test_bounds_skip_balls(monkeypatch):
    """Few products for windows that most balls lie outside of."""
    rng = np.random.default_rng(2)
    points = np.floor(np.vstack([rng.normal(size=(200, 8)) * 2 + c for c in rng.normal(size=(40, 8)) * 200]))
    space = hard_negatives.Space(int((points * points).sum(1).max()), 8)
    tree, done = hard_negatives.Tree(space.lift(points)), []
    plain_products = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, b, e: done.append(len(a) * len(b)) or plain_products(a, b, e))
    anchors = points[::400]
    best = hard_negatives.Best(np.full((len(anchors), 1), -(1 << 62)), np.full((len(anchors), 1), 1 << 62), 5)
    hard_negatives.descend(space, tree, points, np.zeros(len(points), int), anchors, np.zeros(len(anchors), int), best, True)
    assert sum(done) < len(points) * len(anchors) / 3
    scores = points @ anchors.T
    a, p, s = best.held[0]
    for i in range(len(anchors)):
        assert s[a == i].tolist() == sorted(scores[:, i].tolist(), reverse=True)[:5]


def test_nulls_ties_repeats_lengths_and_other_columns(spark):
    rng = random.Random(4)
    rows = [(100, 1, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (100, 1, [1.0, 0.25]), (200, 2, []), (300, 1, [1.0, None]),
            (400, None, [1.0]), (500, 1, None), (600, 1, [float("nan"), 1.0]), (None, 1, [1.0, 0.5]), (None, 2, [1.0, 0.5]),
            (7, 9, [1.0]), (14, 0, [1.0, 0.5, 0.0]), (800, 3, [0.5, 0.5, 0.5]), (900, 3, [-1.0, -1.0])]
    rows += [(1000 + i, rng.randrange(4), [rng.choice([0.5, 1.0]), rng.choice([0.5, 1.0])]) for i in range(80)]
    rows += [(1, 1, [0.9, 0.5])] * 40
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows],
                                 "vec_id long, label int, embedding array<double>, rank string, score double")
    assert mined(docs) == plain(rows)
    assert mined(docs.limit(0)) == []


def test_scores_beyond_doubles(spark):
    rows = [(i * 50, i % 2, [2.0 ** 21 - i, 2.0 ** 20 + 3 * i, 5.0]) for i in range(12)]
    rows += [(5000, 0, [1e30, 1.0, 1.0]), (5100, 1, [float("inf"), 1.0, 1.0])]
    got = mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert got == plain(rows[:-2]) and any(r[4] > 2 ** 53 for r in got)
