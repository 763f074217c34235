import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import registry, simhash_dedup as S
from tablewright.llm.components import components


def plain_fp(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    """rows: (id, text) with ids -> {id: (fp, component)}"""
    fps = {i: plain_fp(t) for i, t in rows}
    ids = sorted(fps)
    arr = np.array([fps[i] for i in ids], np.uint64)
    pairs = []
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr[k + 1:] ^ arr[k]) <= 2):
            pairs.append((i, ids[k + 1 + j]))
    comp = plain_components(pairs, ids)
    return {i: (f"{fps[i]:016x}", comp[i]) for i in ids}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op5_simhash"](spark, sf).collect()}
    assert got == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, fp long, root long, text_hash string, low int"
    rows = [(3, None), (2, ""), (1, " \n\t"), (4, "A b"), (5, "a  B"), (6, "one two three"), (7, "ÀB c"), (8, "àb c"),
            (9, "w " * 30_000), (10, "w " * 29_000), (10, "w " * 29_000), (None, "lonely words here now"), (None, "a b"),
            (11, "x\x85y z q"), (12, "lonely\twords\x0bhere  now")]
    df = spark.createDataFrame([r + (1, 1, "z", 1) for r in rows], schema)
    got = S.near_dedup(df).select("doc_id", S.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.f, r.component_id) == want[r.doc_id], r
    assert sorted(r.component_id for r in got if r.doc_id is None) == [4, 12]
    kept = S.keep_rows(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert S.near_dedup(df.limit(0)).count() == 0


def crafted(rng, n, clusters, size, bits):
    """Random points, chains and dense balls."""
    pts = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    out = [pts]
    for c in pts[:clusters]:
        p, chain = c, []
        for _ in range(size):
            p = p ^ (np.uint64(1) << np.uint64(rng.integers(0, bits)))
            chain.append(p)
        out.append(np.array(chain, np.uint64))
    return np.unique(np.concatenate(out))


def test_links_find_all_groups(monkeypatch):
    monkeypatch.setattr(S, "BRUTE", 16)
    rng = np.random.default_rng(5)
    for n, clusters, size, bits in ((400, 20, 10, 64), (50, 3, 300, 12), (5, 1, 900, 10)):
        pts = crafted(rng, n, clusters, size, bits)
        near = np.bitwise_count(pts[:, None] ^ pts) <= 2
        want = plain_components(zip(*np.nonzero(np.triu(near, 1))), range(len(pts)))
        got = S.local_roots(len(pts), S.links(pts, 2, rng))
        assert got.tolist() == [want[i] for i in range(len(pts))]


def test_shards_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_POINTS", 40)
    rng = np.random.default_rng(6)
    pts = np.concatenate([crafted(rng, 500, 60, 8, 64), crafted(rng, 1, 1, 700, 11)])
    pts = np.unique(pts)
    tree, leaves = S.fit_tree(pts, 32, 2)
    assert leaves > 4
    near = np.bitwise_count(pts[:, None] ^ pts) <= 2
    want = plain_components(zip(*np.nonzero(np.triu(near, 1))), range(len(pts)))
    df = spark.createDataFrame([(int(x),) for x in pts.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(S.near_edges(df, 2)).collect()}
    groups = {}
    for i, x in enumerate(pts.view(np.int64).tolist()):
        groups.setdefault(roots.get(x, x), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(8)
    ids = rng.permutation(2000).tolist()
    edges = [(a, b) for a, b in zip(ids[:1200], ids[1:1200])] + [(a, b) for a, b in zip(range(3000, 3300), range(3001, 3301))]
    edges += [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components(edges, {x for e in edges for x in e})
    byroot = {}
    for n, r in got.items():
        byroot.setdefault(r, set()).add(want[n])
    assert all(len(x) == 1 for x in byroot.values()) and len(byroot) == 3
    assert set(got) == {n for n in want if n != 7 or any(7 in e and e[0] != e[1] for e in edges)}
