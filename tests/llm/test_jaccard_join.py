import random
from collections import defaultdict

import numpy as np
import pytest

from tablewright.llm import jaccard_join, registry
from tablewright.llm.common import documents

SF = "/root/testdata/sf0.001"


def plain(rows, gram=4, percent=85):
    """Sets of byte strings, overlaps counted over all common grams, plain union-find."""
    sets = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((i, {tuple(words[k:k + gram]) for k in range(max(1, len(words) - gram + 1))} if words else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, (_, own) in enumerate(sets):
        both = defaultdict(int)
        for g in own:
            for j in lists[g]:
                both[j] += 1
            lists[g].append(k)
        for j, o in both.items():
            if 100 * o >= percent * (len(own) + len(sets[j][1]) - o):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted([(i, len(own), low.get(find(k))) for k, (i, own) in enumerate(sets)], key=repr)


def joined(docs, **kw):
    return sorted(map(tuple, jaccard_join.jaccard_join(docs, **kw).collect()), key=repr)


def corpus(seed, n=260):
    """Chains of edits, a hot group of near copies, shared boilerplate of several lengths."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    plate = [word() for _ in range(70)]
    hot = [word() for _ in range(90)]
    texts, chain = [], [word() for _ in range(60)]
    for i in range(n):
        kind = i % 6
        if kind in (0, 1):                      # a third of all rows: near copies
            own = list(hot)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = word()
        elif kind == 2:                         # each one edit from the one before
            chain = list(chain)
            chain[rng.randrange(len(chain))] = word()
            own = chain
        elif kind == 3:
            own = plate[:rng.choice([30, 50, 70])] + [word() for _ in range(rng.randrange(1, 12))]
        elif kind == 4:
            own = [word() for _ in range(rng.randrange(0, 40))]
        else:
            own = hot[:rng.choice([70, 76, 80, 85])] + [word() for _ in range(rng.randrange(4))]
        texts.append((i, " ".join(own)))
    return texts


def test_query_against_every_list(spark):
    got = registry.op11_jaccard_join(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    want = plain([(r.doc_id, r.text) for r in documents(spark, SF).collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({r[2] for r in want}) < len(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_groups_chains_and_boilerplate(spark, monkeypatch, seed):
    """Small lists and slices: blocks, salted lists, leaders of several slices."""
    for name, value in (("SLICE_BYTES", 3000), ("SMALL", 4), ("LIST", 9), ("HEADS", 1 + seed % 2), ("SKETCH", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(docs) == plain(rows)


def test_without_leaders(spark, monkeypatch):
    """The lists alone find every link: no set has a leader before."""
    monkeypatch.setattr(jaccard_join, "HEADS", 0)
    rows = corpus(7, 150)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_other_grams_and_thresholds(spark):
    rows = corpus(9, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, gram=5, percent=80) == plain(rows, 5, 80)
    assert joined(docs, gram=2, percent=100) == plain(rows, 2, 100)


def test_blocks_are_skipped(monkeypatch):
    """Blocks whose sizes or positions allow no link are not compared."""
    n = np.sort(np.random.default_rng(1).integers(10, 5000, 2000))
    pos = np.random.default_rng(2).integers(0, np.maximum(1, jaccard_join.prefix_length(n, 85)))
    key, none = np.zeros((2000, 3), int), np.zeros(2000, int)
    known = dict.fromkeys(jaccard_join.KNOWN, none) | {"sid": np.arange(2000), "comp": np.arange(2000), "ref": np.arange(2000), "n": n}
    tried = []
    whole = jaccard_join.can_link
    monkeypatch.setattr(jaccard_join, "can_link", lambda *a: tried.append(len(a[0])) or whole(*a))
    a, b = jaccard_join.cross(key, known, pos, np.full(2000, -1), 85)
    want = {(i, j) for i in range(2000) for j in range(i + 1, 2000)
            if 100 * n[i] >= 85 * n[j] and whole(n[i], n[j], pos[i], pos[j], 85)}
    assert set(zip(a.tolist(), b.tolist())) == want
    assert sum(tried) < 2000 * 1999 / 8
    assert not len(jaccard_join.cross(key, known | {"comp": none}, pos, np.full(2000, -1), 85)[0])


def test_bounds_by_a_common_leader():
    """Pairs are left out by what they lack of one leader and have besides only if they can't link."""
    rng = np.random.default_rng(3)
    leader = np.sort(rng.choice(10 ** 9, 60, replace=False)).astype(np.uint64)
    sets, known = [], {c: [] for c in jaccard_join.KNOWN}
    for i in range(300):
        gone = rng.choice(60, rng.integers(0, 9), replace=False)
        own = np.unique(np.concatenate([np.delete(leader, gone), rng.choice(40, rng.integers(0, 9)).astype(np.uint64) * 7 + 10 ** 10]))
        both, *bits = jaccard_join.compared(own, leader)
        for c, v in zip(jaccard_join.KNOWN, (i, len(own), i, 0, 60, 60 - both, len(own) - both, *bits)):
            known[c].append(v)
        sets.append(own)
    known = {c: np.array(v) for c, v in known.items()}
    a, b = np.triu_indices(300, 1)
    may = jaccard_join.possible(known, a, b, 85)
    real = np.array([jaccard_join.overlap(sets[i], sets[j]) >= jaccard_join.needed(len(sets[i]), len(sets[j]), 85) for i, j in zip(a, b)])
    assert real.any() and not (real & ~may).any() and may.sum() < len(a) / 3


def test_nulls_blanks_repeats_long_texts_and_other_columns(spark):
    long_text = " ".join(f"x{i % 7919}y{i % 104729}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Two words"), (5, "two  WORDS"), (6, "two words more"), (7, "one two three four"),
            (7, "one two three four"), (None, "one TWO three\nfour"), (None, "alone here now then"), (8, long_text),
            (9, long_text + " end"), (10, "ÄÖ üb er all"), (11, "äö üb er all"), (12, "two words")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n long, component_id string")
    assert joined(docs) == plain(rows)
    assert joined(docs.limit(0)) == []


def test_one_pair_of_two_components_is_compared(spark, monkeypatch):
    """Two components of 40 sets, each set linked with each: 1,600 pairs, one comparison; a pair
    of sets that do not link is left for the rest."""
    common = np.arange(1, 101, dtype=np.uint64)
    rows = [(i, len(common) + 1, jaccard_join.small(np.append(common, np.uint64(1000 + i)), jaccard_join.WIDTH).tobytes()) for i in range(80)]
    rows += [(90 + i, 100, jaccard_join.small(np.arange(5000 + 200 * i, 5100 + 200 * i, dtype=np.uint64), jaccard_join.WIDTH).tobytes()) for i in range(2)]
    sets = spark.createDataFrame([(i, n, bytearray(g)) for i, n, g in rows], "sid long, n long, grams binary")
    links = spark.createDataFrame([(i, i + 1) for i in range(79) if i != 39], "a long, b long")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(40, 80)] + [(90, 91)], "a long, b long")
    asked, plain = [], jaccard_join.overlaps

    def counted(sets, some):
        out = plain(sets, some)
        asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "overlaps", counted)
    left, more = jaccard_join.joining_pairs(sets, pairs, links, 85)
    assert [tuple(r) for r in left.collect()] == [(90, 91)] and sum(asked) == 1
    roots = {r.node: r.root for r in jaccard_join.joined_components(more).collect()}
    assert len({roots[i] for i in range(80)}) == 1
