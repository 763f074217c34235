import numpy as np

from tablewright.llm import passage_dedup as P, registry


def plain_windows(h, least):
    out = []

    def grow(lo, hi):
        if hi - lo >= least:
            c = lo + int(np.argmin(h[lo:hi]))
            out.append((lo, c, hi))
            grow(lo, c)
            grow(c + 1, hi)
    grow(0, len(h))
    return sorted(out)


def test_compact_windows_are_the_nodes_of_the_tree():
    rng = np.random.default_rng(3)
    texts = [P.mix64(rng.integers(0, 2**62, n).astype(np.uint64)) for n in (0, 1, 5, 6, 7, 40, 300)]
    off = np.cumsum([0] + [len(t) for t in texts])
    got = list(zip(*(x.tolist() for x in P.compact_windows(np.concatenate(texts), off, 6))))
    want = [(off[i] + a, off[i] + b, off[i] + c) for i, t in enumerate(texts) for a, b, c in plain_windows(t, 6)]
    assert sorted(got) == sorted(want)


def test_every_long_subsequence_is_in_one_window():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 9, 60).astype(np.uint64) << np.uint64(40)       # many ties
    l, c, r = P.compact_windows(h, np.array([0, 60]), 5)
    for i in range(60):
        for j in range(i + 5, 61):
            own = [k for k in range(len(c)) if l[k] <= i <= c[k] < j <= r[k]]
            assert len(own) == 1 and h[c[own[0]]] == h[i:j].min()


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(n)]


def corpus(rng):
    """Passages planted in texts of their own, exact and with single words changed."""
    rows, planted, n = [], [], 0
    for length, edits, copies in ((60, 0, 2), (60, 0, 5), (80, 1, 2), (200, 3, 3), (55, 0, 40), (51, 0, 2), (400, 8, 2)):
        passage = words(rng, length)
        for c in range(copies):
            body = list(passage)
            for e in range(edits if c else 0):
                body[(e * length) // max(edits, 1) + 7] = f"new{c}x{e}"
            head, tail = words(rng, rng.integers(0, 90)), words(rng, rng.integers(0, 90))
            rows.append((n, " ".join(head + body + tail)))
            planted.append((n, len(rows), (length, edits, copies), len(head), len(head) + length))
            n += 1
    return rows, planted


def test_planted_passages_are_found_and_clean_texts_are_not(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_BYTES", 20_000)
    rng = np.random.default_rng(5)
    rows, planted = corpus(rng)
    clean = [(1000 + i, " ".join(words(rng, 150))) for i in range(60)]
    short = " ".join(words(rng, 40))
    clean += [(1100 + i, short + " " + " ".join(words(rng, 60))) for i in range(5)]
    out = P.find_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()
    assert all(r.doc_id < 1000 and r.first_id < 1000 for r in out)
    texts = dict(rows)
    groups = {}
    for i, _, g, a, b in planted:
        groups.setdefault(g, []).append((i, a, b))
    linked = {}
    for r in out:
        assert r.first_id < r.doc_id and r.similarity >= 0.8
        x = [" ".join(texts[r.doc_id].split()[r.start_word:r.end_word][i:i + 5]) for i in range(r.end_word - r.start_word - 4)]
        y = [" ".join(texts[r.first_id].split()[r.first_start:r.first_end][i:i + 5]) for i in range(r.first_end - r.first_start - 4)]
        assert abs(len(set(x) & set(y)) / len(set(x) | set(y)) - r.similarity) < 1e-9
        assert min(r.end_word - r.start_word, r.first_end - r.first_start) >= 50
        linked.setdefault(r.doc_id, set()).add(r.first_id)
        linked.setdefault(r.first_id, set()).add(r.doc_id)
    for members in groups.values():
        seen, todo = set(), [members[0][0]]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += linked.get(i, ())
        assert seen == {i for i, _, _ in members}


def test_links_agree_across_many_that_do_not_fit():
    """Two links of one stretch with forty between them (of one function, in short intervals)."""
    n = 42
    a, b = np.ones(n, np.int64), np.full(n, 2)
    ca = np.array([100, *range(101, 141), 145])
    k = np.array([0] + [0] * 40 + [1])
    la, ra = np.array([90] + [100] * 40 + [90]), np.array([200] + [142] * 40 + [200])
    got = P.agreeing(a, b, k, ca, la, ra, ca + 5, la + 5, ra + 5, 46)
    assert got.tolist() == [True] + [False] * 40 + [True]


def test_agreeing_is_that_of_all_pairs():
    rng = np.random.default_rng(10)
    n = 400
    a, b, k, ca = rng.integers(0, 3, n), rng.integers(5, 7, n), rng.integers(0, P.HASHES, n), rng.integers(50, 300, n)
    cb = ca + rng.integers(0, 9, n)
    la, ra, lb, rb = (x + y for x, y in ((ca, -rng.integers(0, 60, n)), (ca, rng.integers(1, 60, n)),
                                         (cb, -rng.integers(0, 60, n)), (cb, rng.integers(1, 60, n))))
    cols = P.distinct_links([np.concatenate([x, x[:50]]) for x in (a, b, k, ca, la, ra, cb, lb, rb)])
    a, b, k, ca, la, ra, cb, lb, rb = cols
    assert len(set(zip(a, b, k, ca, cb))) == len(a)
    want = []
    for i in range(len(a)):
        functions = {int(k[i])}
        for j in range(len(a)):
            if (a[i], b[i]) == (a[j], b[j]) and all(
                    max(l[i], l[j]) <= min(c[i], c[j]) and min(r[i], r[j]) > max(c[i], c[j])
                    and min(r[i], r[j]) - max(l[i], l[j]) >= 46 for l, c, r in ((la, ca, ra), (lb, cb, rb))):
                functions.add(int(k[j]))
        want.append(len(functions) >= P.AGREE)
    assert P.agreeing(*cols, 46).tolist() == want and any(want) and not all(want)


def verified_pair(rng, passage, other, x_more=(), y_more=()):
    a, b = (words(rng, 50) + list(w) + list(m) + words(rng, 50) for w, m in ((passage, x_more), (other, y_more)))
    x, y = ([" ".join(w[i:i + 5]) for i in range(len(w) - 4)] for w in (a, b))
    ids = {s: i for i, s in enumerate(dict.fromkeys(x + y))}
    out = P.passages(np.array([ids[s] for s in x]), np.array([ids[s] for s in y]), [0], 50, 0.8)
    for p, q, u, v, near in out:
        one, two = set(x[p:q - 4]), set(y[u:v - 4])
        assert min(q - p, v - u) >= 50 and abs(len(one & two) / len(one | two) - near) < 1e-9 and near >= 0.8
    return out


def test_short_passages_with_edits_near_their_ends():
    rng = np.random.default_rng(8)
    for length in (50, 51, 53, 55, 57, 60):
        for at in (0, 1, 2, 3, length - 4, length - 2, length - 1):
            passage = words(rng, length)
            other = passage[:at] + ["changed"] + passage[at + 1:]
            out = verified_pair(rng, passage, other)
            assert any(p < 50 + length and 50 < q for p, q, *_ in out), (length, at)


def test_a_passage_beside_a_stretch_with_many_edits():
    rng = np.random.default_rng(9)
    passage, stretch = words(rng, 60), words(rng, 200)
    other = passage[:30] + ["changed"] + passage[31:]
    many = [f"new{i}" if i % 8 == 0 else w for i, w in enumerate(stretch)]
    out = verified_pair(rng, passage, other, stretch, many)
    assert any(p <= 55 and q >= 105 for p, q, *_ in out)


def test_edges(spark):
    rng = np.random.default_rng(6)
    long_ = " ".join(words(rng, 120))
    rows = [(1, long_), (2, long_), (2, long_), (None, long_.upper()), (3, None), (4, ""), (5, "x " * 5000), (6, "x " * 4000), (7, "a b c")]
    df = spark.createDataFrame([r + (1, "q") for r in rows], "doc_id long, text string, dh int, first_id string")
    out = {(r.doc_id, r.first_id, r.start_word, r.end_word) for r in P.find_passages(df).collect()}
    assert (2, 1, 0, 120) in out and (None, 1, 0, 120) in out and any(r[:2] == (6, 5) for r in out)
    assert {r[:2] for r in out} == {(2, 1), (None, 1), (6, 5)}
    assert P.find_passages(df.limit(0)).count() == 0


def test_query(spark):
    """One row per document; texts that share a long stretch of equal words are of one class, and
    the passage named for a document is one that it shares."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: r for r in registry.QUERIES["op7_passage_dedup"](spark, sf).collect()}
    assert out.keys() == texts.keys()
    classes = {}
    for r in out.values():
        classes.setdefault(r.component_id, []).append(r.doc_id)
    assert all(c == min(members) for c, members in classes.items())
    assert all((len(classes[r.component_id]) > 1) == (r.start_word is not None) for r in out.values())
    for r in out.values():
        if r.start_word is not None:
            x, y = (w[s:e] for w, s, e in ((texts[r.doc_id], r.start_word, r.end_word), (texts[r.other_doc_id], r.other_start, r.other_end)))
            x, y = ({" ".join(w[i:i + 5]) for i in range(len(w) - 4)} for w in (x, y))
            assert len(x & y) >= 0.8 * len(x | y) and out[r.other_doc_id].component_id == r.component_id
    runs = {}
    for i, w in texts.items():
        for p in range(len(w) - 49):
            runs.setdefault(" ".join(w[p:p + 50]), set()).add(out[i].component_id)
    assert any(len(v) > 1 for v in classes.values()) and all(len(v) == 1 for v in runs.values())


def class_sets(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "doc_id long, text string")
    rows = P.passage_classes(df).collect()
    assert len(rows) == len(texts)
    out = {}
    for r in rows:
        out.setdefault(r.component_id, set()).add(r.doc_id)
    return out, rows


def test_classes_of_what_find_passages_finds(spark):
    """The classes are the components of all pairs; without a repeat of a pair's work."""
    rng = np.random.default_rng(16)
    passage = words(rng, 60)
    texts = [words(rng, 40) + passage[:30] + [f"new{i}"] + passage[31:] + words(rng, 40) for i in range(30)]
    texts += [words(rng, 30) + passage[:25] + words(rng, 30) for _ in range(30)]                  # too short a stretch
    other = words(rng, 90)
    texts += [words(rng, 20) + other + words(rng, 20) for _ in range(5)] + [other[:52] + words(rng, 60), words(rng, 60) + other[38:]]
    texts += [words(rng, 100), words(rng, 20), []]
    classes, _ = class_sets(spark, texts)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(range(30)), frozenset(range(60, 67))}


def test_few_pairs_are_candidates_in_groups_of_near_copies(spark):
    """Variants and texts that repeat a word many times: pairs in proportion to the texts."""
    rng = np.random.default_rng(17)
    passage = words(rng, 60)
    texts = [words(rng, 40) + passage[:30] + [f"new{i}"] + passage[31:] + words(rng, 40) for i in range(60)]
    texts += [words(rng, 30) + ["de"] * int(rng.integers(20, 45)) + words(rng, 30) for _ in range(60)]
    df = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "dh long, comp long, text string")
    assert P.candidate_pairs(df, 4, 50, 0.8, classes=True).count() < 4 * len(texts)
    classes, _ = class_sets(spark, texts)
    assert sorted(map(len, classes.values()))[-2:] == [1, 60]


def test_class_edges(spark):
    rng = np.random.default_rng(18)
    long_, short = " ".join(words(rng, 120)), " ".join(words(rng, 40) + ["x" * 90])
    rows = [(1, long_), (2, long_), (2, long_), (None, long_.upper()), (3, None), (4, ""), (5, "x " * 5000), (6, "x " * 4000),
            (7, "a b c"), (8, "a b c"), (9, short), (10, short)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.component_id, r.other_id, r.start_word, r.end_word) for r in P.passage_classes(df).collect()), key=str)
    assert len(out) == len(rows)
    assert {x[:2] for x in out} == {(1, 1), (2, 1), (0, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 10)}
    assert all((x[3] is None) == (x[0] in (3, 4, 7, 8, 9, 10)) for x in out) and (2, 1, 1, 0, 120) in out
    assert P.passage_classes(df.limit(0)).count() == 0


def met(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r.first_id, r.doc_id) for r in P.find_passages(df).collect()}


def test_passages_of_two_texts_around_what_many_texts_have(spark):
    """Each passage of 60 words is that of two texts; 42 words of it are in 200 other texts."""
    rng = np.random.default_rng(11)
    common = words(rng, 42)
    texts = [words(rng, 30) + common + words(rng, 30) for _ in range(200)]
    for _ in range(40):
        own = words(rng, 18)
        cut = int(rng.integers(0, 19))
        texts += [words(rng, 40) + own[:cut] + common + own[cut:] + words(rng, 40) for _ in range(2)]
    found = met(spark, texts)
    assert found == {(i, i + 1) for i in range(200, 280, 2)}


def test_all_pairs_of_variants_are_found(spark):
    """Variants of a passage, one word of the middle changed in each: no two have 50 words in a
    row in common, and every pair of them is similar enough."""
    rng = np.random.default_rng(12)
    for n in (7, 30):
        passage = words(rng, 60)
        texts = [words(rng, 40) + passage[:30] + [f"new{i}"] + passage[31:] + words(rng, 40) for i in range(n)]
        assert met(spark, texts) == {(i, j) for j in range(n) for i in range(j)}


def test_a_passage_of_many_texts_is_linked_to_the_first_of_them(spark, monkeypatch):
    """Texts of one passage are joined by one of them; a variant is linked to that one."""
    monkeypatch.setattr(P, "SLICE_BYTES", 5000)
    rng = np.random.default_rng(13)
    passage = words(rng, 60)
    texts = [words(rng, 40) + passage + words(rng, 40) for _ in range(90)]
    texts += [words(rng, 40) + passage[:30] + ["new"] + passage[31:] + words(rng, 40)]
    found = met(spark, texts)
    group = {0}
    while more := {j for p in found if group & set(p) for j in p} - group:
        group |= more
    assert group == set(range(91)) and len(found) < 500
    assert any(90 in p for p in found)


def test_runs_that_similar_passages_have_in_common():
    assert P.common_run(46, 0.8) == 21 and P.common_run(46, 1.0) == 46
    rng = np.random.default_rng(14)
    h = P.mix64(rng.integers(0, 2**62, 400).astype(np.uint64))
    other = P.mix64(rng.integers(0, 2**62, 400).astype(np.uint64))
    for at in range(0, 379, 7):
        x = np.concatenate([other[:150], h[at:at + 21], other[150:]])
        places = [P.seed_places(t, np.array([0, len(t)]), 14, 8)[1] for t in (h, x)]
        assert {p - at for p in places[0].tolist() if at <= p <= at + 7} & {p - 150 for p in places[1].tolist() if 150 <= p <= 157}


def test_texts_with_a_short_stretch_in_common_have_no_passage(spark):
    rng = np.random.default_rng(15)
    short = words(rng, 30)
    assert met(spark, [words(rng, 40) + short + words(rng, 40) for _ in range(3)]) == set()
