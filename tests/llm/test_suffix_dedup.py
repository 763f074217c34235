import hashlib

import numpy as np

from tablewright.llm import registry, suffix_dedup as S


def brute(rows, size):
    """rows: (id, text), ids distinct -> {id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        keep = np.ones(len(raw), bool)
        for p in range(len(raw) - size + 1):
            w = raw[p:p + size]
            if w in seen:
                keep[p:p + size] = False
            seen.add(w)
        gone = np.concatenate([[False], ~keep])
        kept = np.frombuffer(raw, np.uint8)[keep].tobytes()
        out[i] = (len(raw), int((~keep).sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, size, gram):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(df, size=size, gram=gram).collect()}
    assert got == brute(rows, size)


def noisy(rng, n, alphabet, longest):
    rows, pool = [], [bytes(rng.choice(alphabet, 60)).decode() for _ in range(6)]
    for i in range(n):
        parts = [bytes(rng.choice(alphabet, rng.integers(0, longest))).decode() if rng.random() < 0.5 else pool[rng.integers(0, 6)]
                 for _ in range(rng.integers(0, 6))]
        rows.append((int(i * 7 % n), "".join(parts)))
    return rows


def test_small_windows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 2000)
    rng = np.random.default_rng(2)
    rows = noisy(rng, 150, list(b"ab"), 40) + [(1000 + k, t) for k, t in enumerate(
        [None, "", "a" * 500, "ab" * 300, "aab" * 100 + "é" * 50, "é" * 100, "x\x00" * 60, "\x00" * 90, "q" * 11, "q" * 12, "q" * 13])]
    rows += [(2000, rows[3][1]), (2001, "a" * 500)]
    check(spark, rows, 12, 5)


def test_production_windows_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in registry.QUERIES["op8_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sum(r[1] for r in want.values()) > 1000


def framed(n, line, seed=5, others=40):
    """A third of the texts hold ``line`` between neighbours of their own, some of them shared."""
    rng = np.random.default_rng(seed)
    word = lambda k: bytes(rng.choice(list(b"abcdefghij "), k).tolist()).decode()
    shared = [word(others) for _ in range(5)]
    return [(i, word(80) + (line + word(others) if i % 6 == 0 else shared[i % 5] + line + word(30) if i % 6 == 3 else "") + word(60))
            for i in range(n)]


def test_frequent_line_between_different_neighbours(spark, monkeypatch):
    """The line's anchors are dealt by their neighbours; what is removed is as by brute force."""
    monkeypatch.setattr(S, "LEAST_HOT", 20)
    line = "the line of sixty bytes that a third of all documents hold .."
    rows = framed(360, line)
    check(spark, rows, 100, 40)
    check(spark, [(i, t + line[:45]) for i, t in rows], 100, 40)


def test_groups_of_a_frequent_line_are_bounded(spark):
    line = "the line of sixty bytes that a third of all documents hold .."
    raw = [t.encode() for _, t in framed(1200, line, others=120)]
    off = np.cumsum([0] + [len(r) for r in raw])
    at, _ = S.anchors(np.frombuffer(b"".join(raw), np.uint8), off, 100, 40)
    doc = np.searchsorted(off, at, side="right") - 1
    places = {}
    for d, a in zip(doc.tolist(), (at - off[doc]).tolist()):
        places.setdefault(d, []).append(a)
    z = S.zstandard.ZstdCompressor()
    docs = spark.createDataFrame([(d, d, bytearray(z.compress(raw[d])), p) for d, p in places.items()],
                                 "id long, dh long, text binary, places array<long>")
    runs = S.run_names(S.surroundings(np.frombuffer(b"".join(raw), np.uint8), off, at, 100, 40)[0], 40)
    names, counts = np.unique(runs, return_counts=True)
    hot = names[counts > 100]
    assert len(hot) and counts.max() >= 150

    def largest(hot):
        dealt = S.dealt_surroundings(docs, np.zeros(0, "S16"), 500, 100, 40, hot).filter("not known").collect()
        sizes = {}
        for r in dealt:
            sizes[r.bucket] = sizes.get(r.bucket, 0) + len(S.stacked([r.blob])[0])
        return max(sizes.values())

    assert largest(np.zeros(0, np.uint64)) >= 150 and largest(hot) < 100      # shared neighbours: 40 texts


def test_rows_and_nulls(spark):
    t = "the quick brown fox jumps over a lazy dog, then 42"
    rows = [(5, t), (3, t), (3, t), (None, t), (None, None), (4, "zz" + t[:30]), (1, None), (1, "")]
    df = spark.createDataFrame([r + (1, "x") for r in rows], "doc_id long, text string, dh int, places string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept and bytes(r.kept)) for r in S.dedup(df, size=20, gram=8).collect()), key=str)
    assert got == sorted([(5, 50, 50, 1, b""), (3, 50, 0, 0, None), (3, 50, 50, 1, b""), (None, 50, 50, 1, b""), (None, 0, 0, 0, None),
                          (4, 32, 30, 1, b"zz"), (1, 0, 0, 0, None), (1, 0, 0, 0, None)], key=str)
    assert S.dedup(df.limit(0)).count() == 0


def test_multikey_order_is_the_sorted_order():
    rng = np.random.default_rng(1)
    for width in (1, 7, 8, 20, 33):
        rows = rng.integers(0, 2, (400, width)).astype(np.uint8)
        order = S.multikey_order(rows)
        assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)
        lcp = S.common_prefix(rows, order)
        for k in range(1, 400):
            a, b = rows[order[k - 1]], rows[order[k]]
            assert lcp[k] == next((x for x in range(width) if a[x] != b[x]), width)
