import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import periodic_runs, registry
from tablewright.llm.common import documents

SF = "/root/testdata/sf0.001"


def plain_runs(words, least):
    """Every lag, every stretch, every smaller period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                end = j + q
                if not any(all(words[x] == words[x + d] for x in range(i, end - d)) for d in range(1, q)):
                    out.append((i, end, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng):
    """Numbers of few kinds, powers, broken powers, touching runs, Fibonacci words."""
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(1, 260))]
    if kind == 1:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 70))] * rng.randrange(1, 5)
        for _ in range(rng.randrange(3)):
            unit[rng.randrange(len(unit))] = rng.randrange(3)
        return unit
    if kind == 2:
        d, out = rng.randrange(1, 5), []
        for _ in range(rng.randrange(1, 6)):
            m = rng.randrange(1, 60)
            out += (list(range(d)) * (m // d + 2))[rng.randrange(d):][:m]
        return out * rng.randrange(1, 3)
    if kind == 3:
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(3, 11)):
            a, b = b, b + a
        return b[:300]
    out = [0]
    while len(out) < 200:
        out = out + [rng.randrange(2)] + out
    return out


@pytest.mark.parametrize("short,least", [(8, 4), (16, 8), (32, 12)])
def test_runs_against_every_lag(monkeypatch, short, least):
    monkeypatch.setattr(periodic_runs, "SHORT", short)
    rng = random.Random(short)
    for _ in range(400):
        words = texts(rng)
        assert periodic_runs.find(np.array(words), len(words), least) == plain_runs(words, least)


def test_long_periods_and_long_texts():
    rng = random.Random(3)
    unit = [rng.randrange(10 ** 6) for _ in range(9000)]
    words = np.array([10 ** 7, *unit, *unit, *unit[:77], 10 ** 8])
    assert periodic_runs.find(words, len(words), 12) == [(1, 18078, 9000)]
    same = np.zeros(300_000, np.int64)
    same[150_000] = 1
    assert periodic_runs.find(same, len(same), 12) == [(0, 150_000, 1), (150_001, 300_000, 1)]


def plain_query(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
                                 if best else (None,) * 4),
            sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_every_lag(spark):
    got = registry.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    short = [r for r in documents(spark, SF).collect() if len((r.text or "").split()) < 900]
    assert len(rows) == 200 and len(short) > 150
    for r in short:
        assert rows[r.doc_id] == plain_query(r.doc_id, r.text)
    assert sum(x[1] > 0 for x in rows.values()) >= 10


def test_nulls_blanks_repeats_and_other_columns(spark):
    beat = " ".join(["tick", "tock"] * 8)
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", "x"), (4, beat, "x"), (4, beat, "x"),
         (None, beat + "  end", "x"), (5, "one", "x")],
        "doc_id long, text string, runs string")
    rows = sorted(map(tuple, periodic_runs.find_runs(docs).selectExpr(
        "coalesce(doc_id, -1) as i", "n_words", "to_json(runs) as r", "collapsed").collect()))
    run = '[{"start":0,"length":%d,"period":2}]'
    assert rows == [(-1, 17, run % 15, "tick tock tock  end"), (1, 0, "[]", ""), (2, 0, "[]", ""), (3, 0, "[]", ""),
                    (4, 16, run % 16, "tick tock"), (4, 16, run % 16, "tick tock"), (5, 1, "[]", "one")]
    empty = periodic_runs.find_runs(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
    odd = registry.repeated_tails(docs)
    assert odd.filter(F.col("text").isNull()).count() == 1
