import math
import re

import numpy as np
import pytest

from tablewright.llm import mixing as M, registry

SF = "/root/testdata/sf0.001"


def plain_rates(n, p, weights, floor, budget=None, rounds=M.ROUNDS, margin=1.0):
    total = n @ p
    share = np.array(weights) / sum(weights)
    if budget is None:
        budget = margin * max(total[k] / share[k] for k in range(len(share)) if share[k])
    target, r = share * budget, np.full(len(n), max(floor, 1.0))
    scale = np.maximum(total, 1e-9 * total.sum())
    reached = (r * n) @ p
    for _ in range(rounds):
        r = np.maximum(floor, r - p @ ((reached - target) / scale))
        before, reached = reached, (r * n) @ p
        if (abs(before - reached) <= M.DONE * np.maximum(target, M.DONE * budget)).all():
            break
    return r, reached, target


def test_query_reaches_its_targets(spark):
    df = registry.QUERIES["op10_mixing"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    pdf = df.toPandas()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(pdf.doc_id) == sorted(docs)
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) for r in pdf.itertuples())
    names = [c for c in pdf.columns if c.startswith("p_")]
    p = pdf[names].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    assert np.mean([d == docs[i].lang or d == "low" for i, d in zip(pdf.doc_id, pdf.domain)]) > 0.9
    w = [registry.MIX_WEIGHTS.get(c[2:], 0) for c in names]
    r, reached, target = plain_rates(pdf.n_tokens.to_numpy(float), p, w, 0.0, margin=registry.MIX_MARGIN)
    assert np.allclose(pdf.rate, r, rtol=1e-6, atol=1e-9)
    assert np.abs(reached / reached.sum() - target / target.sum()).max() < 0.01        # every share within 1 %
    assert (pdf.rate >= 0).all() and ((pdf.copies - pdf.rate).abs() < 1).all()


def test_clean_documents_of_wanted_domains_stay(spark):
    pdf = registry.QUERIES["op10_mixing"](spark, SF).toPandas()
    low = pdf.domain == "low"
    assert (pdf.copies[~low] >= 1).mean() > 0.99 and pdf.rate[low].mean() < 0.1


def test_rates_are_the_least_squares_optimum(spark):
    """The conditions of the optimum, and that no random nonnegative rates do better."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    n = rng.integers(1, 500, 60)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
    mix = M.fit_rates(rows, ["a", "b", "c"], {"a": 1, "b": 1, "c": 6}, budget=float(n.sum()) * 3, floor=0.0, rounds=60)
    rates = np.array([x.r for x in rows.select(mix.rate(M.F.col("p")).alias("r")).collect()])
    want, reached, target = plain_rates(n.astype(float), p, [1, 1, 6], 0.0, float(n.sum()) * 3, 60)
    assert np.allclose(rates, want, rtol=1e-6) and np.allclose(mix.targets, target)
    loss = lambda r: ((((r * n) @ p - target) ** 2) / (n @ p)).sum()
    best = loss(rates)
    for _ in range(300):
        assert loss(np.maximum(0, rates + rng.normal(size=60) * 0.2)) >= best - 1e-3 * loss(np.ones(60))
    assert (rates >= 0).all() and best < 0.02 * loss(np.ones(60))


def test_edges(spark):
    schema = "doc_id long, text string, lang string, copies int, rate string, _words int"
    data = [(i, "the of and dog", "en", 1, "x", 1) for i in range(8)] + [(10, "der die und hund " * 3, "de", 1, "x", 1),
            (11, None, None, 1, None, None), (12, "", "en", 1, "x", 1), (None, "der und", "de", 1, "x", 1),
            (13, "the " * 20_000, "en", 1, "x", 1), (13, "the", "en", 1, "x", 1)]
    df = spark.createDataFrame(data, schema)
    marks = df.selectExpr("doc_id", "lang as domain")
    mixer = M.fit(df, marks, {"en": 0.5, "de": 0.5, "zz": 3}, floor=1.0)
    rows = mixer.rated(df).collect()
    assert len(rows) == len(data) and all(r.rate >= 1 and r.copies >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (11, 12)} == {0}
    out = M.mixed_rows(df, mixer)
    assert out.columns == df.columns
    times = {(r.doc_id, r.n_tokens): r.copies for r in rows}
    assert out.filter("doc_id = 10").count() == times[10, 12] > 100
    assert out.count() == sum(r.copies for r in rows)
    for some in (marks.limit(0), marks.filter("domain is null")):
        none = M.fit(df, some, {"en": 1})
        assert M.mixed_rows(df, none).count() == len(data)
        assert {r.rate for r in none.rated(df).collect()} == {1.0}
    assert M.mixed_rows(df, M.fit(df, marks, {"zz": 1})).count() == len(data)
    empty = df.limit(0)
    assert M.mixed_rows(empty, M.fit(empty, marks, {"en": 1})).count() == 0
    cut = M.fit(df, marks, {"en": 1.0}, budget=20.0, floor=0.0)
    assert M.mixed_rows(df, cut).count() < len(data)
    assert math.isclose(sum(cut.mix.targets), 20.0)
    with pytest.raises(Exception):
        M.fit(df, marks, {"en": 1}, id_col="nope")
