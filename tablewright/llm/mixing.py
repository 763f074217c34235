"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table (id, domain) gives each document a posterior over
the domains: multinomial naive Bayes over hashed words, its evidence held to that of
``EVIDENCE`` words so that the posterior stays soft. A document of ``n`` words and posterior
``p`` at rate ``r`` adds ``r * n * p[k]`` expected words to domain ``k``. Projected gradient
descent fits rates of at least ``floor`` (zero: any nonnegative rate) to the target totals by least squares, the error of
a domain measured against its present words. In the metric of document lengths a step is

    r <- max(floor, r - sum_k p[k] * (S[k] - T[k]) / N[k])

with ``S`` the expected totals at the present rates, ``T`` the targets and ``N`` the totals
at rate one; the matrix of the problem has no eigenvalue above one, so steps of length one
descend. A step needs the totals only, so each round is one distributed sum, and the rate of
any document follows from its posterior and the list of steps. Everything is an SQL
expression; the driver holds vectors of the number of domains and of the hash buckets.

Defined cases: a null or empty text has no words and the prior as posterior; labelled rows
without an id or domain teach nothing; without labelled rows, or with no target of a known
domain, every rate is ``max(floor, 1)``; a domain without a target has target zero; null ids
share one draw of copies; repeated rows are rated alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import fresh, materialize, pick, quoted
from tablewright.llm.quality_rules import SPACE, let

BUCKETS = 1024          # hashed words
EVIDENCE = 50.0         # words that the posterior may count on
ROUNDS = 40
BLOCK = 8               # rounds after which the present rates are written
DONE = 1e-4             # largest change of a domain's total, in shares of its target


def hashed_words(text: Column) -> Column:
    """The hash bucket of each word of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _array(values) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]
    logs: list[list[float]]         # of each domain and bucket

    def rows(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, n, p): number of words and posterior of each row."""
        d = pick(docs, id=id_col, text=text_col).select("id", hashed_words(F.col("text")).alias("_words"))
        p = self.posteriors(F.col("_words")) if self.domains else F.array().cast("array<double>")
        return d.select("id", F.size("_words").cast("long").alias("n"), p.alias("p"))

    def posteriors(self, buckets: Column) -> Column:
        """Array of the domains' posteriors, from the hash buckets of the words."""
        def adds(logs):
            return lambda total, word: total + F.get(logs, word)

        def of(b):
            share = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size(b), F.lit(1)))
            sums = [F.lit(math.log(p)) + share * F.aggregate(b, F.lit(0.0), adds(_array(t)))
                    for p, t in zip(self.prior, self.logs)]
            return let(F.array(*sums), lambda s: let(
                F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: let(
                    F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(e, lambda x: x / z))))

        return let(buckets, of)


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   domain_col: str = "domain") -> Classifier:
    """Count the hashed words of all labelled rows by domain."""
    marks = pick(labelled, id=id_col, domain=domain_col).filter("id is not null and domain is not null")
    texts = pick(docs, id=id_col, text=text_col).filter("id is not null")
    rows = texts.join(marks.hint("merge"), "id").select(       # at every size: both sides grow alike
        F.col("domain").cast("string").alias("domain"), hashed_words(F.col("text")).alias("words"))
    counted = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "words")).alias("bucket")).groupBy(
        "domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()      # domains x buckets at most
    domains = sorted({r.domain for r in counted})
    n = {(r.domain, r.bucket): r.n for r in counted}
    every = sum(n.get((d, -1), 0) for d in domains)
    logs = []
    for d in domains:
        total = sum(n.get((d, b), 0) for b in range(BUCKETS)) + BUCKETS
        logs.append([math.log((n.get((d, b), 0) + 1) / total) for b in range(BUCKETS)])
    return Classifier(domains, [n[d, -1] / every for d in domains], logs)


@dataclass
class Mix:
    """Rates as a function of the posterior: the steps of the descent."""

    domains: list[str]
    floor: float
    steps: list[list[float]] = field(default_factory=list)
    present: list[float] = field(default_factory=list)      # words of each domain at rate one
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)

    def rate(self, p: Column, start: Column | None = None, after: int = 0) -> Column:
        """The rate of a posterior after all steps, or from ``start`` on those since ``after``."""
        start = F.lit(float(max(self.floor, 1.0))) if start is None else start
        if not self.steps[after:]:
            return start
        steps = F.expr("array(" + ", ".join(
            "array(" + ", ".join(f"{v!r}D" for v in g) + ")" for g in self.steps[after:]) + ")")

        def step(r, g):
            pull = sum((F.get(p, F.lit(k)) * F.get(g, F.lit(k)) for k in range(len(self.domains))), F.lit(0.0))
            return F.greatest(F.lit(float(self.floor)), r - pull)

        return F.aggregate(steps, start, step)


def fit_rates(rows: DataFrame, domains: list[str], weights: dict[str, float], budget: float | None = None,
              floor: float = 0.0, rounds: int = ROUNDS, margin: float = 1.0) -> Mix:
    """Rates of ``rows`` (n, p) whose expected totals are nearest to ``weights`` of ``budget``.

    By default the budget is ``margin`` times the smallest at which no domain with a weight
    must lose words.
    """
    mix = Mix(domains, floor)
    known = [max(0.0, float(weights.get(d, 0.0))) for d in domains]
    if not sum(known):
        return mix

    state, done = rows.select("n", "p", F.lit(float(max(floor, 1.0))).alias("r")), 0

    def totals(rate):
        got = state.agg(*[F.coalesce(F.sum(rate * F.col("n") * F.get("p", F.lit(k))), F.lit(0.0)).alias(f"s{k}")
                          for k in range(len(domains))]).first()
        return list(got)

    share = [w / sum(known) for w in known]
    mix.present = totals(F.lit(1.0))
    if budget is None:
        budget = margin * max(n / w for n, w in zip(mix.present, share) if w)
    mix.targets = [budget * w for w in share]
    scale = [max(n, 1e-9 * (sum(mix.present) or 1.0)) for n in mix.present]
    mix.reached = mix.present if floor <= 1 else totals(F.col("r"))
    for _ in range(rounds):
        mix.steps.append([(s - t) / n for s, t, n in zip(mix.reached, mix.targets, scale)])
        present = mix.rate(F.col("p"), F.col("r"), done)
        before, mix.reached = mix.reached, totals(present)
        if all(abs(a - b) <= DONE * max(t, DONE * budget) for a, b, t in zip(before, mix.reached, mix.targets)):
            break
        if len(mix.steps) - done == BLOCK:       # else each round would walk all steps before it
            state, done = materialize(state.select("n", "p", present.alias("r")), "rates"), len(mix.steps)
    return mix


def copies(rate: Column, id_: Column) -> Column:
    """A whole number of copies with the rate as its mean: a draw by hash of the id."""
    draw = F.pmod(F.xxhash64(id_, F.lit("mix")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.floor(rate + draw).cast("int")


@dataclass
class Mixer:
    classifier: Classifier
    mix: Mix
    fitted: DataFrame | None = None         # id, n, p of the rows that the rates were fitted to

    def rated(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, n_tokens, domain, one p_<domain> for each domain, rate and copies of each row."""
        return self._rated(self.classifier.rows(docs, id_col, text_col), id_col)

    def rated_fitted(self, id_col: str = "doc_id") -> DataFrame:
        """The same for the rows that the rates were fitted to; their texts aren't read again."""
        return self._rated(self.fitted, id_col)

    def _rated(self, rows, id_col):
        names, p = self.classifier.domains, F.col("p")
        best = F.lit(None).cast("string") if not names else F.get(
            F.expr("array(" + ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names) + ")"),
            F.array_position(p, F.array_max(p)).cast("int") - 1)
        d = rows.select("id", F.col("n").alias("n_tokens"), "p", best.alias("domain"), self.mix.rate(p).alias("rate"))
        return d.select(F.col("id").alias(id_col), "n_tokens", "domain",
                        *[F.get(p, F.lit(k)).alias(f"p_{n}") for k, n in enumerate(names)],
                        "rate", copies(F.col("rate"), F.col("id")).alias("copies"))


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None,
        floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
        margin: float = 1.0) -> Mixer:
    """Learn the classifier and the rates that bring ``docs`` to the target weights."""
    classifier = fit_classifier(docs, labelled, id_col, text_col, domain_col)
    rows = materialize(classifier.rows(docs, id_col, text_col), "posteriors")
    if not classifier.domains:
        return Mixer(classifier, Mix([], floor), rows)
    return Mixer(classifier, fit_rates(rows, classifier.domains, weights, budget, floor, margin=margin), rows)


def mixed_rows(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its copies say; all columns as they are."""
    many, copy = fresh(docs, "_copies"), fresh(docs, "_copy")
    p = mixer.classifier.posteriors(hashed_words(quoted(docs, text_col)))
    rate = let(p, lambda x: mixer.mix.rate(x)) if mixer.classifier.domains else mixer.mix.rate(F.lit(None))
    d = docs.withColumn(many, copies(rate, quoted(docs, id_col)))
    # an outer explode: no filter is inferred from it that would compute the rate twice
    d = d.withColumn(copy, F.explode_outer(F.when(F.col(many) > 0, F.sequence(F.lit(1), F.col(many)))))
    return d.filter(F.col(copy).isNotNull()).drop(many, copy)
