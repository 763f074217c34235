"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than ASCII white space. A text fails the base rules when
it has under 50 words or when more than half of its words stand in three-word windows that
occur twice or more. Every other rule bounds one measure from below and above.

Defined cases: a null text counts as empty, and an empty text fails the base rules; measures
with a zero divisor are zero; rows come back once for each input row in no order; of the
input only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import pick

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "der die und in den von das zu mit sich des für auf ist nicht dem im ein eine als "
    "de la le et les des en un du une que pour est par dans qui sur pas avec au "
    "el y los del se las por con su no para es al lo"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``low <= measure <= high`` (either bound may be missing)."""

    name: str
    measure: str            # SQL over the measured columns
    low: float | None = None
    high: float | None = None

    def sql(self) -> str:
        tests = [f"{self.measure} >= {self.low}"] if self.low is not None else []
        tests += [f"{self.measure} <= {self.high}"] if self.high is not None else []
        return "(" + " AND ".join(tests or ["true"]) + ")"


BASE_RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("few_repeats", "100 * n_repeat_words - 50 * n_words", high=0),
)

RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", low=2.5, high=12),
    Rule("symbol_ratio", "n_symbols / greatest(n_words, 1)", high=0.1),
    Rule("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", low=0.05),
    Rule("repeated_line_ratio", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a pushed-down filter repeats
    the whole expression (a column used inside a lambda would be computed per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Texts with as many distinct window hashes as windows have none. Else the windows are
    sorted with their places, and the words covered by the repeated ones are counted.
    """
    zero = F.lit(0).cast("long")

    def window(ws, i):
        return F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)

    def places(ws):
        return F.sequence(F.lit(0), F.size(ws) - 3)

    def repeats(s):
        same = lambda k, o: F.coalesce(F.get(s, k)["w"] == F.get(s, o)["w"], F.lit(False))
        return F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
            lambda k: F.get(s, k)["i"]))

    def covered(r):
        return F.when(F.size(r) > 1, F.aggregate(
            F.sequence(F.lit(1), F.size(r) - 1), F.lit(3).cast("long"),
            lambda n, j: n + F.least(F.lit(3), F.get(r, j) - F.get(r, j - 1)))).otherwise(zero)

    def exact(ws):
        return let(F.sort_array(F.transform(places(ws), lambda i: F.struct(
            F.concat_ws(" ", *window(ws, i)).alias("w"), i.alias("i")))), lambda s: let(repeats(s), covered))

    def count(ws):
        hashes = F.transform(places(ws), lambda i: F.xxhash64(*window(ws, i)))
        return F.when(F.size(ws) < 4, zero).when(
            let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), zero).otherwise(exact(ws))

    return let(words, count)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and the counts that the rules are about; one narrow pass, no shuffle."""
    d = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("_words", F.filter(F.split("text", SPACE + "+"), lambda w: w != ""))
    d = d.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    return d.select(
        "id", "text", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
                base=BASE_RULES) -> DataFrame:
    """Counts, one boolean for each rule, ``base_failed`` and ``kept``."""
    m = measured(docs, id_col, text_col)
    verdicts = [F.expr(r.sql()).alias(f"ok_{r.name}") for r in rules]
    base_ok = F.expr(" AND ".join(r.sql() for r in base) or "true")
    all_ok = F.expr(" AND ".join(r.sql() for r in (*base, *rules)) or "true")
    return m.select(F.col("id").alias(id_col), *[c for c in m.columns if c not in ("id", "text")],
                    *verdicts, (~base_ok).alias("base_failed"), all_ok.alias("kept"))
