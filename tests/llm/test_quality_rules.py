import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from tablewright.llm import quality_rules as Q, registry


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    cov = {i + o for i in range(len(ws) - 2) if c[tuple(ws[i:i + 3])] > 1 for o in range(3)}
    n = len(ws)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cov),
            n < 50 or 100 * len(cov) > 50 * n)


GOOD = " ".join(f"the w{i} of" for i in range(40))
TEXTS = [None, "", " ", "\n\n", "a", "a b c a b c", "a a a", "a a a a a", "x\ny\nx\n x\nx", "é\x85ü\xa0z ｗ",
         "a|b <c> #d $5 %& *", GOOD, GOOD, "und " * 20_000, GOOD + "\n" + GOOD, "\x0b\x0c\r\t a\x0bb",
         " ".join(f"w{i}" for i in range(20_000)), " ".join(f"w{i % 7000}" for i in range(20_000)), "🙂 " * 60,
         " ".join(f"w{i}***" for i in range(60)), "a " * 49, "b " * 3]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_words int, _words string")
    return {r.doc_id: r for r in Q.apply_rules(df).collect()}


def check(spark, texts):
    got = run(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t and t[:60]
        assert not (r.kept and r.base_failed)
    return got


def test_counts(spark):
    got = check(spark, TEXTS)
    assert got[11].kept and got[12].kept and not got[19].kept and not got[0].kept


def test_random_texts(spark):
    texts = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="ab \n\t#é|", max_size=60))
    def add(t):
        texts.append(t)
    add()
    check(spark, texts)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, "x"), (1, "x"), (1, "x")], "doc_id long, text string")
    assert Q.apply_rules(df).count() == 4
    assert Q.apply_rules(df.limit(0)).count() == 0
    assert Q.apply_rules(df, rules=(), base=()).filter("kept").count() == 4


def test_native(spark):
    df = registry.QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    df = registry.QUERIES["op1_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = df.filter("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_query_matches_sql(spark):
    import duckdb
    from oracle_check import digest
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cur = con.execute(registry.ORACLE["op1_quality_rules"])
    df = registry.QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01")
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest([d[0] for d in cur.description], cur.fetchall())[0]
