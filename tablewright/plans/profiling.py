"""Profiler queries on the driver tables, with their DuckDB oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.profile import domain_analysis, profile, profile_table, value_counts
from tablewright.plans import table
from tablewright.plans.oracle_profile import column_select, profile_sql, sql_pct

NUMERIC_OUT = ["table_name", "column_name", "sql_type", "min_data_length", "max_data_length",
               "avg_data_length", "no_nulls", "percentage_nulls", "no_distinct", "row_count"]
TEXT_OUT = ["table_name", "column_name", "min_data_length", "max_data_length",
            "avg_data_length", "no_nulls", "no_zero_length", "percentage_zero_length",
            "no_distinct", "row_count"]
DATE_OUT = ["table_name", "column_name", "sql_type", "min_date", "max_date",
            "no_date_with_hour_minute_second", "no_date_with_second", "no_distinct"]
LOOKS_OUT = ["table_name", "column_name", "no_is_numeric", "no_is_date", "no_distinct",
             "data_type_comments"]
NULLS_OUT = ["table_name", "column_name", "no_nulls", "percentage_nulls", "no_zero_length",
             "percentage_zero_length", "no_distinct", "data_type_comments"]
SUGGEST_OUT = ["table_name", "column_name", "sql_type", "data_type_comments"]
FK_OUT = ["table_name", "column_name", "is_fk", "no_distinct", "data_type_comments"]
LIMIT_OUT = ["table_name", "column_name", "no_at_limit", "data_type_comments"]
FULL_OUT = ["table_schema", "table_name", "column_name", "column_data_length", "sql_type",
            "min_data_length", "max_data_length", "avg_data_length", "min_date", "max_date",
            "no_distinct", "no_nulls", "no_zero_length", "percentage_nulls",
            "percentage_zero_length", "no_date_with_hour_minute_second", "no_date_with_second",
            "no_is_numeric", "no_is_date", "no_at_limit", "is_fk", "row_count",
            "data_type_comments"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _prof(df, name, out, **kw) -> DataFrame:
    return profile(df, table_name=name, **kw).profile.select(*out)


# -- derived inputs (the same rule written once for Spark and once for DuckDB) ------------

def _looks_like_input(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.col("o_orderdate").cast("string").alias("ts_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_text"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("compact_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_text"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .otherwise(F.col("o_orderpriority")).alias("mixed_text"),
        "o_orderpriority", "o_orderstatus")


LOOKS_SQL_SOURCE = """(SELECT CAST(o_orderkey AS VARCHAR) AS key_text,
  CAST(o_totalprice AS VARCHAR) AS price_text, CAST(o_orderdate AS VARCHAR) AS ts_text,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_text, strftime(o_orderdate, '%Y%m%d') AS compact_text,
  strftime(o_orderdate, '%m/%d/%Y') AS us_text,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END
    AS mixed_text, o_orderpriority, o_orderstatus FROM orders) x"""
LOOKS_COLS = ["key_text", "price_text", "ts_text", "iso_text", "compact_text", "us_text",
              "mixed_text", "o_orderpriority", "o_orderstatus"]


def _nulls_input(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.select(
        "doc_id", "lang", "quality", "toxic",
        F.when(F.col("doc_id") % 10 == 0, F.col("n_chars")).alias("rare_chars"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("   ")).otherwise(F.col("source"))
         .alias("source_blank"),
        F.when(F.col("doc_id") >= 0, F.lit(None).cast("string")).alias("never_set"))


NULLS_SQL_SOURCE = """(SELECT d.doc_id, d.lang, l.quality, l.toxic,
  CASE WHEN d.doc_id % 10 = 0 THEN d.n_chars END AS rare_chars,
  CASE WHEN d.doc_id % 5 = 0 THEN '   ' ELSE d.source END AS source_blank,
  CAST(CASE WHEN d.doc_id >= 0 THEN NULL END AS VARCHAR) AS never_set
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x"""
NULLS_COLS = [("doc_id", "numeric", "bigint"), ("lang", "text", "varchar"),
              ("quality", "numeric", "int"), ("toxic", "numeric", "int"),
              ("rare_chars", "numeric", "bigint"), ("source_blank", "text", "varchar"),
              ("never_set", "text", "varchar")]


def _events_sparse_input(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        F.when(F.col("user_id") % 10 != 0, F.col("value")).alias("value_sparse"),
        F.when(F.col("event_type") == "purchase", F.col("ts")).alias("purchase_ts"))


EVENTS_SQL_SOURCE = """(SELECT event_id, user_id, NULLIF(event_type, 'error') AS event_type,
  CASE WHEN user_id % 10 <> 0 THEN value END AS value_sparse,
  CASE WHEN event_type = 'purchase' THEN ts END AS purchase_ts FROM events) x"""
EVENTS_COLS = [("event_id", "numeric", "bigint"), ("user_id", "numeric", "bigint"),
               ("event_type", "text", "varchar"), ("value_sparse", "numeric", "float"),
               ("purchase_ts", "date", "datetime2")]

# -- Spark side ------------------------------------------------------------------------------


def q_profile_numeric(spark, d):
    return _prof(table(spark, d, "lineitem"), "lineitem", NUMERIC_OUT,
                 text=False, date=False, lob=False)


def q_profile_text(spark, d):
    return _union([_prof(table(spark, d, t), t, TEXT_OUT, numeric=False, date=False, lob=False)
                   for t in ("customer", "orders", "part")])


def q_profile_lob(spark, d):
    return _union([
        _prof(table(spark, d, "documents"), "documents", TEXT_OUT, columns=["text"],
              lob_cols=["text"]),
        _prof(table(spark, d, "pages"), "pages", TEXT_OUT, columns=["html"], lob_cols=["html"]),
    ])


def q_profile_datetime(spark, d):
    return _union([
        _prof(table(spark, d, t), t, DATE_OUT, text=False, numeric=False, lob=False)
        for t in ("events", "orders", "lineitem")])


def q_profile_looks_like(spark, d):
    return _prof(_looks_like_input(spark, d), "orders_text", LOOKS_OUT)


def q_profile_nulls(spark, d):
    return _prof(_nulls_input(spark, d), "documents_labels", NULLS_OUT, columns=[c for c, _, _ in NULLS_COLS])


def q_suggest_types(spark, d):
    return _union([_prof(table(spark, d, t), t, SUGGEST_OUT) for t in ("orders", "lineitem", "part")])


def q_suggest_cleanup(spark, d):
    return _prof(table(spark, d, "orders"), "orders", FK_OUT, fks=["o_custkey"])


def q_suggest_sparse(spark, d):
    return _prof(_events_sparse_input(spark, d), "events_sparse", NULLS_OUT,
                 columns=[c for c, _, _ in EVENTS_COLS])


def q_boundary_counts(spark, d):
    return _union([_prof(table(spark, d, t), t, LIMIT_OUT, advanced=True)
                   for t in ("labels", "orders", "lineitem")])


# The driver tables' foreign keys, as a constraint catalogue (schema facts, one row per
# constraint and per constrained column).
TPCH_CONSTRAINTS = [
    ("fk_lineitem_orders", "tpch", "lineitem", "FOREIGN KEY", "l_orderkey"),
    ("fk_lineitem_part", "tpch", "lineitem", "FOREIGN KEY", "l_partkey"),
    ("fk_lineitem_supplier", "tpch", "lineitem", "FOREIGN KEY", "l_suppkey"),
    ("pk_lineitem", "tpch", "lineitem", "PRIMARY KEY", "l_orderkey"),
    ("pk_lineitem", "tpch", "lineitem", "PRIMARY KEY", "l_linenumber"),
    ("fk_orders_customer", "tpch", "orders", "FOREIGN KEY", "o_custkey"),
    ("pk_orders", "tpch", "orders", "PRIMARY KEY", "o_orderkey"),
    ("fk_customer_nation", "tpch", "customer", "FOREIGN KEY", "c_nationkey"),
]


def q_flag_foreign_keys(spark, d):
    from tablewright.operators.catalog import foreign_key_columns
    rows = TPCH_CONSTRAINTS
    tc = spark.createDataFrame(sorted({r[:4] for r in rows}),
                               "constraint_name string, table_schema string, table_name string, "
                               "constraint_type string")
    cu = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in rows],
                               "constraint_name string, table_schema string, table_name string, "
                               "column_name string")
    fks = foreign_key_columns(tc, cu, "tpch", "lineitem")
    return _prof(table(spark, d, "lineitem"), "lineitem", FK_OUT, fks=fks)


def q_profile_table(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("tw_profile_orders")
    return profile_table(spark, "tw_profile_orders").profile.select(*FULL_OUT)


BINARY_OUT = ["table_name", "column_name", "sql_type", "column_data_length", "min_data_length",
              "max_data_length", "avg_data_length", "no_zero_length", "no_distinct",
              "data_type_comments"]


def q_profile_binary(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("text").cast("binary").alias("body"),
        F.unhex(F.md5("text")).alias("fingerprint"))
    return _prof(docs, "documents_bytes", BINARY_OUT, columns=["body", "fingerprint"],
                 lob_cols=["body"])


DOMAIN_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "lang", "source", "n_chars"],
}


OTHER_OUT = ["table_name", "column_name", "type_class", "sql_type", "min_data_length",
             "max_data_length", "no_nulls", "no_distinct", "row_count", "data_type_comments"]


def q_profile_other(spark, d):
    """Classes outside text/number/date (array, boolean): nulls and distinct counts only."""
    e = table(spark, d, "embeddings").select(
        "embedding", "label", (F.col("label") % 2 == 0).alias("even_label"))
    return _prof(e, "embeddings", OTHER_OUT, columns=["embedding", "label", "even_label"])


def q_profile_nonfinite(spark, d):
    """NaN, infinities and values beyond any decimal, planted by content rules."""
    li = table(spark, d, "lineitem")
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    df = li.select(
        F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("inf")))
         .when(n == 3, F.lit(float("-inf"))).when(n == 4, F.lit(None)).otherwise(price).alias("odd"),
        F.when(n == 5, F.lit(1e40)).otherwise(price).alias("huge"),
        F.when(n > 0, F.lit(float("nan"))).alias("never"))
    p = profile(df, table_name="lineitem_odd").profile
    scaled = F.when(F.col("column_name") == "huge", F.round(F.col("avg_data_length") / 1e36, 3)).otherwise(
        F.round("avg_data_length", 4))
    return p.select("column_name", "min_data_length", "max_data_length", scaled.alias("mean_scaled"), "no_non_finite",
                    "no_nulls", "no_distinct", "row_count")


DATES_OUT = ["table_name", "column_name", "sql_type", "no_date_with_hour_minute_second",
             "no_date_with_second", "data_type_comments"]


def q_suggest_dates(spark, d):
    """The three date remarks on timestamps with and without a zone."""
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    day, minute = F.to_timestamp_ntz(F.to_date(ts)), F.date_trunc("MINUTE", ts.cast("timestamp"))
    old = F.lit("1850-03-04 05:06:07").cast("timestamp_ntz")
    df = e.select(
        day.alias("ntz_day"), minute.cast("timestamp_ntz").alias("ntz_minute"), ts.alias("ntz_full"),
        F.when(F.col("user_id") % 2 == 0, old).otherwise(ts).alias("ntz_old"),
        day.cast("timestamp").alias("tz_day"), minute.alias("tz_minute"), ts.cast("timestamp").alias("tz_full"))
    return _prof(df, "events_dates", DATES_OUT, columns=df.columns)


def q_profile_domains(spark, d):
    """The domains that an advanced profile returns beside the profile."""
    df = table(spark, d, "documents").select("lang", "source", "doc_id")
    return profile(df, advanced=True).domains


def q_profile_estimated(spark, d):
    """With estimated distinct counts: which columns are estimated, and the exact rest."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    p = profile(li, approx_distinct=0.05).profile
    return p.select("column_name", "distinct_estimated",
                    F.when(~F.col("distinct_estimated"), F.col("no_distinct")).alias("exact_distinct"),
                    "min_data_length", "max_data_length", "no_nulls", "row_count")


def q_profile_collated(spark, d):
    """Distinct counts of text compared without case and trailing blanks."""
    o = table(spark, d, "orders")
    df = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority"))
                   .otherwise(F.col("o_orderpriority")).alias("prio"),
                  F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderstatus", F.lit("  ")))
                   .otherwise(F.col("o_orderstatus")).alias("status"))
    return profile(df, collation="UTF8_LCASE_RTRIM").profile.select("column_name", "no_distinct", "row_count")


def q_suggest_filestream(spark, d):
    """Long binary values: pages as they are (small), and 16 KiB blocks of each repeated to
    over a megabyte."""
    pages = table(spark, d, "pages")
    block = F.rpad(F.substring("html", 1, 1000), 1000, ".")
    df = pages.select(F.col("html").cast("binary").alias("page"),
                      F.repeat(block, 1050).cast("binary").alias("blown_up"))
    return _prof(df, "pages_files", ["table_name", "column_name", "sql_type", "data_type_comments"],
                 columns=["page", "blown_up"], lob_cols=["page", "blown_up"])


def q_value_counts(spark, d):
    return value_counts(table(spark, d, "events"), DOMAIN_TABLES["events"])


def q_domain_analysis(spark, d):
    frames = []
    for t, cols in DOMAIN_TABLES.items():
        frames.append(domain_analysis(value_counts(table(spark, d, t), cols)))
    return _union(frames)


# -- oracle ----------------------------------------------------------------------------------

def _selects(source, name, cols, **kw):
    return [column_select(source, name, c, cls, st, **kw) for c, cls, st in cols]


def _wrap(selects, out, **kw):
    return f"SELECT {', '.join(out)} FROM ({profile_sql(selects, **kw)}) q"


LINEITEM_NUM = [("l_orderkey", "numeric", "bigint"), ("l_partkey", "numeric", "bigint"),
                ("l_suppkey", "numeric", "bigint"), ("l_linenumber", "numeric", "int"),
                ("l_quantity", "numeric", "float"), ("l_extendedprice", "numeric", "float"),
                ("l_discount", "numeric", "float"), ("l_tax", "numeric", "float")]
TABLE_COLS = {
    "customer": [("c_custkey", "numeric", "bigint"), ("c_name", "text", "varchar"),
                 ("c_nationkey", "numeric", "int"), ("c_acctbal", "numeric", "float"),
                 ("c_mktsegment", "text", "varchar")],
    "orders": [("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"),
               ("o_orderstatus", "text", "varchar"), ("o_totalprice", "numeric", "float"),
               ("o_orderdate", "date", "datetime2"), ("o_orderpriority", "text", "varchar")],
    "part": [("p_partkey", "numeric", "bigint"), ("p_name", "text", "varchar"),
             ("p_brand", "text", "varchar"), ("p_type", "text", "varchar"),
             ("p_size", "numeric", "int"), ("p_retailprice", "numeric", "float")],
    "lineitem": LINEITEM_NUM + [("l_returnflag", "text", "varchar"),
                                ("l_linestatus", "text", "varchar"),
                                ("l_shipdate", "date", "datetime2")],
    "labels": [("doc_id", "numeric", "bigint"), ("quality", "numeric", "int"),
               ("toxic", "numeric", "int")],
    "events": [("event_id", "numeric", "bigint"), ("ts", "date", "datetime2"),
               ("user_id", "numeric", "bigint"), ("event_type", "text", "varchar"),
               ("value", "numeric", "float"), ("props", "text", "varchar")],
}


def _of_class(t, cls):
    return [c for c in TABLE_COLS[t] if c[1] == cls]


def _union_sql(parts):
    return "\nUNION ALL\n".join(parts)


def _domain_sql():
    parts = []
    for t, cols in DOMAIN_TABLES.items():
        for c in cols:
            parts.append(f"SELECT '{c}' AS domain_name, CAST(\"{c}\" AS VARCHAR) AS domain_element, "
                         f"COUNT(*) AS domain_counter FROM {t} GROUP BY 2")
    return f"""WITH v AS ({_union_sql(parts)}),
d AS (SELECT domain_name, COUNT(domain_element) AS nd, SUM(domain_counter) AS total
      FROM v GROUP BY domain_name)
SELECT v.domain_name, v.domain_element, v.domain_counter,
       {sql_pct('v.domain_counter', 'd.total', 4, 7)} AS domain_percent
FROM v JOIN d ON v.domain_name = d.domain_name WHERE d.nd < 200"""


ORACLE = {
    "profile_numeric": _wrap(_selects("lineitem", "lineitem", LINEITEM_NUM), NUMERIC_OUT),
    "profile_text": _union_sql([
        _wrap(_selects(t, t, _of_class(t, "text")), TEXT_OUT) for t in ("customer", "orders", "part")]),
    "profile_lob": _union_sql([
        _wrap(_selects("documents", "documents", [("text", "lob", "varchar")], decl="-1"), TEXT_OUT),
        _wrap(_selects("pages", "pages", [("html", "lob", "varchar")], decl="-1"), TEXT_OUT)]),
    "profile_datetime": _union_sql([
        _wrap(_selects(t, t, _of_class(t, "date")), DATE_OUT) for t in ("events", "orders", "lineitem")]),
    "profile_looks_like": _wrap(_selects(LOOKS_SQL_SOURCE, "orders_text",
                                         [(c, "text", "varchar") for c in LOOKS_COLS]), LOOKS_OUT),
    "profile_nulls": _wrap(_selects(NULLS_SQL_SOURCE, "documents_labels", NULLS_COLS), NULLS_OUT),
    "suggest_types": _union_sql([
        _wrap(_selects(t, t, TABLE_COLS[t]), SUGGEST_OUT) for t in ("orders", "lineitem", "part")]),
    "suggest_cleanup": _wrap(_selects("orders", "orders", TABLE_COLS["orders"]), FK_OUT,
                             fks=["o_custkey"]),
    "suggest_sparse": _wrap(_selects(EVENTS_SQL_SOURCE, "events_sparse", EVENTS_COLS), NULLS_OUT),
    "boundary_counts": _union_sql([
        _wrap(_selects(t, t, TABLE_COLS[t], at_limit=True), LIMIT_OUT, boundary=0.57)
        for t in ("labels", "orders", "lineitem")]),
    "domain_analysis": _domain_sql(),
    "profile_other": _wrap(
        _selects("(SELECT embedding, label, label % 2 = 0 AS even_label FROM embeddings) x",
                 "embeddings", [("embedding", "other", "array<float>"), ("label", "numeric", "int"),
                                ("even_label", "other", "bit")]),
        ["table_name", "column_name", "CASE WHEN sql_type = 'int' THEN 'numeric' ELSE 'other' END"
         " AS type_class", "sql_type", "min_data_length", "max_data_length", "no_nulls",
         "no_distinct", "row_count", "data_type_comments"]),
    "value_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(\"{c}\" AS VARCHAR) AS value, COUNT(*) AS count "
        f"FROM events GROUP BY 2" for c in DOMAIN_TABLES["events"]),
    "profile_nonfinite": """WITH x AS (SELECT
    CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE
         WHEN 4 THEN NULL ELSE l_extendedprice END AS odd,
    CASE WHEN l_linenumber = 5 THEN 1e40 ELSE l_extendedprice END AS huge, 'nan'::DOUBLE AS never
  FROM lineitem)
SELECT 'odd' AS column_name, CAST(MIN(odd) FILTER (WHERE isfinite(odd)) AS DECIMAL(38,6)) AS min_data_length,
  CAST(MAX(odd) FILTER (WHERE isfinite(odd)) AS DECIMAL(38,6)) AS max_data_length,
  round(AVG(odd) FILTER (WHERE isfinite(odd)), 4) AS mean_scaled,
  COUNT(*) FILTER (WHERE NOT isfinite(odd)) AS no_non_finite, COUNT(*) FILTER (WHERE odd IS NULL) AS no_nulls,
  COUNT(DISTINCT odd) AS no_distinct, COUNT(*) AS row_count FROM x
UNION ALL SELECT 'huge', CAST(MIN(huge) AS DECIMAL(38,6)), NULL, round(AVG(huge) / 1e36, 3), 0, 0,
  COUNT(DISTINCT huge), COUNT(*) FROM x
UNION ALL SELECT 'never', NULL, NULL, NULL, COUNT(*), 0, 1, COUNT(*) FROM x""",
    "suggest_dates": _wrap(_selects("""(SELECT date_trunc('day', ts) AS ntz_day, date_trunc('minute', ts) AS ntz_minute,
  CAST(ts AS TIMESTAMP) AS ntz_full,
  CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '1850-03-04 05:06:07' ELSE ts END AS ntz_old,
  date_trunc('day', ts) AS tz_day, date_trunc('minute', ts) AS tz_minute, CAST(ts AS TIMESTAMP) AS tz_full
  FROM events) x""", "events_dates",
        [(c, "date", "datetime2" if c.startswith("ntz") else "datetime")
         for c in ("ntz_day", "ntz_minute", "ntz_full", "ntz_old", "tz_day", "tz_minute", "tz_full")]), DATES_OUT),
    "profile_domains": f"""WITH v AS (
  SELECT 'lang' AS domain_name, lang AS domain_element, COUNT(*) AS domain_counter FROM documents GROUP BY 2
  UNION ALL SELECT 'source', source, COUNT(*) FROM documents GROUP BY 2
  UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR), COUNT(*) FROM documents GROUP BY 2),
d AS (SELECT domain_name, COUNT(domain_element) AS nd, SUM(domain_counter) AS total FROM v GROUP BY domain_name)
SELECT v.domain_name, v.domain_element, v.domain_counter,
       {sql_pct('v.domain_counter', 'd.total', 4, 7)} AS domain_percent
FROM v JOIN d ON v.domain_name = d.domain_name WHERE d.nd < 200""",
    "profile_estimated": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {est} AS distinct_estimated,
  CASE WHEN NOT {est} THEN COUNT(DISTINCT {c}) END AS exact_distinct,
  CAST(MIN({m}) AS DECIMAL(38,6)) AS min_data_length, CAST(MAX({m}) AS DECIMAL(38,6)) AS max_data_length,
  COUNT(*) FILTER (WHERE {c} IS NULL) AS no_nulls, COUNT(*) AS row_count FROM lineitem"""
        for c, est, m in (("l_orderkey", "true", "l_orderkey"), ("l_linenumber", "false", "l_linenumber"),
                          ("l_returnflag", "false", "length(l_returnflag)"), ("l_quantity", "false", "l_quantity"))),
    "profile_collated": """SELECT 'prio' AS column_name, COUNT(DISTINCT lower(o_orderpriority)) AS no_distinct,
  COUNT(*) AS row_count FROM orders
UNION ALL SELECT 'status', COUNT(DISTINCT lower(o_orderstatus)), COUNT(*) FROM orders""",
    "suggest_filestream": """SELECT 'pages_files' AS table_name, 'page' AS column_name, 'varbinary' AS sql_type,
  CASE WHEN AVG(octet_length(encode(html))) >= 1000000 THEN 'Possibly a good candidate for FILESTREAM.'
       ELSE 'Possibly not a good candidate for FILESTREAM.' END AS data_type_comments FROM pages
UNION ALL SELECT 'pages_files', 'blown_up', 'varbinary', 'Possibly a good candidate for FILESTREAM.'
FROM (SELECT COUNT(*) AS n FROM pages) t WHERE n > 0""",
    "flag_foreign_keys": _wrap(_selects("lineitem", "lineitem", TABLE_COLS["lineitem"]), FK_OUT,
                               fks=["l_orderkey", "l_partkey", "l_suppkey"]),
    "profile_binary": _wrap(_selects(
        "(SELECT encode(text) AS body, unhex(md5(text)) AS fingerprint FROM documents) x",
        "documents_bytes", [("body", "lob", "varbinary")], decl="-1")
        + _selects("(SELECT encode(text) AS body, unhex(md5(text)) AS fingerprint FROM documents) x",
                   "documents_bytes", [("fingerprint", "binary", "binary")]), BINARY_OUT),
    "profile_table": "SELECT 'default' AS table_schema, " + ", ".join(FULL_OUT[1:]) + " FROM ("
                     + profile_sql([column_select("orders", "tw_profile_orders", c, cls, st,
                                                  decl="NULL" if cls == "text" else "0")
                                    for c, cls, st in TABLE_COLS["orders"]]) + ") q",
}

QUERIES = {
    "profile_numeric": q_profile_numeric,
    "profile_text": q_profile_text,
    "profile_lob": q_profile_lob,
    "profile_datetime": q_profile_datetime,
    "profile_looks_like": q_profile_looks_like,
    "profile_nulls": q_profile_nulls,
    "suggest_types": q_suggest_types,
    "suggest_cleanup": q_suggest_cleanup,
    "suggest_sparse": q_suggest_sparse,
    "boundary_counts": q_boundary_counts,
    "domain_analysis": q_domain_analysis,
    "profile_table": q_profile_table,
    "profile_binary": q_profile_binary,
    "flag_foreign_keys": q_flag_foreign_keys,
    "value_counts": q_value_counts,
    "profile_nonfinite": q_profile_nonfinite,
    "suggest_dates": q_suggest_dates,
    "profile_domains": q_profile_domains,
    "profile_estimated": q_profile_estimated,
    "profile_collated": q_profile_collated,
    "suggest_filestream": q_suggest_filestream,
    "profile_other": q_profile_other,
}
