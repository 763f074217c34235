"""Driver contract and differential check: every registered query against its DuckDB
oracle on the sf0.001 tables (row count, column names, order-insensitive value hash)."""

import os
import shutil
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

import __spark_entry__ as entry_mod  # noqa: E402

from tablewright.plans import registry  # noqa: E402

# the optional parts (training-data operators, corpus pipeline) have tests of their own
QUERIES, ORACLE = registry()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 8 and "column_name" in df.columns


def test_oracle_keys_are_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert set(QUERIES) <= set(entry_mod.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_the_optional_parts(tmp_path, pipeline_too):
    """A copy without the training-data operators keeps all the other queries."""
    root = os.path.dirname(os.path.abspath(entry_mod.__file__))
    shutil.copytree(os.path.join(root, "tablewright"), tmp_path / "tablewright",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    if pipeline_too:
        shutil.copy(os.path.join(root, "corpus_pipeline.py"), tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == sorted(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import digest
    sdf = QUERIES[name](spark, SF)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        return
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
