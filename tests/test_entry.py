"""The driver's contract, with and without the corpus operators, and queries against SQL on rows of every kind."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "creditloom", tmp_path / "creditloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_names_and_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 40 and all(callable(f) for f in queries.values())


def test_some_queries_equal_sql(spark):
    """A few of the queries on the smallest driver tables, where these are present."""
    duckdb = pytest.importorskip("duckdb")
    sf_dir = Path("/root/testdata/sf0.001")
    if not sf_dir.exists():
        pytest.skip("no driver tables")
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name in ("dq_performance_summary", "panel_integrity", "empirical_matrix", "vintage_curves_masked", "lgd_by_era", "scenario_paths"):
        df = queries[name](spark, str(sf_dir))
        want = con.sql(sql[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns), name
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        assert got == sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall()), name
    assert entry.entry(spark).count() == 81
