"""Registered queries against SQL, and the guard around the subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from gavel.llm import queries, sql

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "pages"]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_matches(spark, engine, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([repr(tuple(r[c] for c in columns)) for r in df.collect()])
    expected = engine.sql(sql.ORACLE_SQL[name])
    at = [expected.columns.index(c) for c in columns]
    assert sorted(expected.columns) == columns
    assert got == sorted([repr(tuple(r[i] for i in at)) for r in expected.fetchall()])


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names}
    assert "pipeline" in names and set(sql.ORACLE_SQL) <= set(entry.oracle_sql())


NATIVE = ["op2_line_dedup", "op6_quality_rules", "op9_url_filter", "op10_mix_sources"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_use_no_python(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_entry_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in ("gavel", "corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(entry.__file__).read())
    (tmp_path / "gavel").mkdir()
    for name in os.listdir(f"{root}/gavel"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/gavel/{name}", tmp_path / "gavel" / name)
    code = "import __spark_entry__ as e; q = e.queries(); print('market_snapshot' in q, 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.split() == ["True", "False"], said.stderr
