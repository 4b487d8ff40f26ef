"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from quillmark.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not there")


def plain(row):
    return tuple(None if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(columns).collect()), key=str)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted((plain([r[names.index(c)] for c in columns]) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0


def test_entry_imports_without_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
