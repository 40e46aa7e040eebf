"""Every query that has SQL gives what the SQL gives, and the rest run; the training-data
subpackage can be taken away."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(repr, map(plain, r))) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 0


def test_rest_stands_alone():
    code = "import sys; sys.modules['chatterloom.llm'] = None; import __spark_entry__ as e; assert e.llm_catalog is None and 'turns' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
