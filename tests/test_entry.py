import importlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracle_check as oc

DATA = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(m) for m in entry._MODULES]
WITH_SQL = [(m, k) for m in MODULES for k in m.SQL]


def test_names():
    qs = entry.queries()
    assert set(entry.oracle_sql()) <= set(qs) and len(qs) > 60


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("module,name", WITH_SQL, ids=[k for _, k in WITH_SQL])
def test_against_sql(spark, module, name):
    import duckdb

    con = duckdb.connect()
    oc.views(con, DATA)
    df = module.QUERIES[name](spark, DATA)
    cur = con.execute(module.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert oc.rows_of(df.columns, df.collect()) == oc.rows_of(cols, cur.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
