"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusmill.plans import registry

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, TABLES)
    names = sorted(got.columns)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    rows = sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())
    assert sorted(str([plain(r[c]) for c in names]) for r in got.collect()) == rows


def test_queries_without_sql_run(spark):
    for name, run in registry.queries().items():
        if name not in ORACLE:
            assert run(spark, TABLES).columns
