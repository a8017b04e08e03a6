"""Every catalogued query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from assaykit.plans import catalog, generated  # noqa: F401  generated adds its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        if isinstance(v, list):
            return repr([plain(x) for x in v])
        return f"{float(v):.6f}" if isinstance(v, (int, float)) else repr(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = sql.execute(catalog.SQL[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
