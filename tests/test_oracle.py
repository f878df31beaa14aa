"""Every query outside the corpus subpackage against its SQL on the smallest data."""

import os

import pytest

from tracewright.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


#: Not to be said in SQL; tests/test_bytepair.py holds it to a public encoder.
NO_SQL = {"str_token_count_merges"}


def test_all_have_sql():
    assert set(catalog.QUERIES) - NO_SQL == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    at = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(rounded(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
