"""Every catalog query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tidewire import catalog

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    rows = catalog.QUERIES[name](spark, ROOT)
    got = rows.collect()
    if name not in catalog.ORACLES:
        return
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(rows.columns)
    want = [tuple(norm(r[rel.columns.index(c)]) for c in sorted(rel.columns)) for r in rel.fetchall()]
    assert sorted((tuple(norm(r[c]) for c in sorted(rows.columns)) for r in got), key=repr) == sorted(want, key=repr)


def test_entry_points(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
