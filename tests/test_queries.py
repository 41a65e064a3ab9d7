"""Every query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from mezze import registry

SQL = registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    rows = registry.queries()[name](spark, sf_dir)
    columns = sorted(rows.columns)
    got = sorted(str([plain(v) for v in r]) for r in rows.select(columns).collect())
    if name not in SQL:
        assert got
        return
    want = sorted(str([plain(v) for v in r]) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert got == want
