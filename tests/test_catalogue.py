"""Every catalogue query against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tessera import catalogue


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        return [plain(x) for x in v] if isinstance(v, list) else v

    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalogue.ORACLE_SQL:
        cur = con.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(cur.fetchall(), names)


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
