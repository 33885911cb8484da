"""Every registered query against its SQL on DuckDB."""

import decimal
import glob
import os

import duckdb
import pytest

from palimpsest.plans import registry


def _same(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 7)
    return tuple(map(_same, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(_same(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in registry.SQL:
        found = duck.execute(registry.SQL[name])
        own = [d[0] for d in found.description]
        assert sorted(own) == columns
        at = [own.index(c) for c in columns]
        assert sorted((tuple(_same(r[i]) for i in at) for r in found.fetchall()), key=repr) == rows
