"""Every query of the core against DuckDB on the smallest tables."""

import math
import os

import pytest

from echotide.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _rows(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = _rows(df.select(*columns).collect())
    assert ours
    if name in ORACLES:
        theirs = duck.sql(ORACLES[name])
        order = [theirs.columns.index(c) for c in columns]
        assert ours == _rows([r[i] for i in order] for r in theirs.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 64
    assert set(e.oracle_sql()) <= set(e.queries())
