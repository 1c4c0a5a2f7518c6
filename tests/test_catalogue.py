"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from shoebox.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got or name in MAY_BE_EMPTY
    if name in catalogue.ORACLES:
        cur = db.execute(catalogue.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=names.__getitem__)
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)


MAY_BE_EMPTY = {"geo_radius", "search_filter_only", "bursts_60s"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
