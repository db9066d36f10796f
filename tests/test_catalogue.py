"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from tidewheel.operators import catalogue

TABLES = "region nation customer supplier part orders lineitem events labels".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf, db, name):
    got, want = catalogue.QUERIES[name](spark, sf), db.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_flagship_covers_every_level(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5 and sum(r.n for r in rows) > 0
