"""Every query against its SQL oracle on the smallest tables."""

import math

import duckdb
import pytest

from engramix.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.7g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    want = duck.execute(catalog.ORACLE_SQL[name])
    cols = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in cols]
    rows = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL)
    assert rows.count() > 0 and rows.exceptAll(catalog.QUERIES[name](spark, SMALL)).isEmpty()
