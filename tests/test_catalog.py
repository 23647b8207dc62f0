"""Every registered query that SQL can express equals that SQL on the small fixture tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from bandloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.8g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def test_names_agree():
    assert set(SQL) <= set(QUERIES) and catalog.FLAGSHIP in QUERIES and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert rows == want
