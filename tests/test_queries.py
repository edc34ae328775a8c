"""Every core query with SQL against DuckDB at the smallest scale."""

import math
import os
from collections import Counter

import pytest

from reconlake import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    r = duck.execute(core.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(shown(x[i]) for i in at) for x in r.fetchall())
    assert Counter(tuple(shown(x[c]) for c in columns) for x in df.collect()) == want
