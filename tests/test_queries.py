"""Every registered core query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessellex.plans import registry

DATA = "/root/testdata/sf0.001"


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted("|".join(map(_cell, r)) for r in df.select(*columns).collect())
    result = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == columns
    assert got == sorted("|".join(_cell(r[i]) for i in order) for r in result.fetchall())
