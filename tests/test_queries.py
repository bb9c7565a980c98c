"""Every registered query at the smallest scale: equal to its SQL, or at least non-failing where SQL cannot say it."""

import math
import os

import duckdb
import pytest

from trajlake.plans.catalog import ORACLE, QUERIES

SF = os.environ.get("TRAJLAKE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, other, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in ORACLE:
        assert got
        return
    cur = other.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert len(got) == len(want) and got == want
