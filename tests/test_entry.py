"""The driver contract: names agree, and queries give what their SQL gives on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from trackweave import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert set(plans.queries()) <= set(queries)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 5) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_against_sql(spark, tables, name):
    df = plans.queries()[name](spark, DATA)
    rel = tables.execute(plans.oracles()[name])
    names = [c[0] for c in rel.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want
