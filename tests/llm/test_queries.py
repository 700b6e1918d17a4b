"""The SQL-backed queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tests.test_entry import DATA, TABLES, plain
from trackweave.llm import queries


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    rel = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want
