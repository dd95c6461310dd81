"""The training-data queries that have SQL, against it."""

from collections import Counter

import duckdb
import pytest

from shardwright.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, "/root/testdata/sf0.01")
    cols = sorted(df.columns)
    rel = duck.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == want
