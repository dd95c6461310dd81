"""Every query of the library against its SQL on the small tables."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

from shardwright.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert got
        return
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_library_stands_without_the_training_data_operators():
    import re

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "shardwright")
    for d, _, files in os.walk(root):
        if os.sep + "llm" in d[len(root) :]:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"(import|from) .*\bllm\b", open(os.path.join(d, f)).read()), f
