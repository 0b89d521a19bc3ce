"""Every query of the catalogue against DuckDB on the smallest tables."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from quillforge import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck(tiny):
    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, tiny, duck, name):
    df = plans.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    cursor = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
