"""Each registered query against its DuckDB twin: columns, row counts, values."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else x + 0.0
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None)
        return x

    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def alike(some, others):
    """Rows that differ only by the last of six decimals: a sum whose digits end on half of it is rounded up or down by its order."""
    exact = lambda row: tuple(str(x) for x in row if not isinstance(x, float))
    doubles = lambda row: [x for x in row if isinstance(x, float)]
    order = lambda row: (exact(row), [round(x, 4) for x in doubles(row)])
    some, others = sorted(some, key=order), sorted(others, key=order)
    same = lambda a, b: exact(a) == exact(b) and all(abs(x - y) < 1.5e-6 for x, y in zip(doubles(a), doubles(b)))
    return len(some) == len(others) and all(map(same, some, others))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    got = canonical(df.collect(), df.columns)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert sum(got.values()) == sum(want.values()) > 0
    more, less = got - want, want - got
    assert alike(more.elements(), less.elements()), (list(more.items())[:3], list(less.items())[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
