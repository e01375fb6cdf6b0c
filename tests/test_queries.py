"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from docloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return round(float(v), 6) if hasattr(v, "as_integer_ratio") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())
    else:
        assert got


def test_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
