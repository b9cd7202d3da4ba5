"""Every registered query with an SQL twin gives the twin's rows."""

import datetime
import decimal
import os

import duckdb
import pytest

from trellis.plans import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    expected = rows_of(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(expected)
    assert got == expected
    assert got or name in ("inferred_topk_union",)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, name):
    # a count would leave out the columns that nothing is made of
    assert queries.QUERIES[name](spark, SF).collect()
