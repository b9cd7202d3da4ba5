"""Queries of the training-data operators that SQL can express, against their twins."""

import duckdb
import pytest

from trellis.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = connection.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert df.columns == names
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
