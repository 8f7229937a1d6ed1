"""All registered queries of the library against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from granary.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA).toPandas()
    if name not in oracle_sql():
        assert len(got)
        return
    want = duck.execute(oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    columns = sorted(got)
    got = got[columns].sort_values(columns).reset_index(drop=True)
    want = want[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_arrays_of_the_whole_table(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    sizes = {"axis_std": n, "axis_argmax": n, "cumsum": 64 * n, "broadcast": 64 * n, "reshape": 64 * n, "sort": 64 * n}
    for name, rows in sizes.items():
        assert queries()[f"array_{name}"](spark, DATA).count() == rows, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
