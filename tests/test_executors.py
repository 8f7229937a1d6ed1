"""Work that stays on the executors: whole columns do not pass through the driver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.operators import ndarray as nd
from granary.operators.groupby import group_reduce, reduce_columns
from granary.operators.table import Table
from granary.queries import queries
from granary.sources import connector, tabular

DATA = "/root/testdata/sf0.001"

#: Queries whose result grows with their table.
WHOLE = ["array_packed", "array_source", "group_reduced_arrays", "sort_positions", "column_chunks", "io_arrow_batches", "io_arrow_stream"]


@pytest.fixture
def no_rows_on_driver(spark, monkeypatch):
    """Rows neither come to the driver nor start from it."""

    def refuse(*a, **k):
        raise AssertionError("rows pass through the driver")

    for name in ("collect", "toPandas", "toArrow", "toLocalIterator", "first", "head", "take"):
        monkeypatch.setattr(type(spark.range(1)), name, refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", refuse)


@pytest.mark.parametrize("name", WHOLE)
def test_no_rows_on_driver(spark, no_rows_on_driver, name):
    assert queries()[name](spark, DATA).count()


def test_packed_arrays(spark):
    x = np.arange(30, dtype=float).reshape(2, 3, 5)
    x[0, 1, 2] = np.nan
    parts = nd.array(spark, x).pack(7)
    assert sorted(r.start for r in parts.collect()) == [0, 7, 14, 21, 28]
    back = nd.Array.unpack(parts)
    assert back.shape == x.shape
    np.testing.assert_array_equal(back.to_numpy(), x)
    for values in (np.array(5), np.array([1, 2, 3]), np.array([1 + 2j, 3]), np.array(["a", "é"])):
        found = nd.Array.unpack(nd.array(spark, values).pack(2))
        assert found.shape == values.shape
        np.testing.assert_array_equal(found.to_numpy(), values)
    assert nd.Array.unpack(nd.zeros(spark, (0, 3)).pack()).to_numpy().shape == (0, 3)


def test_array_source(spark, monkeypatch):
    x = np.arange(35, dtype=float).reshape(5, 7)
    source = connector.ArraySource(nd.array(spark, x), (2, 3))
    assert (source.shape, source.chunks) == ((5, 7), (2, 3))
    np.testing.assert_array_equal(source.get_chunk((2, 2)), x[4:, 6:])
    np.testing.assert_array_equal(connector.read_source(spark, source).to_numpy(), x)
    asked, cells = [], source.cells
    monkeypatch.setattr(source, "cells", lambda wanted: asked.append(sorted(wanted)) or cells(wanted))
    for most in (1000, 1):
        monkeypatch.setattr(connector, "MOST_LISTED", most)
        proxy = connector.Proxy(spark, source)
        asked.clear()
        np.testing.assert_array_equal(proxy.fetch((slice(0, 2), slice(0, 4))).to_numpy(), x[:2, :4])
        np.testing.assert_array_equal(proxy.fetch((slice(0, 4), slice(2, 5))).to_numpy(), x[:4, 2:5])
        assert asked == [[(0, 0), (0, 1)], [(1, 0), (1, 1)]]
    whole = connector.ArraySource(nd.array(spark, np.array([3, 1, 2])), (2,))
    assert whole.dtype == np.int64 and proxy.fetch((slice(0, 0), slice(0, 7))).size == 0
    np.testing.assert_array_equal(connector.read_source(spark, whole).to_numpy(), [3, 1, 2])


def test_reduced_columns(spark):
    nan = float("nan")
    data = [(1.0, 4.0), (1.0, nan), (2.0, None), (nan, 7.0), (None, 8.0), (-0.0, 1.0), (0.0, 2.0)]
    t = Table.from_frame(spark.createDataFrame(data, "k double, v double"))
    keys, values = (np.array([nan if x is None else x for x in c]) for c in zip(*data, strict=True))
    for op in ("size", "count", "sum", "mean", "min", "max"):
        for dropna in (True, False):
            got = reduce_columns(t["k"], None if op == "size" else t["v"], op, dropna=dropna).orderBy("key").toPandas().astype(float)
            want = group_reduce(spark, keys, None if op == "size" else values, op, dropna=dropna).sort_values("key", na_position="first").astype(float)
            np.testing.assert_array_equal(got.to_numpy(), want.to_numpy(), err_msg=op)
    with pytest.raises(ValueError):
        reduce_columns(t["k"], t.where("v > 1")["v"], "sum")
    with pytest.raises(ValueError):
        reduce_columns(t["k"], t["v"], "median")


def test_argsort_frame(spark):
    nan = float("nan")
    rows = [(2, 3.0, "b"), (0, nan, "a"), (1, None, "c"), (3, 1.0, None), (5, 3.0, "a"), (4, -1.0, "b")]
    t = Table.from_frame(spark.createDataFrame(rows, "id long, v double, s string").repartition(3), ordered_by=[F.col("id")])
    for columns, ascending in (("v", True), ("v", False), (["s", "v"], [False, True]), (["s"], True), (["id", "id"], [False, True])):
        found = t.argsort_frame(columns, ascending).orderBy("place").collect()
        assert [r.place for r in found] == list(range(6))
        assert [r.position for r in found] == list(t.argsort(columns, ascending)), columns
    assert t.where("id > 9").argsort_frame("v").count() == 0


def test_chunk_frame(spark):
    rows = [((i * 7) % 11, None if i == 4 else float(i)) for i in range(11)]
    t = Table.from_frame(spark.createDataFrame(rows, "id long, v double").repartition(3), ordered_by=[F.col("id")])
    for size in (1, 4, 11, 20):
        found = {r.chunk: r["values"] for r in t["v"].chunk_frame(size).collect()}
        want = list(t["v"].iter_chunks(size))
        assert [found[i] for i in range(len(found))] == [list(x) for x in want]
    assert t.where("id > 20")["v"].chunk_frame(4).count() == 0
    with pytest.raises(ValueError):
        t["v"].chunk_frame(0)


ODD = """SELECT id, if(id = 3, NULL, concat('é', id)) AS `a.b`, timestamp_seconds(id * 1e9) AS t, date_add(date'1969-12-30', int(id)) AS d, cast(id AS decimal(20, 3)) AS m,
         array(id, NULL) AS l, named_struct('x', id, 'y', 'z') AS s, map('k', id) AS mp, if(id = 4, double('nan'), id / 3) AS f, cast('bytes' AS binary) AS b FROM range(11)"""


def test_packed_batches(spark):
    t = Table.from_frame(spark.sql(ODD).repartition(3), ordered_by=[F.col("id")])
    parts = tabular.pack_batches(t, rows=4)
    assert sorted((r.start, pa.ipc.open_stream(r.stream).read_all().num_rows) for r in parts.collect()) == [(0, 4), (4, 4), (8, 3)]
    back = tabular.unpack_batches(parts)
    assert back.schema.simpleString() == t.schema.simpleString()
    assert str(back.ordered_frame.collect()) == str(t.ordered_frame.collect())
    empty = tabular.unpack_batches(tabular.pack_batches(t.where("id > 20")))
    assert empty.columns == t.columns and len(empty) == 0
    with pytest.raises(ValueError):
        tabular.pack_batches(t, rows=0)


def test_written_streams(spark, tmp_path):
    t = Table.from_frame(spark.sql(ODD).repartition(3), ordered_by=[F.col("id").desc()])
    tabular.write_arrow(t, str(tmp_path / "streams"), rows=3)
    back = tabular.read_arrow(spark, str(tmp_path / "streams"))
    assert str(back.ordered_frame.collect()) == str(t.ordered_frame.collect())
    tabular.write_arrow(t.where("id > 20"), str(tmp_path / "none"))
    assert tabular.read_arrow(spark, str(tmp_path / "none")).columns == t.columns
