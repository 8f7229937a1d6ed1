from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary import schema as S
from granary.expr import col
from granary.operators import ndarray as nd
from granary.operators.table import Table
from granary.plans import KernelError, dsl_kernel, jit, kernel_from_source, validate_compiled, validate_kernel
from granary.sources import codecs, connector, tabular
from granary.sources.store import Store, load_table, open_table, save_table
from granary.streaming import Follower, follow, windowed_counts


@dataclass
class Row:
    id: int = 0
    name: str = S.column(S.string(16, nullable=True), default=None)
    codes: list = S.column(S.ndarray((2, 2), S.int64(), nullable=True), default=None)


@pytest.fixture
def t(spark):
    return Table.from_rows(spark, Row, [(1, "a", [[1, 2], [3, 4]]), (2, None, None), (3, "c,d", [[5, 6], [7, 8]])])


def rows(table):
    return [tuple(r) for r in table]


def test_parquet(spark, t, tmp_path):
    save_table(t, str(tmp_path / "t"))
    for read in (open_table, load_table):
        back = read(spark, str(tmp_path / "t"))
        assert rows(back) == rows(t) and back.column_schema("codes").shape == (2, 2)
    assert rows(tabular.read_parquet(spark, str(tmp_path / "t"), columns=["name"], max_rows=2)) == [("a",), (None,)]


def test_nested_parquet(spark, tmp_path):
    data = [{"trip": {"sec": 1.5, "begin": {"lon": 2.0}}, "company": "x"}, {"trip": {"sec": None, "begin": None}, "company": None}]
    inner = pa.array([data], pa.list_(pa.struct([("trip", pa.struct([("sec", pa.float64()), ("begin", pa.struct([("lon", pa.float64())]))])), ("company", pa.string())])))
    pq.write_table(pa.table({"": inner}), tmp_path / "root.parquet")
    t = tabular.read_parquet(spark, str(tmp_path / "root.parquet"))
    assert t.columns == ["trip.sec", "trip.begin.lon", "company"] and rows(t) == [(1.5, 2.0, "x"), (None, None, None)]
    assert t["trip"].begin.lon.sum() == 2.0
    assert rows(t.where("trip.sec > 1")) == [(1.5, 2.0, "x")]
    tabular.write_parquet(t, str(tmp_path / "out"), nested=True)
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["trip", "company"]


def test_csv(spark, t, tmp_path):
    text = t.to_csv()
    assert text.splitlines()[0] == "id,name,codes" and '"[1,2,3,4]"' in text
    t.to_csv(str(tmp_path / "csv"))
    back = tabular.read_csv(spark, str(tmp_path / "csv"), Row)
    assert sorted(rows(back)) == sorted(rows(t))


def test_arrow_and_pandas(spark, t):
    arrow = t.to_arrow()
    assert rows(tabular.from_arrow(spark, arrow)) == rows(t)
    assert rows(tabular.from_bytes(spark, tabular.to_bytes(t))) == rows(t)
    assert pa.RecordBatchReader.from_stream(t).read_all().num_rows == 3
    batches = list(tabular.iter_arrow_batches(t.select(["id"]), rows=2))
    assert [b.num_rows for b in batches] == [2, 1]
    assert rows(tabular.from_arrow(spark, batches[0].schema, batches)) == [(1,), (2,), (3,)]
    pdf = t.select(["id", "name"]).to_pandas()
    assert rows(tabular.from_pandas(spark, pdf))[0] == (1, "a")
    assert tabular.same_rows(t.select(["id"]), tabular.from_arrow(spark, arrow).select(["id"]))


def test_store(spark, t, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "w")
    x = np.arange(6.0).reshape(2, 3)
    own = t.select(["id"]).copy()
    own.add_computed_column("twice", "id * 2")
    s["a/t"] = own
    s["a/b/x"] = nd.array(spark, x)
    s["e"] = col("id") * 2
    s.set_meta(author="me")
    again = Store(spark, str(tmp_path / "s"), "r")
    assert again.keys() == ["a/b/x", "a/t", "e"] and again.meta == {"author": "me"}
    assert [r.twice for r in again["a/t"]] == [2, 4, 6]
    assert (again["a/b/x"].to_numpy() == x).all()
    assert [r.y for r in own.assign(y=again["e"])] == [2, 4, 6]
    assert again.get_children("a") == ["a/b", "a/t"] and again.get_descendants("/") == ["a", "a/b", "a/b/x", "a/t", "e"]
    assert list(again.walk("/")) == [("/", ["a"], ["e"]), ("a", ["b"], ["t"]), ("a/b", [], ["x"])]
    assert again["a"].keys() == ["b/x", "t"] and "a/t" in again and again.get("zz") is None
    with pytest.raises(ValueError):
        again["n"] = t
    with pytest.raises(ValueError):
        s["a"] = t
    del s["a/b"]
    assert s.keys() == ["a/t", "e"]


def test_chunk_source(spark):
    x = np.arange(35.0).reshape(5, 7)
    source = connector.NumpySource(x, (2, 3))
    assert (connector.read_source(spark, source).to_numpy() == x).all()
    assert (connector.read_source(spark, source, (slice(1, 4), slice(2, 6))).to_numpy() == x[1:4, 2:6]).all()
    assert connector.cached(connector.read_source(spark, source)).sum().item() == x.sum()


def test_kernels(spark):
    @dsl_kernel
    def steps(a, b):
        total = 0.0
        for i in range(3):
            total += a * i
        if total > b:
            return int(total - b)
        elif a < 0:
            total = -a
        return min(total, 100.0)

    @dsl_kernel
    def halve(a):
        n = 0
        while a > 1:
            a = a / 2
            n += 1
        return n

    data = [(3.0, 1.0), (-2.0, 5.0), (1.0, 50.0)]
    t = Table.from_frame(spark.createDataFrame(data, "a double, b double").coalesce(1))
    made = t.assign(k=steps(col("a"), col("b")), h=halve(col("a") * 8), j=jit(lambda a: np.sin(a) + np.maximum(a, 0))(col("a")))
    assert [r.k for r in made] == [8.0, 2.0, 3.0]
    assert [r.h for r in made] == [5.0, 0.0, 3.0]
    assert [r.j for r in made] == pytest.approx([np.sin(a) + max(a, 0) for a, _ in data])
    assert validate_kernel("def f(a):\n    return a + 1")["valid"]
    for bad in ("def f(a):\n    import os\n    return a", "def f(a):\n    return a.b", "def f(a):\n    return open(a)", "x = 1"):
        assert not validate_kernel(bad)["valid"]
        with pytest.raises(KernelError):
            kernel_from_source(bad)


def test_growth(spark, tmp_path):
    path, sink = str(tmp_path / "g"), str(tmp_path / "sink")
    spark.range(3).write.parquet(path)
    reader = Follower(spark, path)
    assert len(reader.table) == 3
    schema = spark.range(1).schema
    assert follow(spark, path, schema, sink, str(tmp_path / "c")) == 3
    spark.range(3, 5).write.mode("append").parquet(path)
    assert len(reader.refresh()) == 5
    assert follow(spark, path, schema, sink, str(tmp_path / "c")) == 5
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "t string, event_type string, value double")
    got = windowed_counts(events.withColumn("ts", F.to_timestamp("t"))).collect()
    assert len(got) == 1 and got[0].events == 2 and got[0].total == 3.0


def test_byte_ranges(spark, tmp_path):
    x = np.arange(4 * 6 * 5, dtype="<f8").reshape(4, 6, 5)
    path = tmp_path / "raw"
    path.write_bytes(b"head" + x.tobytes())
    for chunks in ((2, 4, 5), (3, 2, 2), (1, 6, 5), (4, 6, 5)):
        source = connector.ByteRangeSource(path.as_uri(), x.shape, chunks, "<f8", offset=4)
        assert (connector.read_source(spark, source).to_numpy() == x).all(), chunks
    part = connector.read_source(spark, source, (slice(1, 3), slice(0, 2), slice(4, 5)))
    assert (part.to_numpy() == x[1:3, :2, 4:5]).all()


def test_proxy_fetches_once(spark):
    x = np.arange(35.0).reshape(5, 7)
    proxy = connector.Proxy(spark, connector.NumpySource(x, (2, 3)))
    assert (proxy.fetch((slice(0, 2), slice(0, 3))).to_numpy() == x[:2, :3]).all() and proxy.held == {(0, 0)}
    assert (proxy.fetch((slice(1, 4), slice(2, 6))).to_numpy() == x[1:4, 2:6]).all() and proxy.held == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert (proxy.fetch().to_numpy() == x).all() and len(proxy.held) == 9


def test_codecs():
    raw = bytes(range(256)) * 20
    codecs.register_codec("backwards", lambda b: b[::-1], lambda b: b[::-1])
    codecs.register_filter("flip", lambda b: bytes(255 - x for x in b), lambda b: bytes(255 - x for x in b))
    for name in ("zstd", "lz4", "gzip", "backwards"):
        packed = codecs.compress(raw, name, ["flip"])
        assert codecs.decompress(packed) == raw and (name == "backwards" or len(packed) < len(raw))
    for bad in ("backwards", "a,b", ""):
        with pytest.raises(ValueError):
            codecs.register_codec(bad, bytes, bytes)


def test_arrow_streams_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tabular, "STREAM_ROWS", 10)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(k, k + 7))}) for k in range(0, 70, 7)]
    back = tabular.from_arrow(spark, batches[0].schema, iter(batches))
    assert [r.x for r in back] == list(range(70))
    assert tabular.from_arrow(spark, batches[0].schema, iter([])).columns == ["x"]


def test_packed_store(spark, t, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "w")
    s["a/t"] = t.select(["id"]).copy()
    packed = s.pack(str(tmp_path / "s.zip"))
    with pytest.raises(FileExistsError):
        s.pack(packed)
    for other in (Store.unpack(spark, packed, str(tmp_path / "u")), s.copy_to(str(tmp_path / "c"))):
        assert rows(other["a/t"]) == [(1,), (2,), (3,)]
    with pytest.raises(FileExistsError):
        s.copy_to(str(tmp_path / "c"))


def test_masked_kernels(spark):
    source = """
def f(a, b):
    total = 0
    for i in range(6):
        if i == 1:
            continue
        if total > b:
            break
        total += a * i
    else:
        total = -total
    n = 0
    while n < 50 and total > 10:
        n += 1
        total = total - 10 if total > 20 else total / 2
        if n == 7:
            return -1
    return min(total, 99.5) + n // 2
"""
    space = {}
    exec(source, space)  # noqa: S102
    data = [(a / 3, float(b)) for a in range(-4, 40, 3) for b in (0, 5, 40)]
    t = Table.from_frame(spark.createDataFrame(data, "a double, b double").coalesce(1))
    assert [r.k for r in t.assign(k=kernel_from_source(source)(col("a"), col("b")))] == pytest.approx([space["f"](a, b) for a, b in data])
    assert not validate_compiled(source)["valid"] and validate_compiled("def g(a):\n    return a + 1", a="bigint")["valid"]
    assert not validate_compiled("def g(a):\n    return a + 1", a="array<int>")["valid"]
