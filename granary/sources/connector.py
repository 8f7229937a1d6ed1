"""Chunked sources of arrays: subclass ChunkSource and read it with one Spark partition per chunk, or wrap an array in ArraySource."""

from __future__ import annotations

import itertools
import math
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.operators.ndarray import Array
from granary.scratch import materialize


class ChunkSource(ABC):
    """A remote or computed array that is read by chunks. It must pickle."""

    @property
    @abstractmethod
    def shape(self) -> tuple[int, ...]: ...

    @property
    @abstractmethod
    def chunks(self) -> tuple[int, ...]: ...

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.float64)

    @abstractmethod
    def get_chunk(self, index: tuple[int, ...]) -> np.ndarray:
        """The chunk at a place of the chunk grid; chunks at an edge may be smaller."""


class NumpySource(ChunkSource):
    """An array that the driver holds, as a source."""

    def __init__(self, values: np.ndarray, chunks: Sequence[int]):
        self.values, self._chunks = values, tuple(chunks)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.values.shape

    @property
    def chunks(self) -> tuple[int, ...]:
        return self._chunks

    @property
    def dtype(self) -> np.dtype:
        return self.values.dtype

    def get_chunk(self, index: tuple[int, ...]) -> np.ndarray:
        return self.values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, self._chunks, strict=True))]


#: Chunks that a filter lists; more are joined.
MOST_LISTED = 1000


class ArraySource(ChunkSource):
    """A distributed array as a source, of any size: its cells lie in a scratch table, sorted by chunk.

    Spark itself reads the chunks that are asked for, so this source is not
    pickled and no chunk passes through the driver unless ``get_chunk`` is called.
    """

    def __init__(self, x: Array, chunks: Sequence[int]):
        if x.kind not in ("int", "float"):
            raise TypeError(f"a source has numbers: {x.kind}")
        self._shape, self._chunks = x.shape, tuple(chunks)
        self._dtype = np.dtype(np.float64 if x.kind == "float" else np.int64)
        value = F.col("v").cast("double" if x.kind == "float" else "long")
        numbered = x.df.select(*x.axes, value.alias("v"), x.chunk_number(self._chunks).alias("__chunk"))
        self._stored = materialize(numbered.orderBy("__chunk"), "source")

    @property
    def shape(self) -> tuple[int, ...]:
        return self._shape

    @property
    def chunks(self) -> tuple[int, ...]:
        return self._chunks

    @property
    def dtype(self) -> np.dtype:
        return self._dtype

    def cells(self, wanted: Sequence[tuple[int, ...]]) -> DataFrame:
        """The cells of chunks at places of the chunk grid."""
        grid = [math.ceil(n / c) for n, c in zip(self._shape, self._chunks, strict=True)]
        numbers = sorted({int(np.ravel_multi_index(at, grid)) if grid else 0 for at in wanted})
        stored = self._stored
        if len(numbers) == math.prod(grid):
            return stored.drop("__chunk")
        if len(numbers) <= MOST_LISTED:
            return stored.filter(F.col("__chunk").isin(numbers)).drop("__chunk")
        chosen = stored.sparkSession.createDataFrame(pa.table({"__chunk": pa.array(numbers, pa.int64())}))
        return stored.join(chosen, "__chunk", "left_semi").drop("__chunk")

    def get_chunk(self, index: tuple[int, ...]) -> np.ndarray:
        starts = [i * c for i, c in zip(index, self._chunks, strict=True)]
        sizes = [min(c, n - a) for a, c, n in zip(starts, self._chunks, self._shape, strict=True)]
        axes = [(F.col(f"i{k}") - a).alias(f"i{k}") for k, a in enumerate(starts)]
        return Array(self.cells([index]).select(*axes, "v"), sizes).to_numpy()


class _Chunk(InputPartition):
    def __init__(self, index: tuple[int, ...]):
        self.index = index


class _Reader(DataSourceReader):
    def __init__(self, source: ChunkSource, wanted: Sequence[tuple[int, ...]]):
        self.source, self.wanted = source, list(wanted)

    def partitions(self) -> list[InputPartition]:
        return [_Chunk(i) for i in self.wanted]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        block = np.asarray(self.source.get_chunk(partition.index))
        places = np.indices(block.shape).reshape(block.ndim, -1)
        columns = {
            f"i{k}": pa.array(p + i * c, pa.int64())
            for k, (p, i, c) in enumerate(zip(places, partition.index, self.source.chunks, strict=True))
        }
        kind = pa.float64() if block.dtype.kind == "f" else pa.int64()
        yield pa.RecordBatch.from_pydict(columns | {"v": pa.array(block.reshape(-1), kind)})


def _touched(source: ChunkSource, key: Sequence[slice] | None) -> list[tuple[int, ...]]:
    """Places, in the grid, of the chunks that slices touch, or of all."""
    grid = [range(math.ceil(n / c)) for n, c in zip(source.shape, source.chunks, strict=True)]
    if key is not None:
        stretches = [k.indices(n) for k, n in zip(key, source.shape, strict=True)]
        grid = [range(a // c, math.ceil(b / c)) for (a, b, _), c in zip(stretches, source.chunks, strict=True)]
    return list(itertools.product(*grid))


def _read(spark: SparkSession, source: ChunkSource, wanted: Sequence[tuple[int, ...]]) -> Array:
    if isinstance(source, ArraySource):
        return Array(source.cells(wanted), source.shape)
    kind = "double" if source.dtype.kind == "f" else "long"
    name = f"granary_chunks_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join([*(f"i{k} long" for k in range(len(source.shape))), f"v {kind}"])

        def reader(self, schema: Any) -> DataSourceReader:
            return _Reader(source, wanted)

    spark.dataSource.register(Source)
    return Array(spark.read.format(name).load(), source.shape)


def read_source(spark: SparkSession, source: ChunkSource, key: Sequence[slice] | None = None) -> Array:
    """The array of a source; with slices only the chunks that they touch are fetched."""
    out = _read(spark, source, _touched(source, key))
    return out if key is None else out[tuple(key)]


class ByteRangeSource(ChunkSource):
    """A raw array in C order inside a file that pyarrow opens: a local path or a URI (file, s3, gs, hdfs).

    Executors read only the byte ranges of their chunks. ``filesystem`` takes
    a pyarrow file system, also one that wraps an fsspec one.
    """

    def __init__(self, uri: str, shape: Sequence[int], chunks: Sequence[int], dtype: Any = "<f8", offset: int = 0, filesystem: Any = None):
        self.uri, self._shape, self._chunks = uri, tuple(shape), tuple(chunks)
        self._dtype, self.offset, self.filesystem = np.dtype(dtype), offset, filesystem

    @property
    def shape(self) -> tuple[int, ...]:
        return self._shape

    @property
    def chunks(self) -> tuple[int, ...]:
        return self._chunks

    @property
    def dtype(self) -> np.dtype:
        return self._dtype

    def get_chunk(self, index: tuple[int, ...]) -> np.ndarray:
        from pyarrow import fs

        system, path = (self.filesystem, self.uri) if self.filesystem else fs.FileSystem.from_uri(self.uri)
        starts = [i * c for i, c in zip(index, self._chunks, strict=True)]
        sizes = [min(c, n - a) for a, c, n in zip(starts, self._chunks, self._shape, strict=True)]
        strides = [math.prod(self._shape[k + 1 :]) for k in range(len(self._shape))]
        # axes behind the last one that the chunk cuts lie side by side in the file
        cut = max((k for k, (m, n) in enumerate(zip(sizes, self._shape, strict=True)) if m != n), default=0)
        run = math.prod(sizes[cut:])
        out = np.empty(math.prod(sizes), dtype=self._dtype)
        with system.open_input_file(path) as file:
            for k, outer in enumerate(itertools.product(*map(range, sizes[:cut]))):
                place = sum((a + o) * s for a, o, s in zip(starts, [*outer, *[0] * (len(sizes) - cut)], strides, strict=True))
                raw = file.read_at(run * self._dtype.itemsize, self.offset + place * self._dtype.itemsize)
                out[k * run : (k + 1) * run] = np.frombuffer(raw, dtype=self._dtype)
        return out.reshape(sizes)


class Proxy:
    """A source with a cache: chunks that were fetched once are read from scratch tables."""

    def __init__(self, spark: SparkSession, source: ChunkSource):
        self.spark, self.source = spark, source
        self.held: set[tuple[int, ...]] = set()
        self._cells: DataFrame | None = None

    def fetch(self, key: Sequence[slice] | None = None) -> Array:
        """The array, or what slices choose of it; only chunks that are not in the cache are asked of the source."""
        missing = [c for c in _touched(self.source, key) if c not in self.held]
        if missing:
            fresh = materialize(_read(self.spark, self.source, missing).df, "proxy")
            self._cells = fresh if self._cells is None else self._cells.unionByName(fresh)
            self.held |= set(missing)
        if self._cells is None:
            self._cells = _read(self.spark, self.source, []).df
        out = Array(self._cells, self.source.shape)
        return out if key is None else out[tuple(key)]


def cached(x: Array) -> Array:
    """The array with its cells kept on the executors' disks after the first read."""
    from pyspark import StorageLevel

    return Array(x.df.persist(StorageLevel.DISK_ONLY), x.shape)
