"""N-dimensional arrays as long DataFrames of (axis indices, value).

Cells are rows ``i0, i1, ..., v``. Elementwise work is a projection, a
reduction is a grouped aggregate, a gather is a join. Operands of different
lineage meet in a join on their axes; an axis of length one is dropped from
the join, which is broadcasting without copies.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.expr import INF, NAN, Bound, Expr, compile_text, kind_of
from granary.functions import REGISTRY
from granary.operators import packed as packing
from granary.operators.table import dense_positions
from granary.scratch import materialize

_INT_MIN, _INT_MAX = -(1 << 63), (1 << 63) - 1
#: Cells in one stream of a packed array.
PACKED_CELLS = 65_536


def axis(i: int) -> str:
    return f"i{i}"


def _normal(at: int, ndim: int) -> int:
    if not -ndim <= at < ndim:
        raise ValueError(f"axis {at} is out of bounds for {ndim} dimensions")
    return at % ndim


class Array:
    """A distributed array: its shape, and a DataFrame with a row per cell."""

    __array_ufunc__ = None

    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.df, self.shape = df, tuple(int(n) for n in shape)

    # Facts

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [axis(i) for i in range(self.ndim)]

    @property
    def dtype(self) -> T.DataType:
        return self.df.schema["v"].dataType

    @property
    def kind(self) -> str:
        return kind_of(self.dtype)

    @property
    def T(self) -> Array:
        return permute_dims(self)

    def __len__(self) -> int:
        if not self.ndim:
            raise TypeError("an array without axes has no length")
        return self.shape[0]

    def flat_index(self) -> Column:
        """The C-order position of a cell."""
        at = F.lit(0).cast("long")
        for n, name in zip(self.shape, self.axes, strict=True):
            at = at * n + F.col(name)
        return at

    def to_numpy(self) -> np.ndarray:
        """The cells as a NumPy array on the driver."""
        value = F.col("v")
        pdf = self.df.select(self.flat_index().alias("at"), value).toPandas()
        if self.kind == "complex":
            flat = np.zeros(self.size, dtype=np.complex128)
            flat[pdf["at"].to_numpy()] = [complex(x["re"], x["im"]) for x in pdf["v"]]
        else:
            kinds = {"bool": bool, "int": np.int64, "float": np.float64}
            flat = np.empty(self.size, dtype=kinds.get(self.kind, object))
            flat[pdf["at"].to_numpy()] = pdf["v"].to_numpy()
        return flat.reshape(self.shape)

    def item(self) -> Any:
        if self.size != 1:
            raise ValueError("only an array of one cell is a scalar")
        return self.to_numpy().reshape(-1)[0].item()

    # Elementwise

    def _bound(self) -> Bound:
        return Bound(F.col("v"), self.kind)

    def map(self, function: Any, *others: Any) -> Array:
        """A function of the registry (or of Exprs) over cells; others are arrays, NumPy arrays or scalars."""
        return elementwise(function, self, *others)

    def astype(self, dtype: str) -> Array:
        return Array(self.df.withColumn("v", F.col("v").cast(dtype)), self.shape)

    def where(self, x: Any = None, y: Any = None) -> Array:
        return elementwise(REGISTRY["where"], self, x, y)

    # Indexing

    def __getitem__(self, key: Any) -> Array:
        if isinstance(key, Array):
            return self._boolean(key)
        if isinstance(key, np.ndarray) and key.dtype == bool:
            return self._boolean(array(self.df.sparkSession, key))
        key = key if isinstance(key, tuple) else (key,)
        if any(isinstance(k, list | np.ndarray) for k in key):
            if len(key) != 1:
                raise IndexError("index several axes by arrays with oindex")
            return take(self, np.asarray(key[0]), axis=0)
        if Ellipsis in [k for k in key if not isinstance(k, np.ndarray)]:
            at = key.index(Ellipsis)
            used = sum(k is not None for k in key) - 1
            key = key[:at] + (slice(None),) * (self.ndim - used) + key[at + 1 :]
        df, keep, shape, names = self.df, [], [], iter(zip(self.axes, self.shape, strict=True))
        for k in key:
            if k is None:
                keep.append(F.lit(0).cast("long"))
                shape.append(1)
                continue
            try:
                name, n = next(names)
            except StopIteration:
                raise IndexError("too many indices") from None
            if isinstance(k, slice):
                start, stop, step = k.indices(n)
                length = len(range(start, stop, step))
                place = F.col(name)
                if (start, stop, step) != (0, n, 1):
                    low, high = (start, stop) if step > 0 else (stop + 1, start + 1)
                    df = df.filter((place >= low) & (place < high) & ((place - start) % abs(step) == 0))
                    place = F.floor((place - start) / step).cast("long")
                keep.append(place)
                shape.append(length)
            else:
                if not -n <= k < n:
                    raise IndexError(f"index {k} is out of bounds for an axis of {n}")
                df = df.filter(F.col(name) == int(k) % n)
        for name, n in names:
            keep.append(F.col(name))
            shape.append(n)
        return Array(df.select(*[c.alias(axis(i)) for i, c in enumerate(keep)], "v"), shape)

    def _boolean(self, mask: Array) -> Array:
        """Cells where the mask holds, in C order, as a vector."""
        if mask.shape != self.shape or mask.kind != "bool":
            raise IndexError("a boolean index has the shape of the array")
        chosen = mask.df.filter("v").drop("v")
        df = self.df.join(chosen, self.axes, "left_semi") if self.ndim else self.df
        return _vector(df.select(self.flat_index().alias("o"), "v"))

    def oindex(self, *keys: Any) -> Array:
        """Orthogonal indexing: one index (array, slice or number) per axis."""
        out, gone = self, 0
        for i, k in enumerate(keys):
            at = i - gone
            if isinstance(k, list | np.ndarray):
                out = take(out, np.asarray(k), axis=at)
            else:
                out = out[(slice(None),) * at + (k,)]
                gone += isinstance(k, int)
        return out

    def slice(self, key: Any) -> Array:
        return self[key]

    def with_values(self, key: Any, value: Any) -> Array:
        """A new array with the cells at key set."""
        marks = full(self.df.sparkSession, self.shape, 0).astype("long")
        marks = Array(marks.df.withColumn("v", marks.flat_index()), self.shape)[key]
        size = marks.size
        if isinstance(value, Array | np.ndarray | list):
            new = value if isinstance(value, Array) else array(self.df.sparkSession, np.asarray(value))
            new = broadcast_to(new, marks.shape)
            cells = marks.df.withColumnRenamed("v", "__at").join(new.df, marks.axes) if marks.ndim else marks.df.withColumnRenamed("v", "__at").crossJoin(new.df)
        else:
            cells = marks.df.withColumnRenamed("v", "__at").withColumn("v", F.lit(value))
        cells = cells.select("__at", F.col("v").cast(self.dtype).alias("__new"), F.lit(True).alias("__set"))
        old = self.df.withColumn("__at", self.flat_index())
        joined = old.join(cells, "__at", "left") if size else old.withColumn("__set", F.lit(False)).withColumn("__new", F.col("v"))
        value = F.when(F.col("__set"), F.col("__new")).otherwise(F.col("v"))
        return Array(joined.select(*self.axes, value.alias("v")), self.shape)

    def resize(self, shape: Sequence[int]) -> Array:
        """Cells within the new shape; new cells are zero."""
        if len(shape) != self.ndim:
            raise ValueError("resizing keeps the number of axes")
        df = self.df
        for name, n in zip(self.axes, shape, strict=True):
            df = df.filter(F.col(name) < n)
        if any(n > old for n, old in zip(shape, self.shape, strict=True)):
            frame = full(self.df.sparkSession, shape, 0).df.drop("v")
            df = frame.join(df, self.axes, "left").withColumn("v", F.coalesce("v", F.lit(0).cast(self.dtype)))
        return Array(df, shape)

    def copy(self, dtype: str | None = None) -> Array:
        """The cells written once, so that the copy no longer depends on how they were made."""
        kept = Array(materialize(self.df, "array"), self.shape)
        return kept.astype(dtype) if dtype else kept

    def chunks_touched(self, key: Any, chunks: Sequence[int]) -> list[int]:
        """Numbers, in C order of a grid of chunks, of those that a key (slices and numbers, an axis each) touches."""
        key = key if isinstance(key, tuple) else (key,)
        key = [*key, *[slice(None)] * (self.ndim - len(key))]
        grid = [math.ceil(n / c) for n, c in zip(self.shape, chunks, strict=True)]
        places = [range(n)[k] if isinstance(k, slice) else [range(n)[k]] for k, n in zip(key, self.shape, strict=True)]
        touched = [_chunks_of(at, c) for at, c in zip(places, chunks, strict=True)]
        return [int(np.ravel_multi_index(at, grid)) for at in itertools.product(*touched)]

    def chunks_info(self, chunks: Sequence[int]) -> DataFrame:
        """A row per chunk of a grid: its number, cells, and least and greatest value."""
        number = self.chunk_number(chunks)
        return self.df.groupBy(number.alias("chunk")).agg(F.count(F.lit(1)).alias("cells"), F.min("v").alias("low"), F.max("v").alias("high"))

    def chunk_number(self, chunks: Sequence[int]) -> Column:
        """The number, in C order of a grid of chunks, of the chunk that a cell lies in."""
        number = F.lit(0).cast("long")
        for name, n, c in zip(self.axes, self.shape, chunks, strict=True):
            number = number * math.ceil(n / c) + F.floor(F.col(name) / c)
        return number

    def create_index(self, kind: str = "FULL"):
        """An index of the cells by value; its ``between`` gives a table of places and values."""
        from granary.operators import indexes
        from granary.operators.table import Table

        cells = Table.from_frame(self.df, ordered_by=[F.col(a) for a in self.axes])
        return indexes.create(cells, "v", kind=kind)

    def append(self, values: Any) -> Array:
        other = values if isinstance(values, Array) else array(self.df.sparkSession, np.asarray(values))
        return concat([self, other], axis=0)

    def write(self, path: str, mode: str = "error", prefilter: Any = None) -> None:
        """Parquet, sorted by place, with the shape beside the type in the schema's metadata.

        A prefilter is a function of Exprs that the values go through first.
        """
        if prefilter is not None:
            return elementwise(prefilter, self).write(path, mode)
        named = self.df.select(*[F.col(a).alias(a, metadata={"length": n}) for a, n in zip(self.axes, self.shape, strict=True)], "v")
        ordered = named.sortWithinPartitions(*self.axes) if self.ndim else named
        ordered.write.mode(mode).parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, postfilter: Any = None) -> Array:
        """A written array; a postfilter is a function of Exprs that the values go through when they are read."""
        df = spark.read.parquet(path)
        shape = [f.metadata["length"] for f in df.schema.fields if f.name != "v"]
        out = Array(df, shape)
        return out if postfilter is None else elementwise(postfilter, out)

    def to_bytes(self) -> bytes:
        """Arrow IPC bytes of the flat values, with the shape in the schema's metadata; ``pack`` has no bound on their number."""
        flat = self.to_numpy().reshape(-1)
        batch = pa.table({"v": flat}).replace_schema_metadata({"shape": ",".join(map(str, self.shape))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_table(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def from_bytes(spark: SparkSession, raw: bytes) -> Array:
        found = pa.ipc.open_stream(raw).read_all()
        text = found.schema.metadata[b"shape"].decode()
        shape = [int(n) for n in text.split(",")] if text else []
        return array(spark, found["v"].to_numpy().reshape(shape))

    def pack(self, cells: int = PACKED_CELLS) -> DataFrame:
        """Arrow IPC bytes of the flat values, a row per stretch of them, made by the executors; the shape is in the metadata."""
        out = packing.pack(self.df.select(self.flat_index().alias("__at"), "v"), "__at", cells)
        return out.withMetadata("stream", out.schema["stream"].metadata | {"shape": ",".join(map(str, self.shape))})

    @staticmethod
    def unpack(packed: DataFrame) -> Array:
        """The array of what ``pack`` made."""
        text = packed.schema["stream"].metadata["shape"]
        return _shaped(packing.unpack(packed, "id"), [int(n) for n in text.split(",")] if text else [])

    # Reductions as methods

    def __getattr__(self, name: str):
        if name in REDUCTIONS:
            return lambda *a, **k: reduce(self, name, *a, **k)
        if name in ("argsort", "sort", "cumulative_sum", "cumulative_prod"):
            return lambda *a, **k: globals()[name](self, *a, **k)
        if name in REGISTRY and not name.startswith("_"):
            return lambda *others: elementwise(REGISTRY[name], self, *others)
        raise AttributeError(name)


def _chunks_of(places: Sequence[int], length: int) -> list[int]:
    """Numbers of the chunks of an axis that have one of the places."""
    if isinstance(places, range) and places and abs(places.step) <= length:
        low, high = sorted((places[0], places[-1]))
        return list(range(low // length, high // length + 1))
    return sorted({p // length for p in places})


def _vector(df: DataFrame) -> Array:
    """A vector of the values of df (o, v) in the order of o."""
    placed = dense_positions(df, [F.col("o")], "i0").select("i0", "v")
    return Array(placed, [placed.count()])


# Construction


def full(spark: SparkSession, shape: int | Sequence[int], value: Any) -> Array:
    """An array of one value."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    return _from_flat(spark, shape, lambda at: F.lit(value))


def _from_flat(spark: SparkSession, shape: Sequence[int], value: Any) -> Array:
    at = F.col("id")
    names, rest = [], math.prod(shape)
    for i, n in enumerate(shape):
        rest //= max(1, n)
        names.append((F.floor(at / rest) % n).cast("long").alias(axis(i)))
    return Array(spark.range(math.prod(shape)).select(*names, value(at).alias("v")), shape)


def zeros(spark: SparkSession, shape: Any, dtype: str = "double") -> Array:
    return full(spark, shape, 0).astype(dtype)


empty = uninit = zeros


def ones(spark: SparkSession, shape: Any, dtype: str = "double") -> Array:
    return full(spark, shape, 1).astype(dtype)


def nans(spark: SparkSession, shape: Any) -> Array:
    return full(spark, shape, NAN)


def full_like(x: Array, value: Any, dtype: str | None = None) -> Array:
    out = full(x.df.sparkSession, x.shape, value)
    return out.astype(dtype or x.dtype.simpleString())


def zeros_like(x: Array, dtype: str | None = None) -> Array:
    return full_like(x, 0, dtype)


empty_like = zeros_like


def ones_like(x: Array, dtype: str | None = None) -> Array:
    return full_like(x, 1, dtype)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1, shape: Sequence[int] | None = None) -> Array:
    if stop is None:
        start, stop = 0, start
    n = max(0, math.ceil((stop - start) / step))
    shape = (n,) if shape is None else tuple(shape)
    if math.prod(shape) != n:
        raise ValueError(f"{n} values do not fill {shape}")
    return _from_flat(spark, shape, lambda at: F.lit(start) + at * F.lit(step))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True, shape: Sequence[int] | None = None) -> Array:
    parts = (num - 1 if endpoint else num) or 1
    shape = (num,) if shape is None else tuple(shape)
    step = (stop - start) / parts

    def value(at: Column) -> Column:
        spaced = F.lit(float(start)) + at * F.lit(float(step))
        return F.when(at == num - 1, F.lit(float(stop))).otherwise(spaced) if endpoint and num > 1 else spaced

    return _from_flat(spark, shape, value)


def filled(function: Any, *inputs: Any, dtype: str | None = None) -> Array:
    """An array filled by a function of Exprs over input arrays and scalars."""
    out = elementwise(function, *inputs)
    return out.astype(dtype) if dtype else out


def utf8_array(spark: SparkSession, values: Sequence[str | None]) -> Array:
    """A vector of texts of any length."""
    rows = [(i, None if v is None else str(v)) for i, v in enumerate(values)]
    return Array(spark.createDataFrame(rows, "i0 long, v string"), (len(rows),))


def to_utf8(x: Array) -> Array:
    """Fixed-width texts or bytes as texts of any length, without the NUL characters that pad them."""
    return Array(x.df.withColumn("v", F.rtrim(F.col("v").cast("string"), F.lit("\0"))), x.shape)


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> Array:
    out = full(spark, (n, m or n), 0)
    return Array(out.df.withColumn("v", F.when(F.col("i0") + k == F.col("i1"), 1.0).otherwise(0.0)), out.shape)


def array(spark: SparkSession, values: Any) -> Array:
    """An array of values that the driver holds."""
    if isinstance(values, Array):
        return values
    values = np.asarray(values)
    flat = values.reshape(-1)
    if values.dtype.kind == "c":
        rows = [(i, (float(x.real), float(x.imag))) for i, x in enumerate(flat)]
        df = spark.createDataFrame(rows, "id long, v struct<re:double,im:double>")
    else:
        kinds = {"b": "boolean", "i": "long", "u": "long", "f": "double", "U": "string", "O": "string"}
        kind = kinds[values.dtype.kind]
        plain = flat.astype({"long": np.int64, "double": np.float64}.get(kind, flat.dtype))
        df = spark.createDataFrame(pa.table({"id": np.arange(len(flat)), "v": pa.array(plain.tolist() if kind == "string" else plain)}))
        df = df.withColumn("v", F.col("v").cast(kind))
    return _shaped(df, values.shape)


def _shaped(df: DataFrame, shape: Sequence[int]) -> Array:
    """An array of cells (id, v) that are numbered in C order."""
    rest, names = math.prod(shape), []
    for i, n in enumerate(shape):
        rest //= max(1, n)
        names.append((F.floor(F.col("id") / max(1, rest)) % n).cast("long").alias(axis(i)))
    return Array(df.select(*names, "v"), shape)


asarray = array


def fromiter(spark: SparkSession, iterable: Any, shape: Sequence[int], dtype: Any = float) -> Array:
    return array(spark, np.fromiter(iterable, dtype=dtype, count=math.prod(shape)).reshape(shape))


def frombuffer(spark: SparkSession, buffer: bytes, shape: Sequence[int], dtype: Any = np.uint8) -> Array:
    return array(spark, np.frombuffer(buffer, dtype=dtype).reshape(shape))


# Elementwise


def broadcast_shape(*shapes: Sequence[int]) -> tuple[int, ...]:
    return np.broadcast_shapes(*shapes)


def broadcast_to(x: Array, shape: Sequence[int]) -> Array:
    """x with the shape; stretched axes get their indices from a range, exploded within each cell."""
    shape = tuple(shape)
    if broadcast_shape(x.shape, shape) != shape:
        raise ValueError(f"{x.shape} does not broadcast to {shape}")
    extra, df, names = len(shape) - x.ndim, x.df, []
    df = df.select(*[F.col(axis(i)).alias(f"__{i + extra}") for i in range(x.ndim)], "v")
    for i, n in enumerate(shape):
        if i < extra or (x.shape[i - extra] == 1 and n != 1):
            df = df.drop(f"__{i}").withColumn(f"__{i}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else df.limit(0).withColumn(f"__{i}", F.lit(0))
        names.append(F.col(f"__{i}").cast("long").alias(axis(i)))
    return Array(df.select(*names, "v"), shape)


def elementwise(function: Any, *operands: Any) -> Array:
    """Apply a function of Exprs to arrays cell by cell, with broadcasting."""
    first = next(o for o in operands if isinstance(o, Array))
    spark = first.df.sparkSession
    operands = [array(spark, o) if isinstance(o, np.ndarray) else o for o in operands]
    arrays = [o for o in operands if isinstance(o, Array)]
    shape = broadcast_shape(*[a.shape for a in arrays])
    frames: list[tuple[Array, str]] = []
    joined, names, covered = None, {}, set()
    ordered = sorted(range(len(arrays)), key=lambda i: -arrays[i].size)
    for i in ordered:
        a = arrays[i]
        same = next((n for other, n in frames if other.df is a.df), None)
        if same:
            names[i] = same
            continue
        name = f"v{i}"
        shift = len(shape) - a.ndim
        kept = {k: axis(k + shift) for k, n in enumerate(a.shape) if n != 1 or shape[k + shift] == 1}
        df = a.df.select(*[F.col(axis(k)).alias(to) for k, to in kept.items()], F.col("v").alias(name))
        on = [to for to in kept.values() if to in covered]
        if joined is None:
            joined = df
        elif on:
            joined = joined.join(df, on)
        else:
            joined = joined.crossJoin(F.broadcast(df)) if a.size == 1 else joined.crossJoin(df)
        covered |= set(kept.values())
        frames.append((a, name))
        names[i] = name
    bounds, i = [], 0
    for o in operands:
        if isinstance(o, Array):
            bounds.append(Expr(lambda schema, n=names[i], a=o: Bound(F.col(n), a.kind), names[i]))
            i += 1
        else:
            bounds.append(o)
    result = function(*bounds).bind(joined.schema).col
    missing = [F.lit(0).cast("long").alias(axis(k)) for k in range(len(shape)) if axis(k) not in joined.columns]
    present = [F.col(axis(k)) for k in range(len(shape)) if axis(k) in joined.columns]
    return Array(joined.select(*present, *missing, result.alias("v")).select(*[axis(k) for k in range(len(shape))], "v"), shape)


for _name in "add sub mul truediv floordiv mod pow eq ne lt le gt ge and or xor".split():
    setattr(Array, f"__{_name}__", lambda self, o, n=_name: elementwise(getattr(Expr, f"__{n}__"), self, o))
for _name in "add sub mul truediv floordiv mod pow and or xor".split():
    setattr(Array, f"__r{_name}__", lambda self, o, n=_name: elementwise(getattr(Expr, f"__r{n}__"), self, o))
for _name in ("neg", "invert", "pos"):
    setattr(Array, f"__{_name}__", lambda self, n=_name: elementwise(getattr(Expr, f"__{n}__"), self))
Array.__abs__ = lambda self: elementwise(REGISTRY["abs"], self)
Array.__hash__ = object.__hash__


def evaluate(text: str, operands: dict[str, Any]) -> Array:
    """Compile an expression string over named arrays and scalars."""
    names = [n for n, o in operands.items() if isinstance(o, Array | np.ndarray)]
    fixed = {n: o for n, o in operands.items() if n not in names}

    def build(*exprs: Expr) -> Expr:
        return compile_text(text, {**fixed, **dict(zip(names, exprs, strict=True))})

    return elementwise(build, *[operands[n] for n in names])


# Reductions

REDUCTIONS = ("sum", "prod", "mean", "std", "var", "min", "max", "any", "all", "count_nonzero", "argmin", "argmax")


def reduce(x: Array, op: str, axis: Any = None, keepdims: bool = False, where: Any = None, ddof: int = 0, dtype: str | None = None) -> Array:
    """Reduce over one axis, several, or all; ``where`` keeps the cells of a boolean array.

    min and max of no cells give the identity of their type, sums 0, products
    1, means NaN. A NaN among the cells is their min and max. argmin and
    argmax give the first place on ties, in C order without an axis.
    """
    axes = range(x.ndim) if axis is None else [axis] if isinstance(axis, int) else axis
    gone = sorted({_normal(a, x.ndim) for a in axes})
    kept = [i for i in range(x.ndim) if i not in gone]
    df, value = x.df, F.col("v")
    chosen = None
    if where is not None:
        mask = where if isinstance(where, Array) else array(df.sparkSession, np.asarray(where))
        mask = broadcast_to(mask, x.shape)
        df = df.join(mask.df.withColumnRenamed("v", "__w"), x.axes)
        chosen = F.col("__w")
    value = value if chosen is None else F.when(chosen, value)
    if op in ("argmin", "argmax"):
        if axis is not None and len(gone) > 1:
            raise ValueError("argmin and argmax take one axis")
        place = x.flat_index() if axis is None else F.col(x.axes[gone[0]])
        first = place if op == "argmin" else -place
        # NaN is above all in Spark's order and decides both extremes in NumPy
        number = F.isnan(value).cast("int") if x.kind == "float" else F.lit(0)
        signed = F.struct((-number if op == "argmin" else number).alias("n"), value.alias("v"), first.alias("p"))
        best = (F.min if op == "argmin" else F.max)(F.when(value.isNotNull(), signed))["p"]
        stat = best if op == "argmin" else -best
    else:
        stat = _statistic(op, x.kind, value, ddof)
    if dtype:
        stat = stat.cast(dtype)
    out = df.groupBy(*[x.axes[i] for i in kept]).agg(stat.alias("v")) if kept else df.agg(stat.alias("v"))
    shape, names = [], []
    for i in range(x.ndim):
        if i in kept:
            shape.append(x.shape[i])
            names.append(F.col(x.axes[i]))
        elif keepdims:
            shape.append(1)
            names.append(F.lit(0).cast("long"))
    return Array(out.select(*[c.alias(f"i{k}") for k, c in enumerate(names)], "v"), shape)


def _statistic(op: str, kind: str, value: Column, ddof: int) -> Column:
    if kind == "complex":
        if op not in ("sum", "mean"):
            raise TypeError(f"{op} is not defined for complex values")
        f = F.sum if op == "sum" else F.avg
        return F.struct(f(value["re"]).alias("re"), f(value["im"]).alias("im"))
    if op == "any":
        return F.coalesce(F.bool_or(value.cast("boolean")), F.lit(False))
    if op == "all":
        return F.coalesce(F.bool_and(value.cast("boolean")), F.lit(True))
    if op == "count_nonzero":
        return F.count_if(value if kind == "bool" else value != 0)
    number = value.cast("long") if kind == "bool" else value
    if op == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0 if kind == "float" else 0))
    if op == "prod":
        product = F.coalesce(F.product(number.cast("double")), F.lit(1.0))
        return product if kind == "float" else product.cast("long")
    if op == "mean":
        return F.coalesce(F.avg(number.cast("double")), F.lit(NAN))
    if op in ("var", "std"):
        real = number.cast("double")
        n = F.count(real)
        var = F.coalesce(F.var_pop(real) * n / F.when(n > ddof, n - ddof), F.lit(NAN))
        return var if op == "var" else F.sqrt(var)
    identity = {"float": (INF, -INF), "int": (_INT_MAX, _INT_MIN), "bool": (True, False)}[kind]
    if op == "min":
        least = F.coalesce(F.min(value), F.lit(identity[0]))
        return F.when(F.bool_or(F.isnan(value)), F.lit(NAN)).otherwise(least) if kind == "float" else least
    return F.coalesce(F.max(value), F.lit(identity[1]))


#: Places of an axis that one window group covers at most.
BLOCK = 65_536


def _cumulative(x: Array, along: int | None, stat: Any, combine: Any, include_initial: bool, start: Any) -> Array:
    """Running totals. A long axis is cut into blocks, whose totals are carried over, so no task sees it whole."""
    if along is None:
        if x.ndim > 1:
            x = reshape(x, (x.size,))
        along = 0
    along = _normal(along, x.ndim)
    place = F.col(x.axes[along])
    others = [a for i, a in enumerate(x.axes) if i != along]
    upto = lambda names: Window.partitionBy(*names).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    if x.shape[along] <= BLOCK:
        out = x.df.withColumn("v", stat(F.col("v")).over(upto(others)))
    else:
        keys = [*others, "__block"]
        blocked = x.df.withColumn("__block", F.floor(place / BLOCK))
        earlier = Window.partitionBy(*others).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        totals = blocked.groupBy(*keys).agg(stat(F.col("v")).alias("__total"))
        totals = totals.select(*keys, stat(F.col("__total")).over(earlier).alias("__base"))
        inside = blocked.withColumn("v", stat(F.col("v")).over(upto(keys))).join(totals, keys)
        value = F.when(F.col("__base").isNull(), F.col("v")).otherwise(combine(F.col("__base"), F.col("v")))
        out = inside.select(*x.axes, value.alias("v"))
    shape = list(x.shape)
    if include_initial:
        out = out.withColumn(x.axes[along], place + 1)
        first = x.df.filter(place == 0).withColumn("v", F.lit(start).cast(out.schema["v"].dataType))
        out = out.unionByName(first)
        shape[along] += 1
    return Array(out, shape)


def cumulative_sum(x: Array, axis: int | None = None, include_initial: bool = False) -> Array:
    return _cumulative(x, axis, F.sum, lambda base, v: base + v, include_initial, 0)


def cumulative_prod(x: Array, axis: int | None = None, include_initial: bool = False) -> Array:
    return _cumulative(x, axis, F.product, lambda base, v: base * v, include_initial, 1)


# Shape


def reshape(x: Array, shape: int | Sequence[int]) -> Array:
    shape = [shape] if isinstance(shape, int) else list(shape)
    if -1 in shape:
        shape[shape.index(-1)] = x.size // -math.prod(shape)
    if math.prod(shape) != x.size:
        raise ValueError(f"{x.shape} does not reshape to {tuple(shape)}")
    df, rest, names = x.df.withColumn("__at", x.flat_index()), x.size, []
    for i, n in enumerate(shape):
        rest //= max(1, n)
        names.append((F.floor(F.col("__at") / max(1, rest)) % n).cast("long").alias(f"i{i}"))
    return Array(df.select(*names, "v"), shape)


def permute_dims(x: Array, axes: Sequence[int] | None = None) -> Array:
    axes = list(reversed(range(x.ndim))) if axes is None else [_normal(a, x.ndim) for a in axes]
    if sorted(axes) != list(range(x.ndim)):
        raise ValueError("axes is not a permutation")
    return Array(x.df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(axes)], "v"), [x.shape[a] for a in axes])


transpose = permute_dims


def matrix_transpose(x: Array) -> Array:
    if x.ndim < 2:
        raise ValueError("a matrix has two axes")
    return permute_dims(x, [*range(x.ndim - 2), x.ndim - 1, x.ndim - 2])


def squeeze(x: Array, axis: Any = None) -> Array:
    axes = [i for i, n in enumerate(x.shape) if n == 1] if axis is None else [axis] if isinstance(axis, int) else axis
    gone = {_normal(a, x.ndim) for a in axes}
    if any(x.shape[a] != 1 for a in gone):
        raise ValueError("only axes of length one can be squeezed")
    return x[tuple(0 if i in gone else slice(None) for i in range(x.ndim))] if gone else x


def expand_dims(x: Array, axis: int | Sequence[int] = 0) -> Array:
    axes = [axis] if isinstance(axis, int) else list(axis)
    ndim = x.ndim + len(axes)
    new = {_normal(a, ndim) for a in axes}
    return x[tuple(None if i in new else slice(None) for i in range(ndim))]


def concat(arrays: Sequence[Array], axis: int = 0) -> Array:
    at = _normal(axis, arrays[0].ndim)
    for a in arrays[1:]:
        if [n for i, n in enumerate(a.shape) if i != at] != [n for i, n in enumerate(arrays[0].shape) if i != at]:
            raise ValueError("arrays differ in another axis")
    out, offset = None, 0
    for a in arrays:
        moved = a.df.withColumn(f"i{at}", F.col(f"i{at}") + F.lit(offset))
        out = moved if out is None else out.unionByName(moved)
        offset += a.shape[at]
    shape = list(arrays[0].shape)
    shape[at] = offset
    return Array(out, shape)


def stack(arrays: Sequence[Array], axis: int = 0) -> Array:
    return concat([expand_dims(a, axis) for a in arrays], axis)


def meshgrid(*arrays: Array, indexing: str = "xy") -> list[Array]:
    order = list(range(len(arrays)))
    if indexing == "xy" and len(arrays) > 1:
        order[0], order[1] = 1, 0
    shape = [arrays[o].shape[0] for o in order]
    out = []
    for i, a in enumerate(arrays):
        at = order.index(i)
        placed = Array(
            a.df.select(*[(F.col("i0") if k == at else F.lit(0).cast("long")).alias(f"i{k}") for k in range(len(arrays))], "v"),
            [a.shape[0] if k == at else 1 for k in range(len(arrays))],
        )
        out.append(broadcast_to(placed, shape))
    return out


def take(x: Array, indices: Any, axis: int | None = None) -> Array:
    """Gather along an axis, or from the flat array; negative indices count from the end."""
    if axis is None:
        x, axis = reshape(x, (x.size,)), 0
    at = _normal(axis, x.ndim)
    n = x.shape[at]
    indices = np.asarray(indices)
    flat = indices.reshape(-1).astype(np.int64)
    if len(flat) and (flat.min() < -n or flat.max() >= n):
        raise IndexError("an index is out of bounds")
    places = pd.DataFrame({"__from": np.where(flat < 0, flat + n, flat), "__to": np.arange(len(flat))})
    chosen = x.df.sparkSession.createDataFrame(places, "__from long, __to long")
    joined = x.df.join(chosen, F.col(f"i{at}") == F.col("__from"))
    names = [F.col("__to").alias(f"i{at}") if i == at else F.col(f"i{i}") for i in range(x.ndim)]
    shape = [len(flat) if i == at else m for i, m in enumerate(x.shape)]
    out = Array(joined.select(*names, "v"), shape)
    if indices.ndim == 1:
        return out
    return reshape(out, [*x.shape[:at], *indices.shape, *x.shape[at + 1 :]])


def take_along_axis(x: Array, indices: Any, axis: int = -1) -> Array:
    at = _normal(axis, x.ndim)
    places = indices if isinstance(indices, Array) else array(x.df.sparkSession, np.asarray(indices))
    n = x.shape[at]
    wanted = places.df.withColumn("__from", F.when(F.col("v") < 0, F.col("v") + n).otherwise(F.col("v"))).drop("v")
    wanted = wanted.withColumnRenamed(f"i{at}", "__to").withColumnRenamed("__from", f"i{at}")
    joined = x.df.join(wanted, x.axes)
    names = [F.col("__to").alias(f"i{at}") if i == at else F.col(f"i{i}") for i in range(x.ndim)]
    return Array(joined.select(*names, "v"), places.shape)


# Sorting


def argsort(x: Array) -> Array:
    """Stable positions that sort a vector; NaN comes last."""
    if x.ndim != 1:
        raise ValueError("argsort takes a vector")
    placed = dense_positions(x.df, [F.col("v").asc_nulls_last(), F.col("i0")], "__at")
    return Array(placed.select(F.col("__at").alias("i0"), F.col("i0").alias("v")), x.shape)


def sort(x: Array) -> Array:
    if x.ndim != 1:
        raise ValueError("sort takes a vector")
    placed = dense_positions(x.df, [F.col("v").asc_nulls_last(), F.col("i0")], "__at")
    return Array(placed.select(F.col("__at").alias("i0"), "v"), x.shape)


def iter_sorted(x: Array, start: int | None = None, stop: int | None = None, step: int | None = None):
    """Values in order, a stretch of them, one at a time."""
    for row in sort(x)[slice(start, stop, step)].df.orderBy("i0").select("v").toLocalIterator():
        yield row.v


# Linear algebra


#: Rows and columns of a tile of a matrix.
TILE = 128


def _tiles(df: DataFrame, groups: list[str], row: str, column: str, value: str, names: tuple[str, str, str]) -> DataFrame:
    """A row per tile: its place in the grid of tiles, and its cells as (position, value)."""
    place = ((F.col(row) % TILE) * TILE + F.col(column) % TILE).cast("int")
    cells = df.select(
        *groups,
        F.floor(F.col(row) / TILE).alias(names[0]),
        F.floor(F.col(column) / TILE).alias(names[1]),
        F.struct(place.alias("at"), F.col(value).cast("double").alias("v")).alias("cell"),
    )
    return cells.groupBy(*groups, names[0], names[1]).agg(F.collect_list("cell").alias(names[2]))


def _tile_products(left: DataFrame, right: DataFrame, groups: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """Partial sums __p of cells (__r, __c), one for each tile of the contracted axis.

    A cell is shuffled once per tile of the other operand instead of once per
    row or column of it, and a product of tiles is one NumPy call.
    """
    one = _tiles(left, groups, "__r", "__k", "__a", ("__rt", "__kt", "__left"))
    two = _tiles(right, groups, "__k", "__c", "__b", ("__kt", "__ct", "__right"))
    joined = one.join(two, [*groups, "__kt"]).select(*groups, "__rt", "__ct", "__left", "__right")
    rows, _, columns = shape

    def dense(cells: pa.Scalar) -> np.ndarray:
        flat = cells.values.flatten()
        out = np.zeros(TILE * TILE)
        out[flat[0].to_numpy(zero_copy_only=False)] = flat[1].to_numpy(zero_copy_only=False)
        return out.reshape(TILE, TILE)

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                product = dense(batch["__left"][i]) @ dense(batch["__right"][i])
                r0, c0 = batch["__rt"][i].as_py() * TILE, batch["__ct"][i].as_py() * TILE
                product = product[: rows - r0, : columns - c0]
                r, c = np.indices(product.shape)
                cells = {g: pa.repeat(batch[g][i], product.size) for g in groups}
                cells |= {"__r": pa.array(r.ravel() + r0), "__c": pa.array(c.ravel() + c0), "__p": pa.array(product.ravel())}
                yield pa.RecordBatch.from_pydict(cells)

    schema = ", ".join([*(f"{g} bigint" for g in groups), "__r bigint, __c bigint, __p double"])
    return joined.mapInArrow(multiply, schema)


def matmul(x1: Array, x2: Array) -> Array:
    """Matrix product, also of vectors and stacks: a join of tiles (cells, unless both are floats) on the contracted axis and a grouped sum."""
    if not x1.ndim or not x2.ndim:
        raise ValueError("matmul takes arrays with axes")
    a = expand_dims(x1, 0) if x1.ndim == 1 else x1
    b = expand_dims(x2, 1) if x2.ndim == 1 else x2
    if a.shape[-1] != b.shape[-2]:
        raise ValueError(f"{x1.shape} and {x2.shape} do not match")
    stack_shape = broadcast_shape(a.shape[:-2], b.shape[:-2])
    a, b = broadcast_to(a, (*stack_shape, *a.shape[-2:])), broadcast_to(b, (*stack_shape, *b.shape[-2:]))
    n = len(stack_shape)
    groups = [f"i{k}" for k in range(n)]
    left = a.df.select(*groups, F.col(f"i{n}").alias("__r"), F.col(f"i{n + 1}").alias("__k"), F.col("v").alias("__a"))
    right = b.df.select(*groups, F.col(f"i{n}").alias("__k"), F.col(f"i{n + 1}").alias("__c"), F.col("v").alias("__b"))
    if x1.kind == x2.kind == "float":
        products = _tile_products(left, right, groups, (a.shape[-2], a.shape[-1], b.shape[-1]))
    else:
        products = left.join(right, [*groups, "__k"]).select(*groups, "__r", "__c", (F.col("__a") * F.col("__b")).alias("__p"))
    summed = products.groupBy(*groups, "__r", "__c").agg(F.sum("__p").alias("v"))
    out = Array(
        summed.select(*groups, F.col("__r").alias(f"i{n}"), F.col("__c").alias(f"i{n + 1}"), "v"),
        (*stack_shape, a.shape[-2], b.shape[-1]),
    )
    if x2.ndim == 1:
        out = squeeze(out, -1)
    return squeeze(out, -1 if x2.ndim == 1 else -2) if x1.ndim == 1 else out


Array.__matmul__ = matmul


def tensordot(x1: Array, x2: Array, axes: Any = 2) -> Array:
    """Contract axes: a number of last and first ones, or two lists."""
    if isinstance(axes, int):
        one, two = list(range(x1.ndim - axes, x1.ndim)), list(range(axes))
    else:
        one, two = ([a] if isinstance(a, int) else list(a) for a in axes)
        one, two = [_normal(a, x1.ndim) for a in one], [_normal(a, x2.ndim) for a in two]
    if [x1.shape[a] for a in one] != [x2.shape[a] for a in two]:
        raise ValueError("contracted axes differ in length")
    free1, free2 = [i for i in range(x1.ndim) if i not in one], [i for i in range(x2.ndim) if i not in two]
    shape1, shape2 = [x1.shape[i] for i in free1], [x2.shape[i] for i in free2]
    if one and x1.kind == x2.kind == "float":
        inner = math.prod(x1.shape[i] for i in one)
        left = reshape(permute_dims(x1, [*free1, *one]), (math.prod(shape1), inner))
        right = reshape(permute_dims(x2, [*two, *free2]), (inner, math.prod(shape2)))
        return reshape(matmul(left, right), [*shape1, *shape2])
    left = x1.df.select(*[F.col(f"i{i}").alias(f"__f{k}") for k, i in enumerate(free1)], *[F.col(f"i{i}").alias(f"__k{k}") for k, i in enumerate(one)], F.col("v").alias("__a"))
    right = x2.df.select(*[F.col(f"i{i}").alias(f"__g{k}") for k, i in enumerate(free2)], *[F.col(f"i{i}").alias(f"__k{k}") for k, i in enumerate(two)], F.col("v").alias("__b"))
    names = [f"__f{k}" for k in range(len(free1))] + [f"__g{k}" for k in range(len(free2))]
    joined = left.join(right, [f"__k{k}" for k in range(len(one))]) if one else left.crossJoin(right)
    total = F.sum(F.col("__a") * F.col("__b")).alias("v")
    out = joined.groupBy(*names).agg(total) if names else joined.agg(total)
    return Array(out.select(*[F.col(n).alias(f"i{k}") for k, n in enumerate(names)], "v"), [*shape1, *shape2])


def vecdot(x1: Array, x2: Array, axis: int = -1) -> Array:
    """Dot products along an axis; the first operand is conjugated."""
    if x1.kind == "complex":
        x1 = elementwise(REGISTRY["conj"], x1)
    return reduce(elementwise(REGISTRY["multiply"], x1, x2), "sum", axis=axis)


def outer(x1: Array, x2: Array) -> Array:
    if x1.ndim != 1 or x2.ndim != 1:
        raise ValueError("outer takes vectors")
    return elementwise(REGISTRY["multiply"], expand_dims(x1, 1), expand_dims(x2, 0))


def diagonal(x: Array, offset: int = 0) -> Array:
    """The diagonal of the last two axes."""
    if x.ndim < 2:
        raise ValueError("a diagonal needs two axes")
    rows, columns = x.shape[-2:]
    r, c = f"i{x.ndim - 2}", f"i{x.ndim - 1}"
    n = max(0, min(rows + min(0, offset), columns - max(0, offset)))
    kept = x.df.filter(F.col(r) + offset == F.col(c))
    place = F.col(r) if offset >= 0 else F.col(c)
    return Array(kept.select(*x.axes[:-2], place.alias(r), "v"), (*x.shape[:-2], n))


__all__ = ["REDUCTIONS", "Array"]
