"""Parquet, CSV, Arrow and pandas."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schema as S
from granary.expr import quoted
from granary.operators import packed as packing
from granary.operators.table import POS, Table
from granary.scratch import scratch_folder


def _ordered_by_file(df: DataFrame) -> DataFrame:
    """df with its place in the files as the hidden order; columns that nothing asks for are not read."""
    return df.withColumn(POS, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def flatten(df: DataFrame) -> DataFrame:
    """Leaves of structs as dotted columns; dots inside a name are escaped."""
    out: list = []

    def walk(parts: list[str], column, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType) and [f.name for f in dtype.fields] != ["re", "im"]:
            for f in dtype.fields:
                walk([*parts, f.name], column[f.name], f.dataType)
        else:
            out.append(column.alias(S.join_path(parts) if len(parts) > 1 else parts[0]))

    for f in df.schema.fields:
        if f.name.startswith("__"):
            out.append(F.col(f.name))
        else:
            walk([f.name], F.col(quoted(f.name)), f.dataType)
    return df.select(*out)


def nest(df: DataFrame) -> DataFrame:
    """Dotted columns put back into structs."""
    tree: dict = {}
    for name in df.columns:
        at = tree
        *heads, last = S.split_path(name)
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = F.col(quoted(name))

    def build(node):
        return F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

    return df.select(*[build(v).alias(k) for k, v in tree.items()])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, max_rows: int | None = None, separate_nested_cols: bool = True) -> Table:
    """A table of Parquet files, in file order.

    A single root column of list<struct> holds the rows themselves and is
    unpacked. Struct leaves become dotted columns unless
    separate_nested_cols is False.
    """
    raw = spark.read.parquet(path)
    root = raw.schema.fields[0] if len(raw.schema.fields) == 1 else None
    if root and isinstance(root.dataType, T.ArrayType) and isinstance(root.dataType.elementType, T.StructType):
        rows = _ordered_by_file(raw).select(F.col(POS).alias("__f"), F.posexplode(quoted(root.name)).alias("__i", "__row"))
        df = rows.select("__row.*", F.struct("__f", "__i").alias(POS))
    else:
        df = _ordered_by_file(raw)
    if separate_nested_cols:
        df = flatten(df)
    if max_rows is not None:
        df = df.orderBy(POS).limit(max_rows)
    table = Table(df)
    return table if columns is None else Table(table.select(columns).df)


def write_parquet(table: Table, path: str, nested: bool = False, files: int | None = None, compression: str = "zstd", mode: str = "error") -> None:
    """Rows in order; nested puts dotted columns back into structs, files bounds the number of files."""
    df = table.ordered_frame
    df = nest(df) if nested else df
    df = df.coalesce(files) if files else df
    df.write.mode(mode).option("compression", compression).parquet(path)


def read_csv(spark: SparkSession, path: str, row_class: type | None = None, header: bool = True, sep: str = ",", encoding: str = "utf-8") -> Table:
    """A table of CSV; empty cells are null, array cells are JSON. Without a row class all columns are text."""
    if row_class is None:
        df = spark.read.option("header", header).option("sep", sep).option("encoding", encoding).option("emptyValue", "").csv(path)
        return Table.from_frame(df)
    schema = S.compile_schema(row_class).struct()
    as_text = T.StructType([T.StructField(f.name, T.StringType() if _is_nested(f.dataType) else f.dataType) for f in schema.fields])
    df = spark.read.schema(as_text).option("header", header).option("sep", sep).option("encoding", encoding).option("escape", '"').csv(path)
    columns = []
    for f in schema.fields:
        value = F.from_json(quoted(f.name), f.dataType) if _is_nested(f.dataType) else F.col(quoted(f.name))
        columns.append(S.spec_of(f).from_stored(value).alias(f.name, metadata=f.metadata))
    return Table.from_frame(df.select(*columns))


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType | T.StructType)


def write_csv(table: Table, path: str | None = None, sep: str = ",", header: bool = True, encoding: str = "utf-8") -> str | None:
    """CSV files at path, or the text if there is no path; nulls are empty cells, arrays JSON."""
    df = table.ordered_frame
    df = df.select(*[F.to_json(quoted(f.name)).alias(f.name) if _is_nested(f.dataType) else F.col(quoted(f.name)) for f in df.schema.fields])
    if path is None:
        out = io.StringIO()
        df.toPandas().to_csv(out, sep=sep, header=header, index=False)
        return out.getvalue()
    df.write.option("sep", sep).option("header", header).option("encoding", encoding).option("escape", '"').csv(path)
    return None


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> Table:
    numbered = pdf.reset_index(drop=True).assign(**{POS: range(len(pdf))})
    return Table(spark.createDataFrame(numbered), dense=True)


#: Rows of an Arrow stream that the driver holds at once.
STREAM_ROWS = 500_000


def from_arrow(spark: SparkSession, data: Any, batches: Iterable[pa.RecordBatch] | None = None) -> Table:
    """A table of a pyarrow Table, a schema with batches, or anything with an Arrow stream.

    Streams are written to a scratch table in stretches, so the driver holds
    no more than STREAM_ROWS rows and one batch of them. Tables of Spark need
    not come this way: ``write_arrow`` and ``read_arrow`` leave rows on the
    executors.
    """
    if isinstance(data, pa.Table):
        return Table(spark.createDataFrame(data.append_column(POS, pa.array(range(data.num_rows), pa.int64()))), dense=True)
    if batches is None:
        data = pa.RecordBatchReader.from_stream(data)
        batches, schema = data, data.schema
    else:
        schema = data
    path, held, rows, start = f"{scratch_folder(spark)}/arrow-{uuid.uuid4().hex}", [], 0, 0

    def flush() -> None:
        part = pa.Table.from_batches(held, schema=schema)
        part = part.append_column(POS, pa.array(range(start, start + part.num_rows), pa.int64()))
        spark.createDataFrame(part).write.mode("append").parquet(path)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= STREAM_ROWS:
            flush()
            start, rows, held = start + rows, 0, []
    if held or not start:
        flush()
    return Table(spark.read.parquet(path), dense=True)


def iter_arrow_batches(table: Table, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Record batches in order, with one partition on the driver at a time; ``pack_batches`` leaves them on the executors."""
    df = table.ordered_frame
    names, held = df.columns, []
    arrow = None
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        if len(held) == rows:
            arrow = arrow or _arrow_schema(df)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=arrow or _arrow_schema(df))


def pack_batches(table: Table, rows: int = 65_536) -> DataFrame:
    """``iter_arrow_batches`` as a DataFrame of (start, stream): Arrow IPC bytes of every ``rows`` rows in order, made by the executors."""
    return packing.pack(table.numbered().df.select(*[F.col(quoted(c)) for c in table.columns], POS), POS, rows)


def unpack_batches(packed: DataFrame) -> Table:
    """The table of what ``pack_batches`` made, in its order."""
    return Table(packing.unpack(packed, POS), dense=True)


def write_arrow(table: Table, path: str, rows: int = 65_536) -> None:
    """Arrow streams of every ``rows`` rows in order, written by the executors as ``pack_batches`` makes them."""
    pack_batches(table, rows).write.parquet(path)


def read_arrow(spark: SparkSession, path: str) -> Table:
    """The table of what ``write_arrow`` wrote."""
    return unpack_batches(spark.read.parquet(path))


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def to_bytes(table: Table) -> bytes:
    """Arrow IPC bytes of the rows in order."""
    found = table.to_arrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as writer:
        writer.write_table(found)
    return sink.getvalue().to_pybytes()


def from_bytes(spark: SparkSession, raw: bytes) -> Table:
    out = from_arrow(spark, pa.ipc.open_stream(raw).read_all())
    out.is_view = True
    return out


def same_rows(one: Table, two: Table) -> bool:
    """Whether two tables have the same rows, however ordered."""
    a, b = one.frame, two.frame.select(*[F.col(quoted(c)) for c in one.columns])
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
