"""Tables: DataFrames with a logical row order, views and mutation by rebinding."""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schema as S
from granary.expr import NAN, Bound, Expr, field, predicate, quoted, to_expr
from granary.operators.groupby import GroupBy
from granary.scratch import materialize

POS = "__pos"
_PRINT_OPTIONS = {"max_rows": 20, "max_width": 120, "display_index": False}


def set_printoptions(**options: Any) -> None:
    unknown = set(options) - set(_PRINT_OPTIONS)
    if unknown:
        raise ValueError(f"unknown display options: {sorted(unknown)}")
    _PRINT_OPTIONS.update(options)


def get_printoptions() -> dict:
    return dict(_PRINT_OPTIONS)


#: Rows that a top-k may hold; longer stretches are found by their positions.
MOST_SORTED = 100_000


class ReadOnlyError(ValueError):
    """A view was asked to change."""


def dense_positions(df: DataFrame, order: Sequence[SparkColumn], name: str = POS) -> DataFrame:
    """df with ``name`` set to 0, 1, ... in the given order, without one task that sees all rows.

    Rows are sorted over ranges and written once. Within a written partition
    the running id counts rows, and the counts of the partitions before it
    (one row per partition, so a small broadcast) are added.
    """
    sorted_rows = df.orderBy(*order) if order else df
    tagged = materialize(sorted_rows.withColumn("__id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        tagged.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__base"))
    )
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__base")
    joined = tagged.withColumn("__part", part).join(F.broadcast(bases), "__part")
    return joined.withColumn(name, place).drop("__part", "__id", "__base")


def _in_range(places: range) -> SparkColumn:
    """Whether the position is in a range."""
    if not places:
        return F.lit(False)
    low, high = sorted((places[0], places[-1]))
    return F.col(POS).between(low, high) & ((F.col(POS) - places[0]) % abs(places.step) == 0)


class Table:
    """A table with a logical row order.

    The order is in a hidden column that queries without positions never
    read. Filters, projections and sorts give views; changes are refused on
    views and rebind the DataFrame of a table of its own.
    """

    def __init__(self, df: DataFrame, *, dense: bool = False, view: bool = False, computed: Mapping[str, Expr] | None = None, generated: Mapping[str, Expr] | None = None, order: Sequence[SparkColumn] | None = None):
        self.df = df
        self.dense = dense
        self.is_view = view
        self.computed = dict(computed or {})
        self.generated = dict(generated or {})
        self.order = list(order) if order else [F.col(POS)]
        self._indexes: dict[str, Any] = {}
        self._found: dict[str, DataFrame] = {}

    # Construction

    @classmethod
    def from_frame(cls, df: DataFrame, ordered_by: Sequence[SparkColumn] | None = None) -> Table:
        """A table of a DataFrame; the order is that of ordered_by, else of the partitions."""
        if ordered_by:
            return cls(df.withColumn(POS, F.lit(None).cast("long")), order=ordered_by)
        return cls(df.withColumn(POS, F.monotonically_increasing_id()))

    @classmethod
    def from_rows(cls, spark: SparkSession, row_class: type, data: Any = None, validate: bool = True) -> Table:
        """Rows (tuples, dicts or instances), {column: values}, a structured array, or another table."""
        compiled = S.compile_schema(row_class)
        table = cls(spark.createDataFrame([], T.StructType([*compiled.struct().fields, T.StructField(POS, T.LongType())])), dense=True)
        table.defaults = compiled.defaults
        if data is not None:
            table.extend(data, validate=validate)
        return table

    defaults: dict[str, Any] = {}

    # Schema

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def schema(self) -> T.StructType:
        fields = [f for f in self.df.schema.fields if not f.name.startswith("__")]
        return T.StructType(fields)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def frame(self) -> DataFrame:
        """The rows as a plain DataFrame."""
        return self.df.select(*[F.col(quoted(c)) for c in self.columns])

    @property
    def ordered_frame(self) -> DataFrame:
        return self.df.orderBy(*self.order).select(*[F.col(quoted(c)) for c in self.columns])

    def column_schema(self, name: str) -> S.Spec:
        return S.spec_of(self.schema[name])

    def schema_dict(self) -> dict:
        return {f.name: S.spec_of(f).to_dict() for f in self.schema.fields}

    @property
    def info(self) -> dict:
        return {"rows": len(self), "nbytes": self.nbytes, "columns": self.schema_dict(), "computed": list(self.computed), "view": self.is_view}

    @property
    def nbytes(self) -> int:
        """The size that Spark's optimizer estimates: of the files for a stored table, of the plan's output otherwise."""
        return int(str(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def __len__(self) -> int:
        return self.df.count()

    def _derived(self, df: DataFrame, **changes: Any) -> Table:
        options = {"dense": False, "view": True, "computed": self.computed, "generated": self.generated, "order": self.order} | changes
        return Table(df, **options)

    # Access

    def __getitem__(self, key: Any):
        if isinstance(key, str):
            if key in self.columns:
                return Column(self, key)
            try:
                field(self.schema, key)
                return Column(self, key)
            except KeyError:
                pass
            prefix = [c for c in self.columns if c.startswith(key + ".")]
            if prefix:
                return NestedColumn(self, key, prefix)
            if key.isidentifier():
                raise KeyError(key)
            return self.where(key)
        if isinstance(key, bool):
            raise TypeError("a table is not indexed by a boolean")
        if isinstance(key, int | np.integer):
            return self.row(int(key))
        if isinstance(key, slice):
            return self._sliced(key)
        if isinstance(key, Expr | Column):
            return self.where(key)
        if isinstance(key, np.ndarray) and key.dtype == bool:
            return self.where(key)
        key = list(key)
        if key and all(isinstance(k, str) for k in key):
            return self.select(key)
        if key and all(isinstance(k, bool | np.bool_) for k in key):
            return self.where(np.array(key))
        return self.take(key)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def select(self, columns: Sequence[str]) -> Table:
        columns = list(columns)
        if not columns:
            raise ValueError("select at least one column")
        out = []
        for c in columns:
            out.append(field(self.schema, c).col.alias(c))
        return self._derived(self.df.select(*out, *self._hidden()))

    def _hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def where(self, condition: Any, columns: Sequence[str] | None = None) -> Table:
        """Rows for which the condition is definitely true; it is an expression, its text, or a mask in row order."""
        if isinstance(condition, Column):
            condition = condition.expr
        if isinstance(condition, np.ndarray):
            kept = self._masked(condition)
        else:
            rows = self.df
            if self._indexes:
                from granary.operators import indexes

                rows = indexes.narrowed(self, condition)
            kept = self._derived(rows.filter(predicate(condition, self.schema)))
        return kept.select(columns) if columns is not None else kept

    view = where

    def coordinates(self, condition: Any) -> DataFrame:
        """The positions of the rows that meet a condition, as a DataFrame; they are written once and kept until the table changes."""
        if isinstance(condition, Column):
            condition = condition.expr
        text = to_expr(condition).text
        if text not in self._found:
            found = self.numbered().df.filter(predicate(condition, self.schema)).select(F.col(POS).alias("position"))
            self._found[text] = materialize(found, "coordinates")
        return self._found[text]

    def _masked(self, mask: np.ndarray) -> Table:
        if mask.dtype != bool:
            raise TypeError("a mask is boolean")
        places = np.flatnonzero(mask)
        found = self.numbered()
        flags = self.spark.createDataFrame(pd.DataFrame({POS: places.astype(np.int64)}), f"{POS} long")
        return self._derived(found.df.join(flags, POS, "left_semi"), order=[F.col(POS)])

    def assign(self, **expressions: Any) -> Table:
        """A view with more columns."""
        new = {}
        for name, value in expressions.items():
            if name in self.columns:
                raise ValueError(f"there is a column {name!r} already")
            new[name] = to_expr(value.expr if isinstance(value, Column) else value).bind(self.schema).col
        return self._derived(self.df.withColumns(new))

    def numbered(self) -> Table:
        """The same rows with dense positions."""
        if self.dense:
            return self
        return self._derived(dense_positions(self.df.drop(POS) if self.order_is_free() else self.df, self.order), dense=True, order=[F.col(POS)])

    def order_is_free(self) -> bool:
        """Whether the hidden position is not part of the order."""
        return POS not in str(self.order)

    def by_position(self) -> bool:
        """Whether the order is that of the hidden position alone."""
        return [str(c) for c in self.order] == [str(F.col(POS))]

    def row(self, i: int):
        """One row as a named tuple; negative positions count from the end."""
        if i < 0 and not self.by_position():
            size = len(self)
            return self.row(size + i) if -i <= size else self._no_row(i)
        order = self.order if i >= 0 else [F.desc(POS)]
        skip = i if i >= 0 else -i - 1
        found = self.df.orderBy(*order).offset(skip).limit(1).select(*[F.col(quoted(c)) for c in self.columns]).collect()
        if not found:
            self._no_row(i)
        return namedtuple("Row", self.columns, rename=True)(*found[0])

    def _no_row(self, i: int):
        raise IndexError(f"row {i} is out of bounds")

    def head(self, n: int = 5) -> Table:
        return self._derived(self.df.orderBy(*self.order).limit(n))

    def tail(self, n: int = 5) -> Table:
        if not self.by_position():
            return self._sliced(slice(max(0, len(self) - n), None))
        return self._derived(self.df.orderBy(F.desc(POS)).limit(n))

    def slice(self, start: int, stop: int | None = None) -> Table:
        """Rows start to stop in order; one argument is the stop."""
        if stop is None:
            start, stop = 0, start
        if isinstance(start, slice):
            raise TypeError("slice takes a start and a stop")
        return self._sliced(slice(start, stop))

    def _sliced(self, key: slice) -> Table:
        start, stop, step = key.start or 0, key.stop, 1 if key.step is None else key.step
        if step == 1 and start >= 0 and stop is not None and 0 <= stop <= MOST_SORTED:
            out = self.df.orderBy(*self.order)
            return self._derived((out.offset(start) if start else out).limit(max(0, stop - start)))
        if step == 1 and start == 0 and stop is None:
            return self._derived(self.df)
        start, stop, step = key.indices(len(self))
        found = self.numbered()
        kept = found.df.filter(_in_range(range(start, stop, step)))
        return self._derived(kept if step > 0 else kept.withColumn(POS, -F.col(POS)), order=[F.col(POS)])

    def take(self, positions: Sequence[int]) -> Table:
        """Rows at positions, in that order, repeats included."""
        size = len(self)
        wanted = np.asarray(list(positions), dtype=np.int64)
        wanted = np.where(wanted < 0, wanted + size, wanted)
        if len(wanted) and (wanted.min() < 0 or wanted.max() >= size):
            raise IndexError("a position is out of bounds")
        order = self.spark.createDataFrame(pd.DataFrame({POS: wanted, "__k": np.arange(len(wanted))}), f"{POS} long, __k long")
        joined = self.numbered().df.join(order, POS).withColumn(POS, F.col("__k")).drop("__k")
        return self._derived(joined, dense=True, order=[F.col(POS)])

    def sample(self, n: int, seed: int | None = None) -> Table:
        """n random rows without replacement, or all if there are fewer; by smallest random draw."""
        return self._derived(self.df.orderBy(F.rand(seed)).limit(n))

    def dropna(self, subset: Sequence[str] | None = None) -> Table:
        out = self.df
        for name in subset or self.columns:
            out = out.filter(field(self.schema, name).col.isNotNull())
        return self._derived(out)

    # Sorting

    def _sort_keys(self, columns: Any, ascending: Any) -> list[SparkColumn]:
        columns = [columns] if isinstance(columns, str) else list(columns)
        up = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
        if len(up) != len(columns):
            raise ValueError("one direction per column is needed")
        keys = []
        for name, asc in zip(columns, up, strict=True):
            bound = field(self.schema, name)
            if bound.kind in ("complex", "array", "other"):
                raise TypeError(f"cannot sort by {name!r}: {bound.kind}")
            if bound.kind == "float":
                # values, then NaN, then null, in both directions
                keys.append(F.when(bound.col.isNull(), 2).when(F.isnan(bound.col), 1).otherwise(0))
            keys.append(bound.col.asc_nulls_last() if asc else bound.col.desc_nulls_last())
        return keys

    def sort_by(self, columns: Any, ascending: Any = True, inplace: bool = False, view: bool = False) -> Table:
        """Stable sort by one or more columns, nulls last. A sorted view costs nothing until rows are read."""
        if inplace and view:
            raise ValueError("inplace and view exclude each other")
        keys = self._sort_keys(columns, ascending)
        out = self._derived(self.df, order=[*keys, *self.order], view=view)
        if inplace:
            self._writable()
            self.df, self.order, self.dense = out.df, out.order, False
            return self
        return out

    def sorted_slice(self, column: str, key: slice, ascending: bool = True) -> Table:
        return self.sort_by(column, ascending, view=True)._sliced(key)

    def iter_sorted(self, column: Any, ascending: bool = True) -> Iterator:
        return iter(self.sort_by(column, ascending, view=True))

    def __iter__(self) -> Iterator:
        row = namedtuple("Row", self.columns, rename=True)
        for r in self.ordered_frame.toLocalIterator():
            yield row(*r)

    def argsort(self, columns: Any, ascending: Any = True) -> np.ndarray:
        """The positions of the rows in sorted order, on the driver; ``argsort_frame`` has no bound on their number."""
        found = self.numbered()
        return np.array([r[0] for r in found.df.orderBy(*found._sort_keys(columns, ascending), POS).select(POS).collect()])

    def argsort_frame(self, columns: Any, ascending: Any = True) -> DataFrame:
        """``argsort`` as a DataFrame of (place, position): place in the sorted order, and position of the row that has it."""
        found = self.numbered()
        names = dict.fromkeys([columns] if isinstance(columns, str) else columns)
        narrow = found.select(list(names))
        placed = dense_positions(narrow.df, [*narrow._sort_keys(columns, ascending), F.col(POS)], "__place")
        return placed.select(F.col("__place").alias("place"), F.col(POS).alias("position"))

    # Aggregation

    def group_by(self, keys: Any, *, sort: bool | None = None, dropna: bool = True, engine: str = "auto") -> GroupBy:
        return GroupBy(self, keys, sort=sort, dropna=dropna, engine=engine)

    def describe(self) -> pd.DataFrame:
        """One row per column, from one aggregation."""
        wanted: dict[tuple[str, str], SparkColumn] = {}
        for f in self.schema.fields:
            bound = field(self.schema, f.name)
            c = bound.col
            wanted[f.name, "count"] = F.count(c)
            wanted[f.name, "nulls"] = F.count_if(c.isNull())
            if bound.kind in ("int", "float", "decimal"):
                for stat, value in (("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("min", F.min(c)), ("max", F.max(c))):
                    wanted[f.name, stat] = value.cast("double")
            elif bound.kind == "bool":
                wanted[f.name, "true"] = F.count_if(c)
                wanted[f.name, "false"] = F.count_if(~c)
            elif bound.kind == "str":
                wanted[f.name, "unique"] = F.count_distinct(c)
        found = self.df.agg(*[v.alias(f"s{i}") for i, v in enumerate(wanted.values())]).first()
        out: dict[str, dict] = {}
        for value, (name, stat) in zip(found, wanted, strict=True):
            out.setdefault(name, {})[stat] = value
        return pd.DataFrame.from_dict(out, orient="index")

    def cov(self) -> np.ndarray:
        """Covariances (ddof 1) of all columns, in one aggregation."""
        names = self.columns
        values = []
        for name in names:
            bound = field(self.schema, name)
            if bound.kind not in ("bool", "int", "float"):
                raise TypeError(f"covariance needs real numbers: {name!r} is {bound.kind}")
            values.append(bound.col.cast("int" if bound.kind == "bool" else "double").cast("double"))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        found = self.df.agg(F.count(F.lit(1)), *[F.covar_samp(values[i], values[j]) for i, j in pairs]).first()
        if found[0] < 2:
            raise ValueError("covariance needs at least two rows")
        out = np.empty((len(names), len(names)))
        for (i, j), v in zip(pairs, found[1:], strict=True):
            out[i, j] = out[j, i] = NAN if v is None else v
        return out

    # Change

    def _writable(self) -> None:
        if self.is_view:
            raise ReadOnlyError("a view cannot be changed; copy() it first")

    def append(self, row: Any) -> None:
        self.extend([row])

    def extend(self, data: Any, validate: bool = True) -> None:
        """Add rows at the end; constraints are checked unless validate is False."""
        self._writable()
        stored = T.StructType([f for f in self.schema.fields if f.name not in self.computed and f.name not in self.generated])
        if isinstance(data, Table):
            new = data.numbered().df.select(*stored.names, POS)
        else:
            new = _local_frame(self.spark, data, stored, self.defaults)
        if validate:
            S.validate(new, stored)
        for name, expression in {**self.generated, **self.computed}.items():
            new = new.withColumn(name, expression.bind(new.schema).col)
        base = self.numbered()
        start = base.df.agg(F.max(POS)).first()[0]
        new = new.withColumn(POS, F.col(POS) + (0 if start is None else start + 1)).select(*base.df.columns)
        fresh = [i for i in self._indexes.values() if not i.stale and self.dense]
        self._rebind(base.df.unionByName(new), dense=True)
        for index in fresh:
            index.append(new)
            index.stale = False

    def _rebind(self, df: DataFrame, dense: bool = False) -> None:
        self.df, self.dense = self._with_metadata(df), dense
        self.order = [F.col(POS)]
        self._found: dict[str, DataFrame] = {}
        for index in self._indexes.values():
            index.stale = True

    def _with_metadata(self, df: DataFrame) -> DataFrame:
        known = {f.name: f for f in self.df.schema.fields}
        return df.select(
            *[
                F.col(quoted(f.name)).alias(f.name, metadata=known[f.name].metadata) if f.name in known and known[f.name].metadata else F.col(quoted(f.name))
                for f in df.schema.fields
            ]
        )

    def delete(self, positions: Any) -> None:
        """Remove rows by position, slice or positions."""
        self._writable()
        size = len(self)
        if isinstance(positions, slice):
            gone = _in_range(range(*positions.indices(size)))
            return self._rebind(self.numbered().df.filter(~gone))
        wanted = np.atleast_1d(np.asarray(list(positions) if not isinstance(positions, int) else positions, dtype=np.int64))
        wanted = np.where(wanted < 0, wanted + size, wanted)
        if len(wanted) and (wanted.min() < 0 or wanted.max() >= size):
            raise IndexError("a position is out of bounds")
        gone = self.spark.createDataFrame(pd.DataFrame({POS: wanted}), f"{POS} long")
        self._rebind(self.numbered().df.join(gone, POS, "left_anti"))

    def delete_where(self, condition: Any) -> None:
        self._writable()
        test = F.coalesce(predicate(condition, self.schema), F.lit(False))
        self._rebind(self.df.filter(~test))

    def compact(self) -> None:
        """Write the rows without gaps and cut their lineage."""
        self._writable()
        self._rebind(dense_positions(self.df.drop(POS) if self.order_is_free() else self.df, self.order), dense=True)

    def copy(self) -> Table:
        """The same rows as a table of its own."""
        out = self._derived(self.df, view=False, dense=self.dense)
        out.defaults = self.defaults
        return out

    def add_column(self, name: str, spec: S.Spec, default: Any = None, values: Any = None) -> None:
        self._writable()
        S.check_name(name)
        if name in self.columns:
            raise ValueError(f"there is a column {name!r} already")
        f = spec.field(name)
        if values is not None:
            values = list(values)
            if len(values) != len(self):
                raise ValueError("one value per row is needed")
            local = self.spark.createDataFrame(list(enumerate(values)), T.StructType([T.StructField(POS, T.LongType()), f]))
            S.validate(local.drop(POS), T.StructType([f]))
            df = self.numbered().df.join(local, POS)
        else:
            df = self.df.withColumn(name, F.lit(default).cast(f.dataType))
            S.validate(df.select(quoted(name)).limit(1), T.StructType([f]))
        df = df.withColumn(name, F.col(quoted(name)).alias(name, metadata=f.metadata))
        self._rebind(df, self.dense or values is not None)

    def drop_column(self, name: str) -> None:
        self._writable()
        self._known(name)
        if len(self.columns) == 1:
            raise ValueError("the last column cannot be dropped")
        self.computed.pop(name, None)
        self.generated.pop(name, None)
        self._rebind(self.df.drop(quoted(name).strip("`")), self.dense)

    def rename_column(self, old: str, new: str) -> None:
        self._writable()
        self._known(old)
        S.check_name(new)
        if new in self.columns:
            raise ValueError(f"there is a column {new!r} already")
        self._rebind(self.df.withColumnRenamed(old, new), self.dense)

    def _known(self, name: str) -> None:
        if name not in self.columns:
            raise KeyError(name)

    def add_computed_column(self, name: str, expression: Any, dtype: str | None = None) -> None:
        """A column that is always its expression over the others; it cannot be written."""
        self._computed_into(self.computed, name, expression, dtype)

    def add_generated_column(self, name: str, values: Any, dtype: str | None = None) -> None:
        """A stored column, filled from its expression when rows are added."""
        self._computed_into(self.generated, name, values, dtype)

    def _computed_into(self, where: dict, name: str, expression: Any, dtype: str | None) -> None:
        self._writable()
        S.check_name(name)
        if name in self.columns:
            raise ValueError(f"there is a column {name!r} already")
        expression = to_expr(expression)
        where[name] = expression.astype(dtype) if dtype else expression
        self._rebind(self.df.withColumn(name, where[name].bind(self.schema).col), self.dense)

    def refresh_generated_column(self, name: str) -> None:
        self._writable()
        self._rebind(self.df.withColumn(name, self.generated[name].bind(self.schema).col), self.dense)

    def materialize_computed_column(self, name: str, new_name: str | None = None) -> None:
        """Keep the present values of a computed column as an ordinary one."""
        self._writable()
        if name not in self.computed:
            raise KeyError(name)
        expression = self.computed.pop(name) if new_name is None else self.computed[name]
        if new_name is not None:
            self._rebind(self.df.withColumn(new_name, expression.bind(self.schema).col), self.dense)

    def drop_computed_column(self, name: str) -> None:
        if name not in self.computed:
            raise KeyError(name)
        self.drop_column(name)

    def convert_nulls(self, columns: str | Sequence[str] | None = None, to: str = "mask", null_value: Any = None) -> None:
        """Change how nulls are stored on export; a sentinel that occurs among the values is refused."""
        self._writable()
        if to not in ("mask", "sentinel"):
            raise ValueError("nulls are stored as a mask or a sentinel")
        names = self.columns if columns is None else [columns] if isinstance(columns, str) else list(columns)
        df = self.df
        for name in names:
            spec = S.spec_of(self.schema[name])
            changed = S.Spec.from_dict({**spec.to_dict(), "nullable": True, "null_storage": to} | ({"null_value": null_value} if null_value is not None else {}))
            if to == "sentinel":
                reserved = changed.sentinel()
                clash = F.isnan(quoted(name)) if isinstance(reserved, float) and math.isnan(reserved) else F.col(quoted(name)) == F.lit(reserved)
                if not self.df.filter(clash).isEmpty():
                    raise ValueError(f"column {name!r} has the value {reserved!r}")
            df = df.withColumn(name, F.col(quoted(name)).alias(name, metadata=changed.field(name).metadata))
        self.df = df

    def apply(self, function: Callable, columns: Sequence[str] | None = None, dtype: str = "double", name: str = "result") -> Table:
        """A view with the result of a function of NumPy arrays, run over Arrow batches."""
        names = list(columns or self.columns)

        def run(*series: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(function(*[s.to_numpy() for s in series])))

        run.__annotations__ = {}
        udf = F.pandas_udf(run, dtype, F.PandasUDFType.SCALAR)
        return self._derived(self.df.withColumn(name, udf(*[field(self.schema, n).col for n in names])))

    # Extensions of this library

    def join(self, other: Table, on: Any, how: str = "inner") -> Table:
        return Table.from_frame(self.frame.join(other.frame, on, how))

    def window(self, name: str, value: SparkColumn, partition_by: Sequence[str] = (), order_by: Sequence[str] = ()) -> Table:
        spec = Window.partitionBy(*map(quoted, partition_by)).orderBy(*map(quoted, order_by))
        return self._derived(self.df.withColumn(name, value.over(spec)))

    # Export

    def to_pandas(self) -> pd.DataFrame:
        return self.ordered_frame.toPandas()

    def to_arrow(self) -> pa.Table:
        return self.ordered_frame.toArrow()

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_arrow().__arrow_c_stream__(requested_schema)

    def to_string(self, display_index: bool | None = None, max_rows: int | None = None, max_width: int | None = None) -> str:
        index = _PRINT_OPTIONS["display_index"] if display_index is None else display_index
        rows = self.head(max_rows or _PRINT_OPTIONS["max_rows"]).to_pandas()
        return rows.to_string(index=index, line_width=max_width or _PRINT_OPTIONS["max_width"])

    def to_csv(self, path: str | None = None, **options: Any) -> str | None:
        from granary.sources import tabular

        return tabular.write_csv(self, path, **options)

    def to_parquet(self, path: str, **options: Any) -> None:
        from granary.sources import tabular

        tabular.write_parquet(self, path, **options)

    # Indexes

    def create_index(self, column: str | None = None, *, expression: Any = None, kind: str = "BUCKET", name: str | None = None):
        from granary.operators import indexes

        return indexes.create(self, column, expression=expression, kind=kind, name=name)

    def index(self, name: str):
        return self._indexes[name]

    def will_use_index(self, condition: Any) -> bool:
        """Whether ``where`` reads an index for this condition."""
        from granary.operators import indexes

        return indexes.plan(self, condition) is not None

    def explain(self, condition: Any) -> str:
        """The physical plan of ``where`` and the index that it reads."""
        from granary.operators import indexes

        return indexes.explain(self, condition)

    @property
    def indexes(self) -> list:
        return list(self._indexes.values())

    def drop_index(self, name: str) -> None:
        self._indexes.pop(name).drop()

    def rebuild_index(self, name: str):
        return self._indexes[name].rebuild()

    compact_index = rebuild_index


def _local_frame(spark: SparkSession, data: Any, schema: T.StructType, defaults: Mapping[str, Any]) -> DataFrame:
    """Rows given on the driver as a DataFrame with positions; sentinels become nulls."""
    names = schema.names
    if isinstance(data, pd.DataFrame):
        data = {c: data[c].tolist() for c in data.columns}
    if isinstance(data, np.ndarray) and data.dtype.names:
        data = {n: data[n].tolist() for n in data.dtype.names}
    if isinstance(data, Mapping):
        unknown = set(data) - set(names)
        if unknown:
            raise KeyError(sorted(unknown)[0])
        columns = {k: (v.tolist() if isinstance(v, np.ndarray) else list(v)) for k, v in data.items()}
        if len(set(map(len, columns.values()))) > 1:
            raise ValueError("columns have different lengths")
        size = len(next(iter(columns.values()), []))
        rows = [tuple(columns[n][i] if n in columns else defaults.get(n) for n in names) for i in range(size)]
    else:
        rows = []
        for row in data:
            if isinstance(row, Mapping):
                rows.append(tuple(row.get(n, defaults.get(n)) for n in names))
            elif isinstance(row, tuple | list | np.void):
                values = list(row)
                if len(values) > len(names):
                    raise ValueError("a row has too many values")
                rows.append(tuple(values + [defaults.get(n) for n in names[len(values) :]]))
            else:
                rows.append(tuple(getattr(row, n) for n in names))
    rows = [tuple(_plain(v, f) for v, f in zip(r, schema.fields, strict=True)) + (i,) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, T.StructType([*schema.fields, T.StructField(POS, T.LongType())]))
    stored = {f.name: S.spec_of(f) for f in schema.fields if "spec" in f.metadata}
    return df.select(
        *[
            stored[f.name].from_stored(F.col(quoted(f.name))).alias(f.name, metadata=f.metadata) if f.name in stored else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


def _plain(value: Any, f: T.StructField) -> Any:
    """A driver value in the form Spark takes for the field."""
    if hasattr(value, "tolist"):
        value = value.tolist() if getattr(value, "ndim", 0) < 2 else value.ravel().tolist()
    if isinstance(value, complex):
        return (value.real, value.imag)
    if isinstance(f.dataType, T.DoubleType | T.FloatType) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(f.dataType, T.ArrayType) and value is not None:
        return np.asarray(value).ravel().tolist() if f.metadata.get("shape") else list(value)
    return value


class Column:
    """A column of a table: an expression with aggregates over the table's rows."""

    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name

    @property
    def expr(self) -> Expr:
        return Expr(lambda schema: field(schema, self.name), self.name)

    @property
    def bound(self) -> Bound:
        return self.expr.bind(self.table.schema)

    @property
    def dtype(self) -> T.DataType:
        return self.table.df.select(self.bound.col.alias("v")).schema["v"].dataType

    def __getitem__(self, key: Any):
        if isinstance(key, tuple):
            return self.expr[key]
        if isinstance(key, int | np.integer):
            return self.table.select([self.name]).row(int(key))[0]
        return np.array([r[0] for r in self.table.select([self.name])[key].ordered_frame.collect()])

    def __setitem__(self, key: Any, value: Any) -> None:
        """Write cells by position, slice, positions, mask or predicate."""
        table = self.table
        table._writable()
        if self.name in table.computed:
            raise ReadOnlyError(f"{self.name!r} is computed")
        if isinstance(key, Expr | str):
            test, base = predicate(key, table.schema), table
        else:
            base, size = table.numbered(), len(table)
            if isinstance(key, int):
                key = [key + size if key < 0 else key]
            elif isinstance(key, slice):
                key = range(*key.indices(size))
            elif isinstance(key, np.ndarray) and key.dtype == bool:
                key = np.flatnonzero(key)
            many = isinstance(value, list | tuple | np.ndarray)
            if many or not isinstance(key, range):
                key = [int(k) for k in key]
                if key and (min(key) < 0 or max(key) >= size):
                    raise IndexError("a position is out of bounds")
                return self._assign_list(base, key, list(value) if many else [value] * len(key))
            test = _in_range(key)
        old = F.col(quoted(self.name))
        spec = table.schema[self.name]
        new = base.df.withColumn(self.name, F.when(test, F.lit(value).cast(spec.dataType)).otherwise(old))
        S.validate(new.filter(test).select(quoted(self.name)), T.StructType([spec]))
        table._rebind(new, base.dense)

    def _assign_list(self, base: Table, key: list[int], values: list) -> None:
        if len(values) != len(key):
            raise ValueError("one value per position is needed")
        spec = self.table.schema[self.name]
        rows = [(k, _plain(v, spec)) for k, v in zip(key, values, strict=True)]
        local = self.table.spark.createDataFrame(rows, T.StructType([T.StructField(POS, T.LongType()), T.StructField("__new", spec.dataType)]))
        S.validate(local.select(F.col("__new").alias(self.name)), T.StructType([spec]))
        joined = base.df.join(local.withColumn("__set", F.lit(True)), POS, "left")
        value = F.when(F.col("__set"), F.col("__new")).otherwise(F.col(quoted(self.name)))
        self.table._rebind(joined.withColumn(self.name, value).drop("__new", "__set"), base.dense)

    def assign(self, values: Any) -> None:
        """Write the whole column."""
        self[:] = list(values)

    def to_numpy(self) -> np.ndarray:
        return self[:]

    def __len__(self) -> int:
        return len(self.table)

    def take(self, positions: Sequence[int]) -> np.ndarray:
        return np.array([r[0] for r in self.table.select([self.name]).take(positions).ordered_frame.collect()])

    def chunk_frame(self, size: int) -> DataFrame:
        """``iter_chunks`` as a DataFrame: the number of each chunk and an array of its values in order, made by the executors."""
        if size < 1:
            raise ValueError("a chunk has one value at least")
        found = self.table.select([self.name]).numbered()
        chunk = ((F.col(POS) - F.col(POS) % size) / size).cast("long")
        cell = F.struct(F.col(POS).alias("at"), field(found.schema, self.name).col.alias("v"))
        cells = found.df.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        return cells.select("chunk", F.col("cells.v").alias("values"))

    def iter_chunks(self, size: int) -> Iterator[np.ndarray]:
        """The values in order, ``size`` at a time, on the driver; ``chunk_frame`` leaves them on the executors."""
        held = []
        for row in self.table.select([self.name]).ordered_frame.toLocalIterator():
            held.append(row[0])
            if len(held) == size:
                yield np.array(held)
                held = []
        if held:
            yield np.array(held)

    def _agg(self, value: SparkColumn, where: Any = None) -> Any:
        df = self.table.df
        if where is not None:
            df = df.filter(predicate(where.expr if isinstance(where, Column) else where, self.table.schema))
        return df.agg(value.alias("v")).first()[0]

    def _real(self, what: str) -> Bound:
        bound = self.bound
        if bound.kind not in ("bool", "int", "float", "decimal"):
            raise TypeError(f"{what} needs numbers: {self.name!r} is {bound.kind}")
        return Bound(bound.col.cast("long"), "int", True) if bound.kind == "bool" else bound

    def sum(self, where: Any = None):
        return self._agg(F.sum(self._real("sum").col), where) or 0

    def mean(self, where: Any = None) -> float:
        bound = self._real("mean")
        if where is None and not self.table.is_view and self.table.df.isEmpty():
            raise ValueError("mean of an empty table")
        found = self._agg(F.avg(bound.col), where)
        return NAN if found is None else float(found)

    def std(self, ddof: int = 0, where: Any = None) -> float:
        value = self._real("std").col.cast("double")
        n = F.count(value)
        spread = F.sqrt(F.var_pop(value) * n / F.when(n > ddof, n - ddof))
        found = self._agg(spread, where)
        return NAN if found is None else found

    def _ordered(self, what: str, value: Callable, where: Any):
        if self.bound.kind in ("complex", "array", "other"):
            raise TypeError(f"{what} needs ordered values: {self.name!r} is {self.bound.kind}")
        found = self._agg(value(self.bound.col), where)
        if found is None:
            raise ValueError(f"{what} of no values")
        return found

    def min(self, where: Any = None):
        return self._ordered("min", F.min, where)

    def max(self, where: Any = None):
        return self._ordered("max", F.max, where)

    def _position(self, op: str) -> int:
        from granary.operators.groupby import aggregate

        found = self.table.select([self.name]).numbered().df.agg(aggregate(self.bound, op, F.col(POS)).alias("p")).first()[0]
        if found < 0:
            raise ValueError(f"{op} of no values")
        return found

    def argmin(self) -> int:
        return self._position("argmin")

    def argmax(self) -> int:
        return self._position("argmax")

    def any(self) -> bool:
        return bool(self._agg(F.coalesce(F.bool_or(self._boolean("any")), F.lit(False))))

    def all(self) -> bool:
        return bool(self._agg(F.coalesce(F.bool_and(self._boolean("all")), F.lit(True))))

    def _boolean(self, what: str) -> SparkColumn:
        if self.bound.kind != "bool":
            raise TypeError(f"{what} needs booleans: {self.name!r} is {self.bound.kind}")
        return self.bound.col

    def unique_frame(self, name: str = "value") -> DataFrame:
        """The distinct values, nulls left out, as a DataFrame."""
        return self.table.df.select(self.bound.col.alias(name)).filter(F.col(quoted(name)).isNotNull()).distinct()

    def unique(self) -> np.ndarray:
        """The distinct values in order, on the driver; ``unique_frame`` has no bound on their number."""
        return np.array([r[0] for r in self.unique_frame("v").orderBy("v").collect()])

    def value_counts_frame(self, name: str = "value", count: str = "count") -> DataFrame:
        """The distinct values and how often each occurs, nulls left out, as a DataFrame."""
        values = self.table.df.select(self.bound.col.alias(name)).filter(F.col(quoted(name)).isNotNull())
        return values.groupBy(quoted(name)).agg(F.count(F.lit(1)).alias(count))

    def value_counts(self) -> dict:
        """Values and counts, the most frequent first, on the driver; ``value_counts_frame`` has no bound on their number."""
        return {r[0]: r[1] for r in self.value_counts_frame("v", "n").orderBy(F.desc("n"), "v").collect()}

    def null_count(self) -> int:
        return self._agg(F.count_if(self.bound.col.isNull()))

    def is_null(self) -> Expr:
        return self.expr.is_null()

    def notnull(self) -> Expr:
        return self.expr.notnull()

    def fillna(self, value: Any) -> Expr:
        return self.expr.fillna(value)

    def isin(self, values: Any) -> Expr:
        return self.expr.isin(values)

    @property
    def row_transformer(self):
        from granary.operators.rows import RowTransformer

        return RowTransformer(self)

    def axis_reduce(self, op: str, axis: int | None = 0):
        """Reduce an array column over rows (axis 0, an array) or over everything (axis None)."""
        from granary.operators.rows import reduce_column

        return reduce_column(self, op, axis)


def _forward(name: str) -> None:
    method = getattr(Expr, name)
    setattr(Column, name, lambda self, *others: method(self.expr, *[o.expr if isinstance(o, Column) else o for o in others]))


for _name in (
    "add radd sub rsub mul rmul truediv rtruediv floordiv rfloordiv mod rmod pow rpow "
    "eq ne lt le gt ge and rand or ror xor rxor invert neg pos"
).split():
    _forward(f"__{_name}__")
Column.__hash__ = object.__hash__


class NestedColumn:
    """The leaves below a dotted prefix; read-only."""

    def __init__(self, table: Table, name: str, leaves: list[str]):
        self.table, self.name, self.leaves = table, name, leaves

    def __getattr__(self, part: str):
        if part.startswith("_"):
            raise AttributeError(part)
        return self.table[f"{self.name}.{part}"]

    def to_table(self) -> Table:
        return self.table.select(self.leaves)


def concat(tables: Sequence[Table]) -> Table:
    """Rows of all tables, one after the other."""
    parts = []
    for i, t in enumerate(tables):
        parts.append(t.numbered().df.withColumn("__table", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    packed = out.withColumn(POS, F.struct(F.col("__table"), F.col(POS))).drop("__table")
    return Table(packed)


def minmax_buckets(table: Table, column: str, buckets: int) -> DataFrame:
    """The envelope of a series: bucket, position range, min and max of each of ``buckets`` equal stretches."""
    found, size = table.numbered(), len(table)
    value = field(found.schema, column).col
    bucket = F.floor(F.col(POS) * buckets / F.lit(max(1, size))).cast("int")
    return (
        found.df.groupBy(bucket.alias("bucket"))
        .agg(F.min(POS).alias("start"), F.max(POS).alias("stop"), F.min(value).alias("min"), F.max(value).alias("max"))
        .orderBy("bucket")
    )


__all__ = ["Column", "NestedColumn", "ReadOnlyError", "Table", "concat", "dense_positions", "minmax_buckets"]
