"""Grouped aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.expr import NAN, Bound, field, quoted

if TYPE_CHECKING:
    from granary.operators.table import Column as TableColumn
    from granary.operators.table import Table

OPERATIONS = ("size", "count", "sum", "mean", "min", "max", "argmin", "argmax")


def _key(bound: Bound) -> Column:
    """NaN keys are missing keys."""
    return F.when(~F.isnan(bound.col), bound.col) if bound.kind == "float" else bound.col


class GroupBy:
    """Deferred groups of a table; every method gives a table with a row per group.

    sort: True or None orders the result by key, the null group first; False
    leaves it unordered. dropna drops groups with a null or NaN key.
    """

    def __init__(self, table: Table, keys: str | Sequence[str], *, sort: bool | None = None, dropna: bool = True, engine: str = "auto"):
        if engine == "jit":
            raise NotImplementedError("there is no jit engine")
        self.table = table
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        if not self.keys:
            raise ValueError("group by at least one column")
        self.sort, self.dropna = sort, dropna
        for name in self.keys:
            bound = field(table.schema, name)
            if bound.kind in ("array", "complex", "other"):
                raise TypeError(f"cannot group by {name!r}: {bound.kind}")
            if name in table.computed:
                raise TypeError(f"cannot group by the computed column {name!r}")

    def size(self) -> Table:
        return self.agg([("*", "size")])

    def count(self, column: str) -> Table:
        return self.agg([(column, "count")])

    def sum(self, column: str) -> Table:
        return self.agg([(column, "sum")])

    def mean(self, column: str) -> Table:
        return self.agg([(column, "mean")])

    def min(self, column: str) -> Table:
        return self.agg([(column, "min")])

    def max(self, column: str) -> Table:
        return self.agg([(column, "max")])

    def argmin(self, column: str) -> Table:
        return self.agg([(column, "argmin")])

    def argmax(self, column: str) -> Table:
        return self.agg([(column, "argmax")])

    def agg(self, aggregations: Any = None, **named: Any) -> Table:
        """Aggregations as {column: op or ops}, [(column, op), ...], or name=(column, op).

        ``("*", "size")`` counts rows. A named op may be a function of a NumPy
        array with the group's values that are not null; it is not called for
        groups without any.
        """
        from granary.operators.table import Table

        wanted = self._wanted(aggregations, named)
        names = [name for name, _, _ in wanted] + self.keys
        if len(set(names)) < len(names):
            raise ValueError("two result columns have the same name")
        df = self.table.df
        if any(op in ("argmin", "argmax") for _, _, op in wanted):
            df = self.table.numbered().df
        key_names = [f"__key{i}" for i in range(len(self.keys))]
        schema = self.table.schema
        df = df.withColumns({k: _key(field(schema, n)) for k, n in zip(key_names, self.keys, strict=True)})
        if self.dropna:
            for k in key_names:
                df = df.filter(F.col(k).isNotNull())
        builtin = [w for w in wanted if not callable(w[2])]
        custom = [w for w in wanted if callable(w[2])]
        groups = df.groupBy(*key_names)
        out = groups.agg(*[self._column(c, op).alias(quoted_free(name)) for name, c, op in builtin]) if builtin else df.select(*key_names).distinct()
        for name, column, function in custom:
            out = self._with_custom(out, df, key_names, name, column, function)
        shown = []
        for k, name in zip(key_names, self.keys, strict=True):
            value = F.col(k)
            known = next((f for f in schema.fields if f.name == name), None)
            if known is not None and isinstance(known.dataType, T.FloatType | T.DoubleType) and not self.dropna:
                spec = known.metadata.get("spec", "")
                if "null_storage" not in spec and '"nullable": true' not in spec:
                    value = F.coalesce(value, F.lit(NAN).cast(known.dataType))
            shown.append(value.alias(name))
        order = [F.col(k).asc_nulls_first() for k in key_names] if self.sort is not False else []
        if order:
            out = out.orderBy(*order)
        result = out.select(*shown, *[F.col(quoted(quoted_free(name))).alias(name) for name, _, _ in wanted])
        return Table.from_frame(result, ordered_by=[F.col(quoted(k)).asc_nulls_first() for k in self.keys] if order else None)

    def _wanted(self, aggregations: Any, named: Mapping[str, Any]) -> list[tuple[str, str, Any]]:
        pairs: list[tuple[str, Any]] = []
        if isinstance(aggregations, Mapping):
            for column, ops in aggregations.items():
                pairs += [(column, op) for op in ([ops] if isinstance(ops, str) or callable(ops) else ops)]
        elif aggregations is not None:
            pairs = [tuple(p) for p in aggregations]
        wanted = []
        for column, op in pairs:
            if callable(op):
                raise TypeError("a function needs a result name: agg(name=(column, function))")
            wanted.append(("size" if column == "*" else f"{column}_{op}", column, op))
        wanted += [(name, column, op) for name, (column, op) in named.items()]
        if not wanted:
            raise ValueError("nothing to aggregate")
        for _, column, op in wanted:
            if not callable(op) and op not in OPERATIONS:
                raise ValueError(f"unknown aggregation {op!r}")
            if (column == "*") != (op == "size"):
                raise ValueError("'*' goes with size, and size with '*'")
            if column != "*":
                kind = field(self.table.schema, column).kind
                if op in ("sum", "mean") and kind not in ("bool", "int", "float", "decimal"):
                    raise TypeError(f"{op} needs numbers: {column!r} is {kind}")
                if op in ("min", "max", "argmin", "argmax") and kind in ("complex", "array", "other"):
                    raise TypeError(f"{op} needs ordered values: {column!r} is {kind}")
        return wanted

    def _column(self, name: str, op: str) -> Column:
        if op == "size":
            return F.count(F.lit(1))
        bound = field(self.table.schema, name)
        return aggregate(bound, op, F.col("__pos"))

    def _with_custom(self, out: DataFrame, df: DataFrame, keys: list[str], name: str, column: str, function: Callable) -> DataFrame:
        bound = field(self.table.schema, column)
        values = df.select(*keys, bound.col.alias("__value")).filter("__value is not null")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            try:
                result = function(pdf["__value"].to_numpy())
            except Exception as error:
                key = tuple(pdf[k].iloc[0] for k in keys)
                raise ValueError(f"{name} failed for group {key}: {error}") from error
            row = {k: [pdf[k].iloc[0]] for k in keys}
            return pd.DataFrame(row | {"__custom": [None if result is None else float(result)]})

        types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
        made = values.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in keys) + ", __custom double")
        made = made.select(*[F.col(k).alias(f"{k}_c") for k in keys], F.col("__custom").alias(quoted_free(name)))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"{k}_c"))
        return out.join(made, match, "left").drop(*[f"{k}_c" for k in keys])


def quoted_free(name: str) -> str:
    """A result name that clashes with no hidden name while groups are built."""
    return f"__out_{name}"


def aggregate(bound: Bound, op: str, position: Column) -> Column:
    """One aggregate with the result types and empty-group values of this library."""
    value = bound.col.cast("long") if bound.kind == "bool" and op in ("sum", "mean", "min", "max") else bound.col
    if op == "count":
        return F.count(value)
    if op == "sum":
        if bound.kind == "float":
            return F.coalesce(F.sum(value.cast("double")), F.lit(NAN))
        return F.sum(value)
    if op == "mean":
        return F.coalesce(F.avg(value.cast("double")), F.lit(NAN))
    if op == "min":
        return F.min(bound.col)
    if op == "max":
        return F.max(bound.col)
    least = F.min(F.when(bound.col.isNotNull(), F.struct(bound.col.alias("v"), position.alias("p"))))
    if op == "argmin":
        return F.coalesce(least["p"], F.lit(-1).cast("long"))
    greatest = F.max(F.when(bound.col.isNotNull(), F.struct(bound.col.alias("v"), (-position).alias("p"))))
    return F.coalesce(-greatest["p"], F.lit(-1).cast("long"))


#: Operations that reduce arrays or columns by key.
REDUCTIONS = ("size", "count", "sum", "mean", "min", "max")


def group_reduce(spark: SparkSession, keys: Any, values: Any = None, op: str = "size", *, sort: bool | None = None, dropna: bool = True) -> pd.DataFrame:
    """Reduce arrays that the driver holds by key: a frame of (key, value). NaN values are skipped; NaN keys come last if kept."""
    data = {"key": np.asarray(keys)}
    if values is not None:
        data["value"] = np.asarray(values)
    grouped = _reduced(spark.createDataFrame(pd.DataFrame(data)), op, dropna)
    if sort is not False:
        grouped = grouped.orderBy(F.col("key").asc_nulls_last())
    return grouped.toPandas()


def reduce_columns(keys: TableColumn, values: TableColumn | None = None, op: str = "size", *, dropna: bool = True) -> DataFrame:
    """``group_reduce`` of columns of one table: a DataFrame of (key, value), in no order, of which nothing goes through the driver."""
    if values is not None and values.table is not keys.table:
        raise ValueError("keys and values are columns of one table")
    named = [keys.bound.col.alias("key")] + ([] if values is None else [values.bound.col.alias("value")])
    return _reduced(keys.table.df.select(*named), op, dropna)


def _reduced(df: DataFrame, op: str, dropna: bool) -> DataFrame:
    if op not in REDUCTIONS:
        raise ValueError(f"unknown aggregation {op!r}")
    bound = field(df.schema, "key")
    df = df.withColumn("key", _key(bound))
    if dropna:
        df = df.filter("key is not null")
    if op == "size":
        out = F.count(F.lit(1))
    else:
        value = field(df.schema, "value")
        clean = F.when(~F.isnan(value.col), value.col) if value.kind == "float" else value.col
        out = aggregate(Bound(clean, value.kind), op, F.lit(0))
    return df.groupBy("key").agg(out.alias("value"))
