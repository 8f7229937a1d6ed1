"""Reductions of fixed-shape array columns, within rows and over rows."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from granary.expr import NAN, Bound, Expr, field

if TYPE_CHECKING:
    from granary.operators.table import Column

OPERATIONS = ("sum", "mean", "min", "max", "argmin", "argmax", "norm")


def reduce_array(values: SparkColumn, op: str) -> SparkColumn:
    """One number from the elements of an array; null for a null array."""
    if op == "sum":
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    if op == "mean":
        return F.when(F.size(values) > 0, reduce_array(values, "sum") / F.size(values)).when(values.isNotNull(), F.lit(NAN))
    if op == "min":
        return F.array_min(values)
    if op == "max":
        return F.array_max(values)
    if op == "norm":
        return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    if op == "argmin":
        return F.array_position(values, F.array_min(values)) - 1
    if op == "argmax":
        return F.array_position(values, F.array_max(values)) - 1
    raise ValueError(f"unknown reduction {op!r}")


def dot(a: SparkColumn, b: SparkColumn) -> SparkColumn:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class RowTransformer:
    """Row-wise results of an array column, as expressions for computed or generated columns."""

    def __init__(self, column: Column):
        self.column = column

    def _make(self, op: str) -> Expr:
        name = self.column.name

        def bind(schema) -> Bound:
            bound = field(schema, name)
            kind = "int" if op.startswith("arg") else "float"
            return Bound(reduce_array(bound.col, op), kind, kind == "int")

        return Expr(bind, f"{op}({name})")

    def __getattr__(self, op: str):
        if op not in OPERATIONS:
            raise AttributeError(op)
        return lambda axis=0: self._make(op)

    def __getitem__(self, key: Any) -> Expr:
        return self.column.expr[key]


def reduce_column(column: Column, op: str, axis: int | None = 0):
    """Over rows for every element (axis 0), over everything (axis None), or within rows (axis 1)."""
    table, values = column.table, column.bound.col
    if axis == 1:
        found = table._derived(table.df.withColumn("__r", reduce_array(values, op)))
        return np.array([r[0] for r in found.df.orderBy(*found.order).select("__r").collect()])
    items = table.df.select(F.posexplode(values).alias("i", "v"))
    stat = {
        "sum": F.sum("v"), "mean": F.avg("v"), "min": F.min("v"), "max": F.max("v"),
        "norm": F.sqrt(F.sum(F.col("v").cast("double") * F.col("v"))),
    }
    if op not in stat:
        raise ValueError(f"unknown reduction over rows {op!r}")
    if axis is None:
        return items.agg(stat[op].alias("r")).first()[0]
    out = np.array([r.r for r in items.groupBy("i").agg(stat[op].alias("r")).orderBy("i").collect()])
    shape = next((f.metadata.get("shape") for f in table.schema.fields if f.name == column.name), None)
    return out.reshape(shape) if shape and math.prod(shape) == len(out) else out


__all__ = ["RowTransformer", "dot", "reduce_array", "reduce_column"]
