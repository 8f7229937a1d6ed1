"""Dictionary encoding of string columns: codes and the values that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.expr import quoted
from granary.operators.table import Table, dense_positions

#: The code of null.
NULL_CODE = -1


def factorize(table: Table, column: str) -> DataFrame:
    """(code, value) of the distinct values that are not null, coded 0, 1, ... in the order of their UTF-8 bytes."""
    values = table.df.select(F.col(quoted(column)).alias("value")).filter("value is not null").distinct()
    return dense_positions(values, [F.col("value")], "code").select(F.col("code").cast("int").alias("code"), "value")


def encode(table: Table, column: str, codes: DataFrame | None = None, name: str | None = None) -> Table:
    """A view with a column of codes (``<column>_code`` by default); null has NULL_CODE, as have values without a code.

    Equal values are looked up by a join; Spark broadcasts the codes if they
    are small and splits frequent values if they are not.
    """
    codes = factorize(table, column) if codes is None else codes
    name = name or f"{column}_code"
    lookup = codes.select(F.col("code").alias(name), F.col("value").alias("__value"))
    joined = table.df.join(lookup, F.col(quoted(column)) == F.col("__value"), "left").drop("__value")
    return table._derived(joined.withColumn(name, F.coalesce(F.col(quoted(name)), F.lit(NULL_CODE))), dense=table.dense)


def decode(table: Table, column: str, codes: DataFrame, name: str) -> Table:
    """A view with the values of a column of codes; NULL_CODE and unknown codes give null."""
    lookup = codes.select(F.col("code").alias("__code"), F.col("value").alias(name))
    joined = table.df.join(lookup, F.col(quoted(column)) == F.col("__code"), "left").drop("__code")
    return table._derived(joined, dense=table.dense)


def from_utf8(table: Table, column: str, max_length: int) -> Table:
    """A view with a string column cut to max_length code points."""
    cut = F.substring(F.col(quoted(column)), 1, max_length)
    return table._derived(table.df.withColumn(column, cut), dense=table.dense)


def ranks(table: Table, column: str, name: str = "rank") -> Table:
    """A view with the alphabetical rank of each value, equal values alike, nulls null."""
    encoded = encode(table, column, name=name)
    return table._derived(encoded.df.withColumn(name, F.when(F.col(name) != NULL_CODE, F.col(name))), dense=table.dense)
