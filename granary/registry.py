"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.table import Table
from granary.sources import tabular

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL of the same result."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def registered_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return tabular.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def ordered(spark: SparkSession, sf_dir: str, name: str, key: str) -> Table:
    """A table whose order is that of a key."""
    return Table.from_frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), ordered_by=[F.col(key)])


def one_row(spark: SparkSession, **values: Any) -> DataFrame:
    """Results that are numbers on the driver, as a frame of one row."""
    return spark.createDataFrame([tuple(values.values())], list(values))
