"""Following a folder that one writer appends to, and windowed aggregates over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.table import Table
from granary.sources import tabular


class Follower:
    """A reader of a growing table: refresh() shows what has been appended since."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = tabular.read_parquet(spark, path)

    def refresh(self) -> Table:
        self.spark.catalog.refreshByPath(self.path)
        self.table = tabular.read_parquet(self.spark, self.path)
        return self.table


def follow(spark: SparkSession, path: str, schema: T.StructType, sink: str, checkpoint: str) -> int:
    """Copy what is new at path to sink, once each, and return the rows of sink. Run it again for more."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(sink).count()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Rows and sum of value by window and event_type; streaming input drops rows later than ``late``."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    grouped = events.groupBy(F.window(time, every).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")
    )
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "events", "total")
