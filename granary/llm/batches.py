"""Running Python over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Bytes of rows that go to a Python worker at once; a single longer row goes alone.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2000


def bound_batches(df: DataFrame) -> None:
    """Keep Arrow batches of this session within BATCH_BYTES and BATCH_ROWS."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(
    df: DataFrame, schema: str, start: Callable[[], Callable[[dict | None], Iterator[dict]]]
) -> DataFrame:
    """Apply Python to batches of df given as {column: list}.

    ``start`` runs once per task and returns a step. The step gets each batch,
    and None after the last, and yields batches of the result.
    """
    bound_batches(df)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for out in step(batch.to_pydict()):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        for out in step(None):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)
