"""Arrow batches of bounded size for operators on long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = 1_000  # rows handed to Python at once
BYTES = 16 * 1024 * 1024  # and bytes, where the engine can bound them; one row is never cut


def bound(spark: SparkSession) -> None:
    """Bound the batches of this session: a batch of long texts must fit beside the executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` on bounded batches."""
    bound(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of a column, nulls as empty."""
    return [t or "" for t in column.to_pylist()]


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


Batches = Iterator[pa.RecordBatch]
