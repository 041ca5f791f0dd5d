"""Training that follows a folder of text chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import ngrams
from tidemark.sources.tables import CSV_OPTIONS, spread


def chunk_stream(spark: SparkSession, folder: str, schema: str, files_per_step: int = 1) -> DataFrame:
    """Stream of chunk files, oldest first, ``files_per_step`` in each micro-batch."""
    return (
        spark.readStream.schema(schema).options(**CSV_OPTIONS).option("maxFilesPerTrigger", files_per_step).csv(folder)
    )


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, one call of ``step`` per micro-batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def train_on_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the counts of each micro-batch as one step of the model in ``folder``.

    A step costs as much as its chunk, however large the model is. It depends on its micro-batch only and
    overwrites itself, so a micro-batch that is run again after a failure changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        ngrams.train(spread(batch)).write.mode("overwrite").parquet(f"{folder}/step={number}")

    return run_available(stream, step, checkpoint)


def streamed_model(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The model after all steps, or after step ``upto``."""
    steps = spark.read.schema("prev string, token string, n long, step int").parquet(folder)
    if upto is not None:
        steps = steps.filter(F.col("step") <= upto)
    return ngrams.merge(steps.drop("step"))
