"""Perplexity of runs that are still going on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import exists, remove, rename


def live_perplexity(losses: DataFrame, by: list[str]) -> DataFrame:
    """Perplexity over all batches so far. ``losses`` is a stream with one row per batch and its ``loss``.

    The state is two numbers per group, whatever the length of the stream.
    """
    sums = losses.groupBy(*by).agg(F.sum("loss").alias("loss_sum"), F.count("loss").alias("batches"))
    return sums.select(*by, "batches", F.exp(F.col("loss_sum") / F.col("batches")).alias("ppl"))


KEPT = 10  # finished versions that stay for readers still at work


def publish(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the current value of each group as one version per micro-batch; stops when all input is read.

    A version is written aside and appears under its number when it is complete; it is never changed after that, also when its micro-batch
    runs again. Only the newest ``KEPT`` versions stay.
    """

    def replace(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, f"{path}/version={number}"
        if not exists(spark, version):
            batch.write.mode("overwrite").parquet(f"{path}/_building-{number}")
            rename(spark, f"{path}/_building-{number}", version)
        remove(spark, f"{path}/version={number - KEPT}")

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a published table."""
    versions = spark.read.parquet(path)
    newest = versions.agg({"version": "max"}).first()[0]  # one number
    return versions.filter(versions["version"] == newest).drop("version")
