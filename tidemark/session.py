"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skew split may add a shuffle before a following groupBy; that is cheaper than one hot task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


TASK_BYTES = 256 * 1024 * 1024  # what one task should read


def sizing(input_bytes: int) -> dict[str, str]:
    """Partition settings for an input of this size: 100 TB shuffle as about 400,000 partitions.

    The count is an upper bound; adaptive execution joins partitions that turn out small.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, -(-input_bytes // TASK_BYTES))),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    }


def build_session(
    app: str = "tidemark", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with the engine's defaults, sized for ``input_bytes``; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(sizing(input_bytes) if input_bytes else {})}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts fit beside the executor's heap; one row is never cut."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))


def join_in_place(spark: SparkSession) -> None:
    """Let joins of this session take rows as they lie when both sides are dealt alike by some of their keys, instead of shuffling them by all."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


_local_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may run without it and then gets a new temporary folder. A cluster session
    without it is an error, because a folder on one machine would be lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_scratch[app]


def new_path(spark: SparkSession, label: str) -> str:
    """Unused path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path and the file system that holds it, whichever that is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a written folder its final name, which nothing has yet."""
    place, system = _at(spark, source)
    if not system.rename(place, _at(spark, target)[0]):
        raise OSError(f"cannot rename {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, if it is there."""
    place, system = _at(spark, path)
    system.delete(place, True)


SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written."""
    before = spark.conf.get(SHORT_SHUFFLES)
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHORT_SHUFFLES, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later jobs column pruning and real
    size statistics. Used where a result is read more than once and must be the same each time. The shuffles
    that made it are not read again, so their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with short_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table of :func:`materialize` that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        remove(table.sparkSession, folder)
