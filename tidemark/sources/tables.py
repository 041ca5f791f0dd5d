"""Readers for corpora, facts and training chunks, and writers for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordinals import with_position
from tidemark.operators.skew import fits_broadcast

TEXT = "text string"
PAIR = "input string, output string"
FACTS = "subject string, relation string, object string"

# Quoted fields may hold line breaks; a doubled quote stands for one quote.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, a task per file at most; ``csv_splits.split_csv`` reads large files with line breaks by many."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that ``read_csv`` reads back unchanged; missing folders are created."""
    df.write.mode(mode).options(
        header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str, partition_by: list[str] = ()) -> DataFrame:
    """Rewrite CSV once, so that later scans read only the columns they need. Large files are read by many tasks."""
    from tidemark.sources.csv_splits import split_csv

    split_csv(spark, source, schema).write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return spark.read.parquet(target)


def csv_positions(spark: SparkSession, source: str, target: str, schema: str, name: str = "position") -> DataFrame:
    """CSV rewritten as Parquet, with the zero-based position of each row: files by name, rows as they lie.

    Spark packs files into tasks by size, so the place of a row in the copy says nothing about its file. The copy keeps the name of the
    file and the number of the task's row; within a file that number rises. Ranks come from one sorted copy and
    counts per partition, never from one task.
    """
    rows = read_csv(spark, source, schema)
    columns = rows.columns
    rows = rows.select(
        "*", F.col("_metadata.file_path").alias("_csv_file"), F.col("_metadata.file_block_start").alias("_csv_block"),
        F.monotonically_increasing_id().alias("_csv_row"),
    )
    rows.write.mode("overwrite").parquet(target)
    placed = with_position(spark.read.parquet(target), ["_csv_file", "_csv_block", "_csv_row"], name=name)
    return placed.select(*columns, name)


def spread(corpus: DataFrame, key: str | None = None) -> DataFrame:
    """Texts spread over the cores when they lie in fewer splits than that.

    Work on text is heavy, and a small file is one split and so one task. A large corpus has more splits
    than cores and stays as it lies, without a shuffle.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    if corpus.rdd.getNumPartitions() >= cores:
        return corpus
    return corpus.repartition(cores, key) if key else corpus.repartition(cores)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Save ``df`` as a table bucketed and sorted by ``keys``, so that joins on them do not shuffle it again.

    Take enough buckets for one to fit a task: 100 TB in 200,000 buckets are 0.5 GB each.
    """
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_snapshot(pages: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Save a snapshot bucketed by page: two of them with the same buckets are compared without a shuffle."""
    return write_bucketed(pages, table, path, [key], buckets)


def chunk_schema(family: str) -> str:
    """Schema of a training chunk for a model family."""
    return TEXT if family == "GPT2" else PAIR


def read_chunks(spark: SparkSession, folder: str, family: str, folders: bool = False) -> DataFrame:
    """All chunk files of a folder with ``chunk_no``, their order by file name.

    With ``folders`` a chunk is a folder of files, which as many tasks read, and folders are numbered by name. The names are counted, not
    the rows: the ranking runs over one row per chunk.
    """
    schema = chunk_schema(family)
    name = lambda: F.regexp_replace("_metadata.file_path", "/[^/]*$", "") if folders else F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").load(folder).select(name().alias("_path")).distinct().withColumn(
        "chunk_no", F.row_number().over(W.orderBy("_path")) - 1)
    rows = read_csv(spark, folder, schema).withColumn("_path", name())
    if fits_broadcast(files):
        files = F.broadcast(files)
    return rows.join(files, "_path").drop("_path")


def write_result(df: DataFrame, path: str, append: bool = False) -> None:
    """Result rows as CSV; overwrite or append."""
    write_csv(df, path, "append" if append else "overwrite")


METRICS = "run_id string, split string, step long, metric string, value double"


def metric_rows(df: DataFrame, run_id: Column, split: Column, step: Column, metrics: list[str]) -> DataFrame:
    """Wide metrics as ``run_id, split, step, metric, value`` rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(
        run_id.cast("string").alias("run_id"), split.cast("string").alias("split"),
        step.cast("long").alias("step"), F.explode(pairs).alias("_m"),
    )
    return rows.select("run_id", "split", "step", "_m.metric", "_m.value")


def log_metrics(rows: DataFrame, path: str) -> None:
    """Append metric rows to the metric table, kept apart by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def metric_report(log: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run, split and step with a column per metric."""
    return log.groupBy("run_id", "split", "step").pivot("metric", metrics).agg(F.first("value"))
