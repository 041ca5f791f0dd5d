"""CSV files with quoted line breaks, read by as many tasks as they have splits.

A line break ends a record where the number of quotes before it is even. A split knows only the quotes in itself, so a first pass counts
them by split, and running totals over the splits of a file tell how each one begins. A second pass puts the lines of every split
together to records; what is cut at the borders of splits is put together last. Parsing stays with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordinals import with_position
from tidemark.operators.skew import fits_broadcast
from tidemark.session import TASK_BYTES, materialize

WHOLE, HEAD, MIDDLE, TAIL = range(4)  # a record; the end of one begun in an earlier split; a split within one; the beginning of one
BATCH_ROWS = 10_000
SPLITS = 2_000  # read by one task at most, however small they are


@contextmanager
def _split_bytes(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Splits of at most ``size`` bytes while jobs run."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    if size:
        names |= {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(min(size, 4 << 20))}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in file order within their splits, told apart by file and first byte of the split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _together(lines: DataFrame, size: int) -> DataFrame:
    """Lines of splits of ``size`` bytes, read by tasks that take several small ones, one after the other: a task and a file
    for each would cost more than what is in them. At least four tasks for each core stay."""
    splits = lines.rdd.getNumPartitions()
    each = min(max(1, TASK_BYTES // 8 // size), SPLITS)
    tasks = max(-(-splits // each), 4 * lines.sparkSession.sparkContext.defaultParallelism)
    return lines.coalesce(tasks) if tasks < splits else lines


def split_starts(lines: DataFrame) -> DataFrame:
    """``_file, _block, _inside``: whether a split begins inside quotes. One row per split, whatever the number of lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("_file", "_block").agg(F.sum(quotes).alias("_quotes"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return counted.select("_file", "_block", (F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2 == 1).alias("_inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, to records and what is cut off at the borders. Only the open record of the current split is held."""
    names = ["_file", "_block", "_seq", "_kind", "record"]
    now, inside, opened, seq, held = None, False, False, 0, []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            kind = MIDDLE if opened else TAIL
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([kind], pa.int32()),
                 pa.array(["\n".join(held)], pa.string())], names=names)

    for rows in batches:
        if not len(rows):
            continue
        value, files, blocks, begins = rows.columns
        other = [pc.not_equal(c.slice(1), c.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False) for c in (files, blocks)]
        cuts = [0, *(np.flatnonzero(other[0] | other[1]) + 1).tolist(), len(rows)]
        for low, high in zip(cuts, cuts[1:]):
            here = files[low].as_py(), blocks[low].as_py()
            if now != here:
                yield from close()
                now, inside, opened, seq, held = here, begins[low].as_py(), begins[low].as_py(), 0, []
            lines = value.slice(low, high - low)
            odd = np.asarray(pc.count_substring(lines, '"')) & 1
            after = (np.cumsum(odd) + inside) % 2
            inside = bool(after[-1])
            ends = np.flatnonzero(after == 0) + 1
            if not len(ends):
                held += lines.to_pylist()
                continue
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, lines.slice(0, int(ends[-1])).cast(pa.string()))
            joined = pc.binary_join(lists, "\n")
            if held:
                first = pa.array(["\n".join([*held, joined[0].as_py()])], pa.string())
                joined = pa.concat_arrays([first, joined.slice(1)])
            kinds = np.full(len(joined), WHOLE, np.int32)
            kinds[0] = HEAD if opened else WHOLE
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(joined), pa.string()), pa.array(np.full(len(joined), now[1]), pa.int64()),
                 pa.array(np.arange(seq, seq + len(joined)), pa.int64()), pa.array(kinds), joined], names=names)
            seq, opened, held = seq + len(joined), False, lines.slice(int(ends[-1])).to_pylist()
    yield from close()


def csv_records(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """``_file, _block, _seq, record``: every record of CSV files as text, headers included; its order in the file is that of the numbers."""
    with _split_bytes(spark, split_bytes):
        lines = _together(_lines(spark, path), split_bytes) if split_bytes else _lines(spark, path)
        starts = materialize(split_starts(lines), "split-starts")
        if fits_broadcast(starts):  # the lines stay where and as they are read
            placed = lines.join(F.broadcast(starts), ["_file", "_block"])
        else:
            placed = lines.withColumn("_line", F.monotonically_increasing_id()).join(starts, ["_file", "_block"])
            placed = placed.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_line")
        placed = placed.select("value", "_file", "_block", "_inside")
        found = materialize(placed.mapInArrow(_records, "_file string, _block long, _seq long, _kind int, record string"), "csv-records")
    # Two pieces of a split at most: a chain of them begins at every tail and ends at the next head.
    pieces = found.filter(F.col("_kind") != WHOLE)
    order = W.partitionBy("_file").orderBy("_block", "_seq")
    chains = pieces.select("_file", "_block", "_seq", F.sum((F.col("_kind") == TAIL).cast("long")).over(order).alias("_chain"))
    linked = pieces.join(F.broadcast(chains) if fits_broadcast(chains) else chains, ["_file", "_block", "_seq"])
    whole = linked.groupBy("_file", "_chain").agg(F.array_sort(F.collect_list(F.struct("_block", "_seq", "record"))).alias("_all"))
    whole = whole.select("_file", F.get("_all", F.lit(0))["_block"].alias("_block"), F.get("_all", F.lit(0))["_seq"].alias("_seq"),
                         F.array_join(F.col("_all.record"), "\n").alias("record"))
    return found.filter(F.col("_kind") == WHOLE).select("_file", "_block", "_seq", "record").unionByName(whole)


def split_csv(
    spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None, *,
    position: str | None = None, split_bytes: int | None = None,
) -> DataFrame:
    """The rows of ``read_csv``, of files that many tasks read together; ``position`` adds the place of each row, files by name.

    Every file has a header. Quotes stand around fields, or doubled inside quoted ones. Lines end with a line feed, or a carriage return and
    one. Empty lines are no rows. ``split_bytes`` splits harder than the session does.
    """
    from tidemark.sources.tables import CSV_OPTIONS

    records = csv_records(spark, path, split_bytes).withColumn("record", F.regexp_replace("record", "\r$", ""))
    records = records.filter(((F.col("_block") > 0) | (F.col("_seq") > 0)) & (F.col("record") != ""))
    options = {k: str(v) for k, v in CSV_OPTIONS.items() if k != "header"}
    keys = ["_file", "_block", "_seq"]
    rows = records.select(*keys, F.from_csv("record", schema, options).alias("_row"))
    names = columns or [f.name for f in rows.schema["_row"].dataType.fields]
    wanted = [F.col("_row")[c].alias(c) for c in names]
    if position is None:
        return rows.select(*wanted)
    return with_position(rows, keys, name=position).select(*wanted, position)
