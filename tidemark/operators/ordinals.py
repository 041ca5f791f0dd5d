"""Row positions, batch ids and running sums without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize

PREFIX_DIGITS = 4  # 16 ** 4 buckets of a hexadecimal hash


def _before(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def with_position(df: DataFrame, order: list[str], group: list[str] = (), name: str = "position") -> DataFrame:
    """Add the zero-based rank of each row in ``order``, within ``group`` when given.

    The rows are range partitioned and sorted once and written down, so that the counts per
    partition and the rows themselves come from the same partitioning. The counts (one row per
    partition, or per partition and group) give each partition its start. A group may span any number of
    partitions. ``order`` must be unique within ``group``.
    """
    group = list(group)
    keys = [*group, *order]
    # The slot holds the partition in its upper bits and the row number in its lower 33 bits.
    placed = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_pos_slot", F.monotonically_increasing_id())
        .withColumn("_pos_part", F.shiftright("_pos_slot", 33))
    )
    placed = materialize(placed, "positions")
    runs = placed.groupBy("_pos_part", *group).agg(F.count("*").alias("_pos_rows"), F.min("_pos_slot").alias("_pos_first"))
    before = _before(W.partitionBy(*group).orderBy("_pos_part"))
    starts = runs.select(
        "_pos_part", *[F.col(g).alias(f"_pos_g{i}") for i, g in enumerate(group)], "_pos_first",
        F.coalesce(F.sum("_pos_rows").over(before), F.lit(0)).alias("_pos_start"),
    )
    if not group:
        starts = F.broadcast(starts)  # one row per partition
    match = placed["_pos_part"] == starts["_pos_part"]
    for i, g in enumerate(group):
        match = match & placed[g].eqNullSafe(starts[f"_pos_g{i}"])
    return placed.join(starts, match).select(
        *[placed[c] for c in df.columns],
        (F.col("_pos_start") + F.col("_pos_slot") - F.col("_pos_first")).alias(name),
    )


def with_file_position(table: DataFrame, name: str = "position") -> DataFrame:
    """Add the zero-based position of each row of a Parquet table in the order of file names and rows.

    ``table`` is a plain scan. The row number inside a file comes with the scan; one row per file
    tells how many rows lie before it. Nothing is shuffled or written.
    """
    rows = table.select("*", F.col("_metadata.file_path").alias("_pos_file"), F.col("_metadata.row_index").alias("_pos_row"))
    files = rows.groupBy("_pos_file").agg(F.count("*").alias("_pos_rows"))
    before = _before(W.orderBy("_pos_file"))  # one row per file
    starts = files.select("_pos_file", F.coalesce(F.sum("_pos_rows").over(before), F.lit(0)).alias("_pos_start"))
    placed = rows.join(F.broadcast(starts), "_pos_file")
    return placed.select(*table.columns, (F.col("_pos_start") + F.col("_pos_row")).alias(name))


def with_hash_position(
    df: DataFrame, hash_column: str, ties: list[str], group: list[str] = (),
    name: str = "position", digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Add the zero-based rank by a hexadecimal hash, within ``group`` when given.

    The first ``digits`` characters of the hash are an even bucket that agrees with the order, so rank =
    rows in earlier buckets + rank within the bucket. Use more digits for more rows. Rows without a group are a group.
    """
    group = list(group)
    rows = df.withColumn("_bucket", F.substring(hash_column, 1, digits))
    sizes = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_rows"))
    before = _before(W.partitionBy(*group).orderBy("_bucket"))  # at most 16 ** digits rows a group
    start = F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    starts = _renamed(sizes.select(*group, "_bucket", start), group, "_bucket")
    if not group:
        starts = F.broadcast(starts)
    inside = W.partitionBy(*group, "_bucket").orderBy(hash_column, *ties)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, _same(ranked, starts, group, "_bucket")).select(
        *[ranked[c] for c in df.columns], (F.col("_start") + F.col("_rank")).alias(name)
    )


def _renamed(df: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """The keys of a small side under names of their own."""
    return df.withColumnsRenamed({g: f"_key{i}" for i, g in enumerate(group)} | {bucket: "_key"})


def _same(rows: DataFrame, small: DataFrame, group: list[str], bucket: str) -> Column:
    """Join condition on group and bucket; a missing group equals a missing group."""
    match = rows[bucket].eqNullSafe(small["_key"])
    for i, g in enumerate(group):
        match = match & rows[g].eqNullSafe(small[f"_key{i}"])
    return match


def batch_of(position: Column, batch_size: int) -> Column:
    """Batch id of a row position."""
    return F.floor(position / batch_size)


def drop_short_batch(df: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Keep only full batches; the row count is one scalar subquery."""
    full = df.agg(F.floor(F.count("*") / batch_size)).scalar()
    return df.filter(batch_of(F.col(position), batch_size) < full)


def running_sums(
    df: DataFrame, by: list[str], step: str, sums: dict[str, Column], width: int = 100_000
) -> DataFrame:
    """Running sums in ``step`` order within ``by``; ``step`` is an integer that counts up.

    Steps are cut into buckets of ``width``. Rows are sorted within one bucket only, and the sums of
    the earlier buckets (one row per bucket) are added, so a single long series still runs on many tasks. Rows
    without a ``by`` are a series of their own.
    """
    by = list(by)
    rows = df.withColumn("_bucket", F.floor(F.col(step) / width)).withColumns(sums)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    before = _before(W.partitionBy(*by).orderBy("_bucket"))
    heads = totals.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    heads = _renamed(heads, by, "_bucket")
    inside = W.partitionBy(*by, "_bucket").orderBy(step)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(n).over(so_far) for n in sums})
    return rows.join(heads, _same(rows, heads, by, "_bucket")).select(
        *[rows[c] for c in df.columns], *[(rows[n] + F.col(f"_{n}")).alias(n) for n in sums]
    )
