"""Exact samples, shuffles and replay mixes with a stable hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordinals import (
    PREFIX_DIGITS, batch_of, drop_short_batch, with_hash_position,
)
from tidemark.session import materialize


def order_hash(*parts: Column | str) -> Column:
    """Stable hash of ``a:b:...``; unlike ``rand(seed)`` it does not depend on the partitioning."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def split_exact(
    df: DataFrame, ids: list[str], size: Column | int, seed: int = 42, digits: int = PREFIX_DIGITS
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``size`` rows (all when there are fewer), the first in hash order of ``ids``, and the rest.

    A histogram of hash prefixes finds the bucket where the ``size``-th row lies; that one bucket is
    ranked to find the last hash taken. Only ids are read for this, once, into a written table. The rows themselves
    are filtered by that hash where they lie, without a shuffle: ``df`` is read twice, whatever is made of the two parts.
    ``size`` may be a scalar subquery.
    """
    size = F.lit(size) if isinstance(size, int) else size
    rows = df.withColumn("_hash", order_hash(F.lit(seed), *ids))
    keyed = materialize(rows.select(*ids, "_hash", F.substring("_hash", 1, digits).alias("_bucket")), "hashes")
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # at most 16 ** digits rows
    starts = (
        keyed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    edge = starts.filter(F.col("_start") < size).agg(F.max_by(F.struct("_bucket", "_start"), "_start").alias("e"))
    edge = edge.select("e._bucket", "e._start")
    ranked = (
        keyed.join(F.broadcast(edge), "_bucket")
        .withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", *ids)))
    )
    last = ranked.filter(F.col("_start") + F.col("_rank") <= size).agg(F.max(F.struct("_hash", *ids)).alias("_last"))
    last = materialize(last, "last-hash").scalar()
    taken = F.coalesce(F.struct("_hash", *ids) <= last, F.lit(False))  # no last row: nothing is taken
    return rows.filter(taken).drop("_hash"), rows.filter(~taken).drop("_hash")


def sample_exact(
    df: DataFrame, ids: list[str], size: Column | int, seed: int = 42, digits: int = PREFIX_DIGITS
) -> DataFrame:
    """The sample of ``split_exact``."""
    return split_exact(df, ids, size, seed, digits)[0]


def shuffled(df: DataFrame, ids: list[str], seed: int = 42, epoch: int = 0, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Add ``position`` in a random but repeatable order that changes with ``epoch``."""
    hashed = df.withColumn("_hash", order_hash(F.lit(seed), F.lit(epoch), *ids))
    return with_hash_position(hashed, "_hash", ids, digits=digits).drop("_hash")


def replay_size(rows: Column, ratio: float = 1.0, decay: float = 1.0, epoch: int = 0) -> Column:
    """Old rows to mix in; as many as new ones with the defaults."""
    return F.floor(rows * F.lit(float(ratio)) * F.pow(F.lit(float(decay)), F.lit(epoch)))


def replay_mix(
    new: DataFrame, old: DataFrame, ids: list[str], *, seed: int = 42, epoch: int = 0,
    ratio: float = 1.0, decay: float = 1.0,
) -> DataFrame:
    """New rows plus a sample of old ones, tagged with their ``origin``."""
    size = new.agg(replay_size(F.count("*"), ratio, decay, epoch)).scalar()
    # The seed moves with the epoch, so that every epoch reviews other rows.
    old = sample_exact(old, ids, size, seed + epoch)
    return new.withColumn("origin", F.lit("new")).unionByName(old.withColumn("origin", F.lit("old")))


def training_batches(
    df: DataFrame, ids: list[str], batch_size: int, *, seed: int = 42, epoch: int = 0, drop_last: bool = True
) -> DataFrame:
    """Shuffle rows and number their batches; the short last batch is dropped on request."""
    rows = shuffled(df, ids, seed, epoch)
    if drop_last:
        rows = drop_short_batch(rows, batch_size)
    return rows.withColumn("batch_id", batch_of(F.col("position"), batch_size))


def hold_out(df: DataFrame, ids: list[str], size: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A fixed-size tuning set and the rest for evaluation; they share no row."""
    return split_exact(df, ids, size, seed)


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Several sets side by side, each row tagged with the name and the ordinal of its set."""
    union = None
    for ordinal, (name, part) in enumerate(parts.items()):
        part = part.withColumns({tag: F.lit(name), f"{tag}_no": F.lit(ordinal)})
        union = part if union is None else union.unionByName(part)
    return union


def epoch_cursor(step: Column, files: int) -> tuple[Column, Column]:
    """Global epoch and file number of a training step that walks through ``files`` files in turn."""
    return F.floor(step / files), step % files
