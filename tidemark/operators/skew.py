"""Lookup joins that hold when one key carries a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

BROADCAST_ROWS = 4_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
HOT_KEYS = 10_000
TRACKED = 32_768  # keys that a sketch of frequent keys counts at once
SLICES = 256  # sketches that tasks are merged into before their lists meet


def _width(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return F.lit(8)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is within both bounds. Counts rows and bytes in one small aggregation."""
    if rows <= 0:
        return False
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + _width(field)
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def hot_keys(sample: DataFrame, keys: list[str], limit: int = HOT_KEYS) -> DataFrame:
    """The most frequent keys of a sample, at most ``limit`` of them."""
    counted = sample.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("_n"))
    return counted.orderBy(F.desc("_n"), *keys).limit(limit).drop("_n")


def heavy_hitters(df: DataFrame, keys: list[str], limit: int = HOT_KEYS) -> DataFrame:
    """``_hash`` of the most frequent keys, at most ``limit``, by sketches of fixed size that every task fills in one pass over the keys.

    No key that carries more than a ``1 / TRACKED`` share of a slice is missed. Hashes of keys are counted, so keys may be of any type and
    number; whoever uses them compares the keys themselves.
    """
    hashes = df.select(*keys).dropna().select(F.xxhash64(*keys).alias("_hash"), F.pmod(F.spark_partition_id(), F.lit(SLICES)).alias("_slice"))
    lists = hashes.groupBy("_slice").agg(F.expr(f"approx_top_k(_hash, {limit}, {max(limit, TRACKED)})").alias("_top"))
    counted = lists.select(F.explode("_top").alias("_t")).groupBy(F.col("_t.item").alias("_hash")).agg(F.sum("_t.count").alias("_n"))
    return counted.orderBy(F.desc("_n"), "_hash").limit(limit).select("_hash")


def rows_of(hashes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table``, which has one row per key, whose keys have one of at most HOT_KEYS hashes; the table is scanned and not shuffled."""
    return table.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(hashes), "_hash").drop("_hash")


def lookup_few(few: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a table of at most HOT_KEYS rows to ``lookup``, which is scanned and not shuffled.

    An outer join cannot broadcast the side it keeps, so the matches are found by an inner join first.
    """
    matches = lookup.join(F.broadcast(few.select(*keys).distinct()), keys)
    return few.join(F.broadcast(matches), keys, "left")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    *,
    sample: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    costly: bool = False,
) -> DataFrame:
    """Left join of ``facts`` to ``lookup``, which has one row per key and is a table or cheap to compute.

    A lookup of checked size is broadcast. Beyond that the most frequent keys of the facts, known to the lookup or not, meet
    it by broadcast; facts with those keys, and facts without a key, are never shuffled, so no task gets a hot key. All others take an
    ordinary shuffle join. Frequent keys come from sketches in one pass over the keys, or from a ``sample`` where one is at hand; they only
    decide which way a row takes, and every row takes one. Facts that are ``costly`` to compute are written down before they are read for this.
    """
    if fits_broadcast(lookup, broadcast_rows):
        return facts.join(F.broadcast(lookup), keys, "left")
    without_key = F.lit(False)
    for key in keys:
        without_key = without_key | F.col(key).isNull()
    if sample is None:
        facts = materialize(facts, "facts") if costly else facts
        hashes = materialize(heavy_hitters(facts, keys), "heavy-hitters")
        matches = materialize(rows_of(hashes, lookup, keys), "hot-rows")
        hashed = facts.withColumn("_hash", F.xxhash64(*keys))
        few = F.broadcast(hashes.withColumn("_hot", F.lit(True)))
        quick = hashed.join(few, "_hash", "left").filter(F.col("_hot") | without_key).drop("_hash", "_hot")
        quick = quick.join(F.broadcast(matches), keys, "left")
        rest = hashed.filter(~without_key).join(F.broadcast(hashes), "_hash", "left_anti").drop("_hash").join(lookup, keys, "left")
        return quick.unionByName(rest)
    wanted = materialize(hot_keys(sample, keys), "hot-keys")
    hot = materialize(lookup_few(wanted, lookup, keys).withColumn("_hot", F.lit(True)), "hot-rows")
    # A broadcast of at most HOT_KEYS rows.
    quick = facts.join(F.broadcast(hot), keys, "left").filter(F.col("_hot") | without_key).drop("_hot")
    rest = facts.filter(~without_key).join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup, keys, "left")
    return quick.unionByName(rest)
