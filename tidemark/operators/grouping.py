"""Grouping by a key, work once per key, and restoring the original order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordinals import with_position
from tidemark.operators.skew import BROADCAST_ROWS, lookup_join
from tidemark.session import materialize


def grouped(df: DataFrame, index: str, key: Column, order: str = "first_seen") -> DataFrame:
    """``index, group_key, group_pos, member_pos`` of every row.

    Groups are numbered by their first row, or by key with ``order='key'``; members by ``index``. A
    group is never gathered: its members stay rows, a large group is numbered by many tasks, and only
    index and key are shuffled. Use a hash as the key of long texts.
    """
    rows = df.select(index, key.alias("group_key"))
    firsts = rows.groupBy("group_key").agg(F.min(index).alias("_first"))
    numbered = with_position(firsts, ["_first" if order == "first_seen" else "group_key"], name="group_pos")
    members = with_position(rows, [index], ["group_key"], name="member_pos")
    found = lookup_join(members, numbered.select("group_key", "group_pos"), ["group_key"])
    return found.select(index, "group_key", "group_pos", "member_pos")


def chunks(df: DataFrame, position: str, size: int, value: str, by: list[str] = ()) -> DataFrame:
    """``chunk_id, items``: consecutive runs of ``size`` values; the short tail stays.

    ``position`` counts rows from zero, so an array never has more than ``size`` items.
    """
    chunk = F.floor(F.col(position) / size).alias("chunk_id")
    cells = df.groupBy(*by, chunk).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("_cells"))
    return cells.select(*by, "chunk_id", F.col(f"_cells.{value}").alias("items"))


def once_per_key(
    df: DataFrame, key: Column, work: Callable[[DataFrame], DataFrame], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Run ``work`` on one row per key and give its result to every row.

    ``work`` gets a table with the distinct ``group_key`` and returns it with more columns.
    """
    rows = df.withColumn("group_key", key)
    results = materialize(work(rows.select("group_key").distinct()), "per-key")
    return lookup_join(rows, results, ["group_key"], broadcast_rows=broadcast_rows)


def uncovered(df: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a result; empty when every row was covered."""
    return df.join(results, keys, "left_anti")
